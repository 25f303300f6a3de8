"""Toxicity scores of texts restored by a noisy-channel decoder.

Words that look disguised (symbols or digits for letters, stretched letters, letters set apart by
spaces or punctuation) become lattices of the letters that each sign may stand for. Viterbi
decoding under a character trigram model, counted over the letters of all documents, picks the most
likely letters. The restored words are scored by a lexicon of words and word beginnings that are far
more frequent in toxic documents than in others, learned from labelled rows, and a logistic layer
turns a document's hits into a probability.

The trigram counts are added up by Spark and have at most |alphabet| ** 3 rows; the lexicon keeps
the ``LEXICON`` strongest entries. The labelled rows are a sample of ``TRAIN_ROWS`` at most: a lexicon
of one half gives the hits of the other, on which the logistic layer is fitted; documents are scored
with the lexicon of the whole sample. Scoring reads every whole text.

Defined results: null and empty texts have no hits; rows repeated with their doc_id are scored each;
without any toxic label nothing is a hit; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from terrazzo.llm.common import filled, materialize, slices
from terrazzo.llm.labels import crc_mod, training_sample
from terrazzo.llm.words import WordCache, ngram_hashes, split_words, sums

TRAIN_ROWS = 8000
LEXICON = 4096
PREFIXES = (4, 5, 6)
#: Least toxic documents that hold an entry of the lexicon, least log-likelihood ratio of its share of
#: toxic documents against theirs of all, and least log-odds of its occurrences.
LEAST_DOCS, LEAST_RATIO, LEAST_ODDS = 4, 28.0, 2.5
#: Occurrences of an entry that count in one document.
MOST_IN_DOC = 6

LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäæçèéêëíîïñóôöøßúûüýœ"
_AT = {c: i + 1 for i, c in enumerate(LETTERS)}  # 0 is a word's edge
SIZE = len(LETTERS) + 1

#: Letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "<": "c", "£": "l", "¡": "i",
}
SEPARATORS = ".-_*'~/,:"
#: Costs (negative log probabilities) of the channel: a sign for a letter, a sign dropped, a stretched letter.
SIGN_COST, DROP_COST, STRETCH_COST = 0.7, 4.0, 0.4

_EDGE = re.compile(r"^[^\w@$!|+€£¡(<]+|[^\w@$+€£|]+$")
_DISGUISED = re.compile(r"[^\W\d_][\d@$!|+€(<£¡]|[\d@$!|+€(<£¡][^\W\d_]|([^\W\d_])\1\1|^[^\W_](?:[.\-_*'~/,:]+[^\W_]){2,}$|[^\W\d_][*_.\-~]+[^\W\d_]")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]{1,2}\S){2,}(?!\S)")
_SPACED_RE2 = r"(?:^|[ \t\n])[^ \t\n](?:[ \t]{1,2}[^ \t\n]){2,}(?:[ \t\n]|$)"
#: Signs (runs as one) that are decoded at once, and by how many the pieces of longer words overlap.
_LONGEST, _OVERLAP = 40, 16
#: Costs of a word's end between signs one space and two spaces apart, besides the letters' own costs, and of none at two spaces.
BREAK_COST, WIDE_COST, JOIN_COST = 0.0, 0.0, 3.0
#: Letters that are words.
ALONE = "aeiouyàéó"
#: Cost of one letter for two.
PAIR_COST = 0.4


def _codes() -> np.ndarray:
    """Alphabet index by code point below U+0180, both cases."""
    out = np.zeros(0x181, np.int64)
    for c, i in _AT.items():
        for x in (c, c.upper()):
            if len(x) == 1 and ord(x) < 0x180:
                out[ord(x)] = i
    return out


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): letter trigrams of all texts, edges included, as base-``SIZE`` numbers."""

    def run(batches):
        codes, total = _codes(), np.zeros(SIZE**3, np.int64)
        for part in slices(batches, "text", 4_000_000):
            text = "\n\n".join(filled(part.column("text")).to_pylist())
            points = np.frombuffer(f"\n\n{text}\n\n".encode("utf-32-le", "surrogatepass"), np.uint32)
            x = codes[np.minimum(points, 0x180)].astype(np.int32)
            total += np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def letter_model(counts: pa.Table) -> np.ndarray:
    """Negative log probabilities [a, b, c] of c after a, b: interpolated trigrams, bigrams and letters."""
    n = np.zeros(SIZE**3)
    n[counts["gram"].to_numpy()] = counts["n"].to_numpy()
    n = n.reshape(SIZE, SIZE, SIZE)
    one = (n.sum(axis=(0, 1)) + 1) / (n.sum() + SIZE)
    two = n.sum(axis=0)
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    three = (n + 5 * two[None]) / (n.sum(axis=2, keepdims=True) + 5)
    return -np.log(three)


def lattice(word: str, pairs: bool = False) -> list[list[tuple[str, float]]]:
    """For each sign of the word (runs as one), the strings it may stand for and their costs; with ``pairs``, two equal letters may be one."""
    out: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(word):
        c, j = word[i], i
        while j < len(word) and word[j] == c:
            j += 1
        n = j - i
        if c in _AT:
            out.append([(c, STRETCH_COST), (c + c, STRETCH_COST)] if n > 2 else [(c * n, 0.0), (c, PAIR_COST)][: 1 + (pairs and n == 2)])
        elif c in SIGNS:
            some = [(x * k, SIGN_COST * k) for x in SIGNS[c] for k in range(1, min(n, 2) + 1)]
            out.append([*some, ("", DROP_COST)])
        elif c.isalpha():  # letters that the model does not know stay as they are, like an edge to their neighbours
            out.append([(c, STRETCH_COST)] if n > 2 else [(c * n, 0.0)])
        else:
            out.append([("", 0.3 if c in SEPARATORS else 2.0)])
        i = j
    return out


def spaced_lattice(run: str) -> list[list[tuple[str, float]]]:
    """The lattice of signs that stand apart: between two of them a word may end (a space). Equal neighbours are not one stretched letter."""
    out: list[list[tuple[str, float]]] = []
    for sign, gap in re.findall(r"(\S)(\s*)", run):
        out += lattice(sign)
        if gap:
            out.append([(" ", WIDE_COST), ("", JOIN_COST)] if len(gap) > 1 else [("", 0.0), (" ", BREAK_COST)])
    return out


def decode(word: str | list[list[tuple[str, float]]], costs: np.ndarray) -> str:
    """The likeliest letters behind a word or lattice: Viterbi over (last two letters) states; a space is a word's edge."""
    states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in lattice(word) if isinstance(word, str) else word:
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, done) in states.items():
            for letters, own in options:
                p, q, total = a, b, cost + own
                for c in letters:
                    k = _AT.get(c, 0)
                    total += costs[p, q, k]
                    p, q = q, k
                if (p, q) not in after or total < after[p, q][0]:
                    after[p, q] = (total, done + letters)
        states = after
    return min((cost + costs[a, b, 0], done) for (a, b), (cost, done) in states.items())[1]


def _pieces(signs: list, longest: int, overlap: int) -> list[list]:
    """The signs in pieces of ``longest`` at most, each starting ``overlap`` signs before the last one's end."""
    return [signs[k : k + longest] for k in range(0, max(len(signs) - overlap, 1), longest - overlap)]


def restore_all(word: str, costs: np.ndarray) -> list[str]:
    """The word in lower case without edge punctuation, decoded where it looks disguised: in overlapping pieces if it is long.

    Many words have letters twice: such a word is also decoded with one letter for two, besides what else it is.
    """
    low = _EDGE.sub("", word.lower())
    own = [low.strip("$+|€£@!(<") or low]
    disguised = not low.isdigit() and _DISGUISED.search(low)
    decoded = lambda pairs: [w for p in _pieces(lattice(low, pairs), _LONGEST, _OVERLAP) if (w := decode(p, costs))]
    if disguised:
        own = decoded(False) or [low]
    return list(dict.fromkeys(own + decoded(True))) if _DOUBLED.search(low) else own


def restore(word: str, costs: np.ndarray) -> str:
    """The first of ``restore_all``."""
    return restore_all(word, costs)[0]


def spaced_words(texts: pa.Array, costs: np.ndarray) -> dict[int, list[str]]:
    """Words whose letters stand apart, by text: each run of single signs with at least three letters, decoded into words.

    The letters may follow a word of one letter, which trigrams seldom tell from a beginning ('a m o r o n'), so words count without it too.
    """
    out: dict[int, list[str]] = {}
    for i in np.flatnonzero(pc.match_substring_regex(texts, _SPACED_RE2).to_numpy(zero_copy_only=False)).tolist():
        words = []
        for m in _SPACED.finditer(texts[i].as_py()):
            if sum(c in _AT or c in SIGNS for c in m.group().lower()) >= 3 and any(c in _AT for c in m.group().lower()):
                for piece in _pieces(spaced_lattice(m.group().lower()), 4 * _LONGEST, 2 * _OVERLAP):
                    some = decode(piece, costs).split()
                    words += some + [w[1:] for w in some if w[0] in ALONE and len(w) > 3]
        if words:
            out[i] = words
    return out


def _entries(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of each word and of its beginnings."""
    return ngram_hashes(words, PREFIXES, prefix_only=True)


def _restored_entries(words: list[str], costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the distinct entries of each word as restored."""
    some = [restore_all(w, costs) for w in words]
    owner, h = _entries([p for pieces in some for p in pieces])
    owner = np.repeat(np.arange(len(words)), [len(pieces) for pieces in some])[owner]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def _document_entries(texts: pa.Array, costs: np.ndarray):
    """The distinct entry hashes of each text and how often it has them, ``MOST_IN_DOC`` at most."""
    offsets, codes, words = split_words(texts)
    owner, h = _restored_entries(words, costs)
    order = np.argsort(owner, kind="stable")
    h = h[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))]).astype(np.int64)
    apart = spaced_words(texts, costs)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        own, n = np.unique(codes[a:b], return_counts=True)
        parts = [h[ends[c] : ends[c + 1]] for c in own]
        times = [np.full(len(x), k) for x, k in zip(parts, n)]
        if i in apart:
            parts.append(_entries(apart[i])[1])
            times.append(np.ones(len(parts[-1]), np.int64))
        if parts:
            every, place = np.unique(np.concatenate(parts), return_inverse=True)
            yield every, np.minimum(np.bincount(place, np.concatenate(times)), MOST_IN_DOC)
        else:
            yield np.zeros(0, np.uint64), np.zeros(0)


def lexicon(sample: DataFrame, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, log-odds) of the entries that mark toxic documents."""
    model = sample.sparkSession.sparkContext.broadcast(costs)

    def run(batches):
        for part in slices(batches, "text", 4_000_000):
            y = part.column("y").to_numpy()
            own = list(_document_entries(filled(part.column("text")), model.value))
            of = np.repeat(y, [len(x) for x, _ in own])
            times = np.concatenate([*(n for _, n in own), np.zeros(0)])
            every, place = np.unique(np.concatenate([*(x for x, _ in own), np.zeros(0, np.uint64)]), return_inverse=True)
            weights = (of, 1 - of, of * times, (1 - of) * times)
            columns = [every.view(np.int64), *(np.bincount(place, w, len(every)).astype(np.int64) for w in weights)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["entry", "docs", "others", "toxic", "clean"])

    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if not n.get(1) or not n.get(0):
        return np.zeros(0, np.uint64), np.zeros(0)
    counts = sample.select("text", "y").mapInArrow(run, "entry bigint, docs bigint, others bigint, toxic bigint, clean bigint")
    counts = counts.groupBy("entry").agg(*(F.sum(c).alias(c) for c in ("docs", "others", "toxic", "clean")))
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / n[1]) - F.log(c / n[0])
    share = n[1] / (n[0] + n[1])
    both = F.col("docs") + F.col("others")
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * p))).otherwise(0.0)
    marks = counts.where(F.col("docs") >= LEAST_DOCS).withColumn("odds", odds).withColumn("ratio", 2 * (part("docs", share) + part("others", 1 - share)))
    marks = marks.where((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") > LEAST_ODDS))
    kept = marks.orderBy(F.desc("ratio"), "entry").limit(LEXICON).select("entry", "odds").toArrow()
    h = kept["entry"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], kept["odds"].to_numpy()[order]


_CACHES: dict[str, WordCache] = {}


def hits(docs: DataFrame, costs: np.ndarray, entries: np.ndarray, odds: np.ndarray) -> DataFrame:
    """Per row of ``docs``, its other columns with words, hits and strength (sum of the hits' log-odds)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((costs, entries, odds))
    name = uuid.uuid4().hex
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        letter_costs, marks, weight = model.value

        def strength(words: list[str], entries=_entries) -> np.ndarray:
            out = np.zeros(len(words))
            if len(marks):
                owner, h = entries(words)
                at = np.minimum(np.searchsorted(marks, h), len(marks) - 1)
                found = marks[at] == h
                np.maximum.at(out, owner[found], weight[at[found]])
            return out

        if name not in _CACHES:
            _CACHES.clear()
            _CACHES[name] = WordCache(lambda words: strength(words, lambda some: _restored_entries(some, letter_costs)), 1_000_000)
        for part in slices(batches, "text"):
            texts = filled(part.column("text"))
            offsets, codes, words = split_words(texts)
            s = _CACHES[name].get(words)[codes] if words else np.zeros(0)
            total, n = sums(s, offsets), sums((s > 0).astype(np.int64), offsets)
            for i, apart in spaced_words(texts, letter_costs).items():
                more = strength(apart)
                total[i] += more.sum()
                n[i] += (more > 0).sum()
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(np.diff(offsets)), pa.array(n), pa.array(total)], [*others, "words", "hits", "strength"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.mapInArrow(run, f"{kinds}, words bigint, hits bigint, strength double")


def fit_layer(rows: pa.Table, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression on ``_layer_inputs``, by Newton steps."""
    rows = rows.sort_by("doc_id")
    y = rows["y"].to_numpy().astype(float)
    x = _layer_inputs(*(rows[c].to_numpy() for c in ("words", "hits", "strength")))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.05 * w
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def _layer_inputs(words, n, strength) -> np.ndarray:
    return np.stack([np.ones(len(words)), np.log1p(strength), np.minimum(strength, 40.0), np.minimum(100 * strength / np.maximum(words, 1), 40.0)], axis=1)


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    costs = letter_model(trigram_counts(docs).toArrow())
    sample = materialize(training_sample(docs, labels, "toxic", 4, 2, train_rows).select(F.col("doc_id").cast("bigint"), "text", "y"), "toxic-sample")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    layer = hits(sample.where(half == 1), costs, *lexicon(sample.where(half == 0), costs)).toArrow()
    w = [float(x) for x in (fit_layer(layer) if layer.num_rows else (-4.0, 2.0, 0.0, 0.0))]
    entries, odds = lexicon(sample, costs)
    rate = 100 * F.col("strength") / F.greatest("words", F.lit(1))
    z = w[0] + w[1] * F.log1p("strength") + w[2] * F.least("strength", F.lit(40.0)) + w[3] * F.least(rate, F.lit(40.0))
    scored = hits(docs.select(F.col("doc_id").cast("bigint"), "text"), costs, entries, odds).withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select("doc_id", (crc_mod(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
