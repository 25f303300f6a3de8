import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrazzo.llm import host_rules, lm_score, mixing, packing, quality_model, simhash, token_counts, toxicity
from terrazzo.llm.words import ngram_hashes

from .conftest import words

ODD = ["  a  b\n\nc ", "x <|endoftext|> y's don't", "a\tb \x01 c é é z", "\n", "A\nB", "1234 56  wide\x85", "été", "'s 't ##", "a​b"]


@pytest.fixture(scope="module")
def texts(spark, docs):
    more = spark.createDataFrame([(2000 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    return docs.select("doc_id", "text").unionByName(more).persist()


def test_token_counts(spark, texts, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    text = {r.doc_id: r.text or "" for r in texts.collect()}
    folder = str(tmp_path / "cache")
    for _ in range(2):  # the second run finds all counts in the cache
        out = token_counts.token_counts(texts, path, folder).collect()
        assert len(out) == texts.count()
        for r in out:
            n = len(library.encode(text[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 512)
        assert spark.read.parquet(folder).count() == len(set(text.values()))


def test_sentencepiece_counts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts.count_tokens(pa.array(ODD), path).tolist() == [len(x) for x in library.encode(ODD)]


def test_packing(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    capacity = 256
    out = packing.pack(texts, path, capacity, group_pieces=40).collect()
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    for row in texts.dropDuplicates(["doc_id"]).collect():
        ids = np.array([*library.encode(row.text or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == row.doc_id})
        cut = [ids[i : i + capacity] for i in range(0, len(ids), capacity)]
        assert pieces == [(i, i * capacity, len(c), zlib.crc32(c.tobytes())) for i, c in enumerate(cut)]


def test_sum_of_squares_is_near_the_bound():
    lengths = np.random.default_rng(4).integers(1, 1500, 5000)
    bins, offsets = packing.sum_of_squares(lengths, 2048)
    assert bins.max() + 1 <= 1.01 * np.ceil(lengths.sum() / 2048) + 2
    assert (offsets + lengths <= 2048).all()


def test_sum_of_squares_places_by_its_rule():
    """Each piece, longest first, goes where the squared counts of open bins per gap become smallest; recomputed from scratch every time."""
    lengths = np.random.default_rng(6).integers(1, 40, 300)
    bins, offsets = packing.sum_of_squares(lengths, 40)
    gaps: dict[int, int] = {}
    for i in sorted(range(300), key=lambda i: (-lengths[i], i)):
        s = int(lengths[i])

        def after(b, gaps=gaps, s=s):
            n = np.bincount([g - s if k == b else g for k, g in gaps.items()], minlength=41)
            return int((n[1:] ** 2).sum())

        room = [b for b, g in gaps.items() if g >= s]
        if room:
            assert bins[i] in room and after(int(bins[i])) == min(after(b) for b in room)
        else:
            assert bins[i] not in gaps
            gaps[int(bins[i])] = 40
        assert offsets[i] == 40 - gaps[int(bins[i])]
        gaps[int(bins[i])] -= s


def _labelled(spark, marks, label, n=240):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        t = words(rng, 60).split()
        if bad:
            for k in range(0, 60, 12):
                t[k] = rng.choice(marks)
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "x" * 3000)], "doc_id bigint, text string").repartition(3)
    return docs, spark.createDataFrame(labels, f"doc_id bigint, {label} int"), dict(labels)


def _accuracy(out, labels, held=True):
    own = [(r.predicted, labels[r.doc_id]) for r in out if r.doc_id in labels and r.held_out == held]
    return sum(a == b for a, b in own) / len(own)


def test_quality_model(spark):
    docs, labels, truth = _labelled(spark, ["ZZQX!!", "QQQ###", "###"], "quality")
    out = quality_model.quality_scores(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert _accuracy(out, truth) > 0.95


def test_quality_scores_against_the_weights(spark, docs):
    """A score is the logistic of the mean of a text's feature logits, recomputed here word by word."""
    rng = np.random.default_rng(2)
    logits, bias = rng.normal(0, 1, quality_model.BUCKETS + 1), 0.3
    got = {r.doc_id: r.score for r in quality_model.score(docs.select("doc_id", "text"), logits, bias).collect()}
    for r in docs.select("doc_id", "text").collect():
        w = (r.text or "").split()
        values = [logits[int(h % np.uint64(quality_model.BUCKETS))] for x in w for h in ngram_hashes([x], quality_model.NGRAMS)[1]]
        values += [logits[quality_model.REPEAT] for a, b in zip(w, w[1:]) if a == b]
        z = bias + (sum(values) / len(values) if values else 0.0)
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)


def test_toxicity(spark):
    docs, labels, truth = _labelled(spark, ["idiot", "1d1ot", "m0ron", "moron", "stuuupid", "stupid"], "toxic")
    spaced = spark.createDataFrame([(950, "well you m o r o n there"), (951, "quite plain words here")], "doc_id bigint, text string")
    out = toxicity.toxicity(docs.unionByName(spaced), labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert _accuracy(out, truth) > 0.95
    p = {r.doc_id: r.score for r in out}
    assert p[950] > 0.3 > p[951] and p[900] < 0.3 and p[901] < 0.3


def test_decoder():
    import collections

    letters = collections.Counter()
    text = "idiot moron trash stupid loser worthless pathetic stone stop statue trace crash those loose"
    codes = toxicity._codes()
    x = codes[[ord(c) for c in f"\n\n{'  '.join(text.split())}\n\n"]]
    for a, b, c in zip(x, x[1:], x[2:]):
        letters[int((a * toxicity.SIZE + b) * toxicity.SIZE + c)] += 1
    costs = toxicity.letter_model(pa.table({"gram": list(letters), "n": list(letters.values())}))
    for disguised, plain in (("1d10t", "idiot"), ("tr@sh", "trash"), ("l0$er", "loser"), ("stuuupid", "stupid"), ("m.o.r.o.n", "moron"), ("w0rthl3ss", "worthless"), ("trash", "trash")):
        assert toxicity.restore(disguised, costs) == plain


def test_models_without_labels(spark, empty):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality_model.quality_scores(docs, none).count() == 2
    assert [r.predicted for r in toxicity.toxicity(docs, none).collect()] == [0, 0]
    assert quality_model.quality_scores(empty, none).count() == 0 and toxicity.toxicity(empty, none).count() == 0


def test_lm_scores(docs, rows):
    out = lm_score.pseudo_likelihood(docs).collect()
    assert len(out) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    for r in out:
        n = len(text[r.doc_id].split())
        assert r.n_tokens == n and (r.log_prob < 0 if n else r.log_prob == 0) and (r.mean_log_prob is None) == (n == 0)


def test_empty_tables(empty):
    assert lm_score.pseudo_likelihood(empty).count() == 0
    assert packing.pack(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_ngram_hashes_agree_with_single_words():
    some = ["ab", "", "idiot", "é😀", "idiot"]
    owner, h = ngram_hashes(some, (3, 4))
    for i, w in enumerate(some):
        one = ngram_hashes([w], (3, 4))[1]
        assert sorted(h[owner == i]) == sorted(one)
    assert F is not None


def test_mixed_rows_that_share_ids(spark):
    """A third of the rows lack an id and a third share one, with texts of their own: plans and mixes agree between runs and layouts."""
    rows = [(None, f"a {i} b", "s0") for i in range(120)] + [(7, f"c {i}", "s1") for i in range(120)] + [(1000 + i, "d e f", "s2") for i in range(120)] + [(7, "same", "s1")] * 5
    runs = []
    for parts in (2, 5):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(parts)
        planned = mixing.order(docs).collect()
        assert len(planned) == len(rows) and all(r.taken <= 3 * r.size for r in planned)
        for s in ("s0", "s1", "s2"):
            own = [r for r in planned if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        mixed = [(r.doc_id, r.text, r.source) for r in mixing.mix(docs).collect()]
        runs.append((Counter(map(tuple, planned)), Counter(mixed)))
    assert runs[0] == runs[1]


def test_pipeline_against_brute_force(spark, docs):
    """Every stage, on what the one before it kept: which documents stay, and that all mixed ones are packed."""
    import corpus_pipeline

    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at.select("doc_id", "text").collect()
        out = stage(spark, at, "")
        assert out.columns == docs.columns
        after = Counter((r.doc_id, r.text) for r in out.select("doc_id", "text").collect())
        if name == "quality_rules":
            verdict = {(r.doc_id, r.n_words): r.kept for r in host_rules.judge(at).collect()}
            want = Counter((r.doc_id, r.text) for r in before if verdict[r.doc_id, len((r.text or "").split())])
            assert after == want
        elif name == "exact_dedup":
            best = {}
            for r in before:
                best.setdefault(r.text or "", []).append(r.doc_id)
            assert Counter({(i, t or ""): n for (i, t), n in after.items()}) == Counter((max((x for x in ids if x is not None), default=None), t) for t, ids in best.items())
        elif name == "simhash_dedup":
            sets = [set(simhash.shingle_hashes(r.text or "", 5).tolist()) for r in before]
            root = list(range(len(before)))

            def find(i):
                while root[i] != i:
                    i = root[i]
                return i

            for i, j in itertools.combinations(range(len(before)), 2):
                if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[find(j)] = find(i)
            least = {}
            for i, r in enumerate(before):
                least.setdefault(find(i), []).append((r.doc_id is None, r.doc_id or 0))
            assert Counter(i for i, _ in after.elements()) == Counter(None if min(v)[0] else min(v)[1] for v in least.values())
        else:
            copies = {}
            for r in mixing.plan(at).collect():
                copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
            assert {i: sum(n for (x, _), n in after.items() if x == i) for i in {i for i, _ in after}} == {i: n for i, n in copies.items() if n}
        at = out.persist()
    mixed = Counter(r.doc_id for r in at.select("doc_id").collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, at, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == mixed and mixed
