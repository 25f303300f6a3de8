"""Sum-of-squares packing of tokenised documents into sequences of fixed capacity.

Documents are tokenised in Arrow batches; only documents longer than the capacity are cut. The
pieces, a few dozen bytes each, are dealt into groups of about ``group_pieces`` by a hash of the row's
number, and each group is packed in one task by the sum-of-squares rule: with N(g) open bins of
residual gap g, a piece goes where the sum of N(g)**2 over all gaps becomes smallest. The rule is used
with two additions that need fewer bins: pieces come longest first, and a new bin is opened only
where no open bin has room. A group is bounded whatever the
size of the table, and leaves a few bins open, so the loss does not grow with the data.

Defined results: a null or empty text is one piece holding only the end id; repeated rows are packed
each; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from terrazzo.llm.common import filled, materialize, slices
from terrazzo.llm.words import split_words

CAPACITY = 2048
#: Pieces that one task packs; 40 bytes each.
GROUP_PIECES = 60_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_HELD: dict[str, "WordIds"] = {}


class WordIds:
    """Token ids of words, remembered per process for a tokenizer whose words are independent.

    Holds for tokenizers that drop white space and never merge across it; each word is encoded by
    the library, many in one call with a separator word between them.
    """

    def __init__(self, path: str, limit: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit = limit
        (self.separator,) = self.encode("\x01")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.starts, self.counts, self.flat = [np.zeros(n, t) for n, t in ((1 << 16, np.int64), (1 << 16, np.int32), (1 << 18, np.uint32))]
        self.used = 0

    def _append(self, words: list[str], counts: np.ndarray, ids: np.ndarray) -> None:
        n, at = len(self.rows), self.used
        while n + len(words) > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts))
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.starts[n : n + len(words)] = at + np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.counts[n : n + len(words)] = counts
        self.flat[at : at + len(ids)] = ids
        self.used = at + len(ids)
        self.rows.update(zip(words, range(n, n + len(words))))

    def rows_of(self, words: list[str]) -> np.ndarray:
        """Rows of starts and counts for these distinct words."""
        if len(self.rows) + len(words) > self.limit:
            self.clear()
        find = self.rows.get
        at = np.fromiter((find(w, -1) for w in words), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        new = [words[k] for k in missing]
        for kind in (True, False):  # words of letters only are single words to the tokenizer: their last id shows where they end
            own = [w for w in new if w.isalpha() == kind]
            for i in range(0, len(own), 500):
                self._encode_many(own[i : i + 500], kind)
        if len(missing):
            at[missing] = [self.rows[words[k]] for k in missing]
        return at

    def _encode_many(self, words: list[str], letters: bool) -> None:
        if letters:
            ids = np.array(self.encode(" ".join(words)), np.uint32)
            edges = np.flatnonzero(self.ends[ids]) + 1
            if len(edges) == len(words) and edges[-1] == len(ids):
                self._append(words, np.diff(edges, prepend=0), ids)
                return
        plain = [w for w in words if "\x01" not in w]
        if plain:
            ids = np.array(self.encode(" \x01 ".join(plain)), np.uint32)
            cut = np.flatnonzero(ids == self.separator)
            if len(cut) == len(plain) - 1:
                edges = np.concatenate([[-1], cut, [len(ids)]])
                self._append(plain, np.diff(edges) - 1, ids[ids != self.separator])
            else:
                plain = []
        done = set(plain)
        for w in words:
            if w not in done:
                ids = self.encode(w)
                self._append([w], np.array([len(ids)]), np.array(ids, np.uint32))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i+1]]."""
        # the tokenizer lowers case and parts letters from marks itself; doing so first leaves fewer distinct words.
        # A special token's text is matched before that, so texts that may hold one stay as they are.
        parted = pc.replace_substring_regex(pc.ascii_lower(texts), r"(\p{L})([,.])(\s|$)", r"\1 \2\3")
        spaced = pc.replace_substring(pc.if_else(pc.match_substring(texts, "<|"), texts, parted), "\n", " ")
        offsets, codes, words = split_words(spaced, " ")
        rows = self.rows_of(words)[codes] if len(words) else np.zeros(0, np.int64)
        counts = self.counts[rows].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        where = np.repeat(self.starts[rows] - ends[:-1], counts) + np.arange(ends[-1])
        return ends[offsets], self.flat[where]


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches):
        if tokenizer_path not in _HELD:
            _HELD[tokenizer_path] = WordIds(tokenizer_path)
        words = _HELD[tokenizer_path]
        for part in slices(batches, "text"):
            offsets, ids = words.batch(filled(part.column("text")))
            out: list[tuple] = []
            for doc, a, b in zip(part.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    some = own[at : at + capacity]
                    out.append((doc, k, at, len(some), zlib.crc32(some.tobytes())))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece, longest pieces first, each placed by the sum-of-squares rule.

    With N(g) open bins of gap g, a piece of length s changes the sum of squares by
    2 N(g-s) - 2 N(g) + 2 in a bin of gap g > s, by 1 - 2 N(s) where it fills one of gap s, and by
    2 N(capacity-s) + 1 in a new bin. A new bin is opened only where no open bin has room, as bins
    are what is to be saved; ties go to the smaller gap.
    """
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in order.tolist():
        s = int(lengths[i])
        if s == capacity:
            bins[i], offsets[i], made = made, 0, made + 1
            continue
        change = 2 * (n[: capacity - s] - n[s:capacity]) + 2
        change[0] -= 1 + 2 * n[0]
        change[n[s:capacity] == 0] = np.iinfo(np.int64).max
        k = int(change.argmin())
        if n[s + k] == 0:
            b, gap, made = made, capacity, made + 1
        else:
            gap = s + k
            b = stacks[gap].pop()
            n[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            n[gap - s] += 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece, with its sequence_id and its offset there (gapless from 0)."""
    pieces = materialize(pieces_of(docs, tokenizer_path, capacity).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "_row"], kind="stable", na_position="first", ignore_index=True)
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=pdf["_group"].to_numpy() * (1 << 40) + bins, offset=offsets).drop(columns=["_group", "_row"])

    group = F.pmod(F.xxhash64("_row"), F.lit(groups))  # by row: rows that repeat or lack an id are dealt like others
    return pieces.withColumn("_group", group).groupBy("_group").applyInPandas(place, f"{PIECES}, sequence_id bigint, offset bigint")
