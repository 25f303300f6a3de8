"""Arrow-side word handling inside tasks: splitting, dictionaries and per-word caches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _lists_of_words(texts: pa.Array, separator: str | None) -> tuple[np.ndarray, pa.Array]:
    """(offsets, all words one after the other) of the texts."""
    lists = pc.ascii_split_whitespace(texts) if separator is None else pc.split_pattern(texts, separator)
    offsets = lists.offsets.to_numpy()
    words = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    offsets = (offsets - offsets[0]).astype(np.int64)
    if separator is None:  # leading and trailing white space leaves empty strings
        full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        if not full.all():
            offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
            words = words.filter(pa.array(full))
    return offsets, words


def split_arrays(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, all words one after the other) of texts split at ASCII white space, as an Arrow array."""
    return _lists_of_words(texts, None)


#: Bits of a word's id that digest its ending.
ENDING_BITS = 12


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, codes, ids): ``codes`` index ``ids``, the 64-bit ids of the distinct words of the texts.

    An id's low ``ENDING_BITS`` bits are a hash of the word's last two bytes, the others of all its bytes.
    """
    offsets, words = _lists_of_words(texts, None)
    coded = words.dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), pa.concat_arrays([coded.dictionary])
    if not len(words):
        return offsets, np.zeros(0, np.int32), np.zeros(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    starts, lengths = ends[:-1], np.diff(ends)
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    last, before = data[ends[1:] - 1].astype(np.uint64), np.where(lengths > 1, data[np.maximum(ends[1:] - 2, 0)], 0).astype(np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        power = np.power(odd, np.arange(int(lengths.max()), dtype=np.uint64))
        h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[place], starts)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        ending = ((last | (before << np.uint64(8))) * odd) >> np.uint64(64 - ENDING_BITS)
    return offsets, codes, ((h << np.uint64(ENDING_BITS)) | ending).view(np.int64)


def split_words(texts: pa.Array, separator: str | None = None) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of every text, as (offsets, codes, distinct words).

    ``offsets[i]:offsets[i+1]`` is the span of text ``i`` in ``codes``; a code indexes the distinct words.
    Without a separator, words are split at ASCII white space (U+0009 to U+000D and space).
    """
    offsets, words = _lists_of_words(texts, separator)
    coded = words.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each span of ``offsets`` (0 for empty spans)."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _runs(words: list[str], chars: int = 1_000_000):
    """The words in runs of about ``chars`` characters, so that arrays over their characters stay small."""
    start, held = 0, 0
    for i, w in enumerate(words):
        held += len(w)
        if held > chars:
            yield words[start : i + 1]
            start, held = i + 1, 0
    if start < len(words):
        yield words[start:]


class WordCache:
    """Per-process memo from a word to a row of values; cleared when it reaches ``limit`` words."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], limit: int = 1_500_000):
        self.compute, self.limit, self.rows = compute, limit, {}
        self.values: np.ndarray | None = None
        self.used = 0

    def get(self, words: list[str]) -> np.ndarray:
        if self.used + len(words) > self.limit:
            self.rows, self.used = {}, 0
        find = self.rows.get
        at = np.fromiter((find(w, -1) for w in words), dtype=np.int64, count=len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [words[i] for i in missing]
            values = np.concatenate([self.compute(some) for some in _runs(new)])
            need = self.used + len(new)
            if self.values is None or need > len(self.values):
                grown = np.zeros((max(need, 2 * self.used, 1024), *values.shape[1:]), dtype=values.dtype)
                if self.values is not None:
                    grown[: self.used] = self.values[: self.used]
                self.values = grown
            self.values[self.used : need] = values
            self.rows.update(zip(new, range(self.used, need)))
            at[missing] = np.arange(self.used, need)
            self.used = need
        return self.values[at] if self.values is not None else self.compute([])


def ngram_hashes(words: list[str], sizes: tuple[int, ...], prefix_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of ``<word>`` for every word, as (word index, 64-bit hash).

    The whole bracketed word counts as one more gram. All arithmetic is modulo 2**64 on arrays.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    points = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - starts[owner]
    left = lengths[owner] - place
    prime = np.uint64(0x9E3779B97F4A7C15)
    mixed = (points + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    ids, hashes = [], []
    with np.errstate(over="ignore"):
        power = np.power(prime, np.arange(int(lengths.max()), dtype=np.uint64))
        for n in sizes:
            if n > len(points):
                continue
            where = np.flatnonzero((left >= n) & (place == 0)) if prefix_only else np.flatnonzero(left >= n)
            h = np.full(len(where), np.uint64(n) * np.uint64(0xA0761D6478BD642F))
            for k in range(n):
                h = h * prime + mixed[where + k]
            ids.append(owner[where])
            hashes.append(h)
        whole = np.add.reduceat(mixed * power[place], starts)
        ids.append(np.arange(len(words)))
        hashes.append(whole)
        out = np.concatenate(hashes)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.concatenate(ids), out
