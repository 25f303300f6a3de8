"""Removal of byte strings that earlier documents hold, through merged Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
doc_id. Texts are bytes (UTF-8), strings never cross documents, and all are judged on the input.

1. Documents are packed into shards of about ``SHARD_BYTES``, a table bucketed by shard as each task writes it, so that texts
   are never shuffled and what shards learn later joins them where they lie. Of equal texts, found by their digests, those with a larger doc_id than another go
   whole if they have ``length`` bytes, and take no part in what follows.
2. Every string of ``length`` bytes has an anchor, the least hash among its ``length // 3``-byte grams: equal
   strings have equal anchors. Neighbours that share their anchor form one stretch of text. Shards send their
   distinct anchors, by hash ranges and there as 32 bits, and learn in a bit each which of them two documents or more hold;
   other stretches hold no repeated string.
3. Stretches with repeated anchors, combined per shard, meet by anchor in a bucket, buckets travelling in groups, so that a shard
   sends few rows however many buckets there are. A bucket cuts its
   distinct stretches that hold ``length`` bytes of a repeated hash into parts, sorts the suffixes of each part and takes its Burrows-Wheeler transform; the
   transforms are merged by refining their interleaving, two symbols a round, without sorting suffixes again.
   After ``length`` symbols, the blocks of the interleaving are the repeated intervals: suffixes that share that
   many bytes. The least doc_id of each goes back to the shards.
4. Shards mark the strings that start in a document with a smaller doc_id and cut out what they cover.

A hot stretch travels once a shard, with its least doc_id. An anchor of more than ``HOT`` documents, around
which stretches could differ without bound, deals its strings over all buckets one by one, by a hash of the
whole string. Hashes only choose where strings meet; equality is decided by the transforms.

Defined results: a null text is empty and keeps nothing; a null doc_id is larger than any other, and two of
them remove nothing from each other; rows that repeat a doc_id are documents of the same id and remove nothing
from each other; texts shorter than ``length`` stay whole; an empty table gives an empty result; long texts are
read whole, in blocks; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terrazzo.llm.common import bucketed, filled, materialize, skew_safe_lookup, slices

LENGTH = 50
#: Text of a shard, about; anchors of a range; stretches of a bucket and of a part, in bytes.
SHARD_BYTES, RANGE_BYTES, BUCKET_BYTES, PART_BYTES = 3_000_000, 16_000_000, 500_000, 100_000
#: Text of a bucket of the table of shards.
FILE_BYTES = 24_000_000
#: Stretches of a group of buckets at most, and those that a shard sends to a group, about, in bytes.
GROUP_BYTES, ROW_BYTES = 16_000_000, 4_000
#: Documents of an anchor beyond which its strings are dealt out one by one.
HOT = 1 << 15
#: Strings of one stretch at most.
STRETCH = 64
#: Ends a text; no byte of UTF-8.
END = 0xFF
LAST = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15


def _stirred(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the bytes data[i : i + size] for every i, by doubling."""
    with np.errstate(over="ignore"):
        step = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        out, done, width = None, 0, 1
        while True:
            if size & width:
                if out is None:
                    out = step
                else:  # the part found so far stands behind this one
                    n = min(len(step), len(out) - width)
                    out = step[:n] * np.uint64(pow(_BASE, done, 1 << 64)) + out[width : width + n]
                done += width
            if done == size:
                return _stirred(out)
            step = step[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + step[width:]
            width *= 2


def _least_ahead(h: np.ndarray, span: int) -> np.ndarray:
    """min(h[i : i + span]) for every i."""
    width = 1
    while 2 * width <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = span - width
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def anchors(data: np.ndarray, length: int, block: int = 1 << 16) -> np.ndarray:
    """The anchor of the string of ``length`` bytes at every place (ends of texts not minded), block by block."""
    gram = max(1, length // 3)
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.concatenate([_least_ahead(gram_hashes(data[i : min(i + block, n) + length - 1], gram), length - gram + 1) for i in range(0, n, block)])


def stretches(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, anchor) of the stretches of texts that END ends, each of at most STRETCH strings."""
    anchor = anchors(data, length)
    n = len(anchor)
    ends = np.flatnonzero(data == END)
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, np.maximum(ends - length + 1, 0), 1)  # short texts at the start share a place
    change[ends + 1] -= 1
    whole = np.cumsum(change[:n]) == 0
    breaks = np.ones(n, bool)
    breaks[1:] = (anchor[1:] != anchor[:-1]) | ~whole[:-1] | ~whole[1:]
    edges = np.append(np.flatnonzero(breaks), n)
    start, count = edges[:-1], np.diff(edges)
    held = whole[start] if n else np.zeros(0, bool)
    start, count = start[held], count[held]
    pieces = -(-count // STRETCH)
    own = np.repeat(np.arange(len(start)), pieces)
    k = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return start[own] + k * STRETCH, np.minimum(count[own] - k * STRETCH, STRETCH), anchor[start[own]]


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, first[owner] + 0, 1, ...): each index ``count`` times, counting up from ``first``."""
    owner = np.repeat(np.arange(len(first)), count)
    return owner, np.arange(len(owner)) + (first - (np.cumsum(count) - count))[owner]


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.BinaryArray:
    """data[start : start + size] as an Arrow array."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    at = np.repeat((start - offsets[:-1]).astype(np.int32), size)
    at += np.arange(len(at), dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def _parts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow array of binaries."""
    column = pa.concat_arrays([column.cast(pa.binary())])
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


# -- transforms --


def transform(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, the two symbols before each) of distinct strings data[start : start + size], the last symbol of each being END.

    A string is read as a cycle. Suffixes are ranked by 8 symbols, then 16 and on until all ranks differ.
    """
    first, length = np.repeat(start, size), np.repeat(size, size)
    place = np.arange(len(data)) - first
    ahead = lambda k: first + (place + k) % length
    key = np.zeros(len(data), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | data[ahead(k)]
    reach = 8
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.concatenate([[0], ordered[1:] != ordered[:-1]])
        rank = np.empty(len(data), np.uint64)
        rank[order] = np.cumsum(new)
        if new.sum() == len(data) - 1 or reach > 2 * (size.max() if len(size) else 0):
            before = data[ahead(-2)].astype(np.uint16) << 8 | data[ahead(-1)]
            return order, before[order]
        key = (rank << np.uint64(32)) | rank[ahead(reach)]
        reach *= 2


def merged(befores: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, block): the merged row of each transform's entry, one transform after the other, and the block of every merged row.

    ``befores`` are transforms by the two symbols before each suffix. From all entries of one transform before those of
    the next, every round sorts the entries stably by those symbols, which orders the suffixes by two symbols
    more: their sources are the refined interleaving. A block holds the suffixes that share all symbols so far.
    """
    size = [len(b) for b in befores]
    source = np.repeat(np.arange(len(befores), dtype=np.uint8 if len(befores) < 256 else np.uint32), size)
    symbols, block = np.concatenate(befores), np.zeros(len(source), np.int32)
    n = len(source)
    before = np.empty(n, np.uint16)
    for _ in range(rounds):
        before[np.argsort(source, kind="stable")] = symbols
        order = np.argsort(before, kind="stable")
        source, old, now = source[order], block[order], before[order]
        block = np.empty(n, np.int32)
        block[:1] = 0
        np.cumsum((now[1:] != now[:-1]) | (old[1:] != old[:-1]), out=block[1:])
    return np.argsort(source, kind="stable"), block


def least_sharing(strings: pa.BinaryArray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, least): for each of distinct strings, by its offsets, the least ``at`` of all strings that hold its ``length`` bytes from each place.

    Only strings with ``length`` bytes whose hash occurs twice enter the transforms: where hashes differ, bytes do too.
    """
    ends, plain = _parts_of(strings)
    size = np.diff(ends) + 1
    start = np.cumsum(size) - size
    data = np.full(int(size.sum()), END, np.uint8)
    data[np.arange(len(plain)) + np.repeat(np.arange(len(size)), size - 1)] = plain
    own = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(data)) - start[own] <= (size - 1 - length)[own]
    of = own[inside]
    least = at[of]
    hashes = gram_hashes(data, length)[inside[: len(data) - length + 1]]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    met = np.zeros(len(size), bool)
    met[of[order[1:][same]]] = met[of[order[:-1][same]]] = True
    if met.any():
        least[met[of]] = _least_by_transforms(data[met[own]], size[met], inside[met[own]], at[met], length)
    return np.concatenate([[0], np.cumsum(size - length)]), least


def _least_by_transforms(data: np.ndarray, size: np.ndarray, inside: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The least ``at`` by each place ``inside`` of strings of these sizes, one after the other, from the merged transforms of their parts."""
    start = np.cumsum(size) - size
    cuts = np.unique(np.searchsorted(start, np.arange(0, len(data), PART_BYTES)))
    suffixes, befores = [], []
    for a, b in zip(cuts, np.append(cuts[1:], len(size))):
        if a < b:
            low, high = start[a], start[b - 1] + size[b - 1]
            order, before = transform(data[low:high], start[a:b] - low, size[a:b])
            suffixes.append(order + low)
            befores.append(before)
    row, block = merged(befores, length // 2)
    place = np.concatenate(suffixes)
    block_of = np.empty(len(data), np.int32)
    block_of[place] = block[row]
    least = np.full(int(block[-1]) + 1, LAST)
    order = np.argsort(block_of[inside], kind="stable")
    blocks, values = block_of[inside][order], at[np.repeat(np.arange(len(size)), size)[inside]][order]
    if len(blocks):
        head = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]]))
        least[blocks[head]] = np.minimum.reduceat(values, head)
    return least[block_of[inside]]


# -- jobs --


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches, one by one: a row holds a whole shard."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}


def _unpacked(row: dict) -> np.ndarray:
    return np.frombuffer(pa.decompress(row["data"].as_buffer(), row["size"].as_py(), "zstd"), np.uint8)


def _ints(column, kind) -> np.ndarray:
    return np.frombuffer(column.as_buffer(), kind) if column.is_valid else np.zeros(0, kind)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def shards(docs: DataFrame) -> DataFrame:
    """(shard, ids, digests, size, data): documents packed, their texts ended by END and compressed, as a table bucketed by shard."""

    def run(batches):
        for part in slices(batches, "text", SHARD_BYTES):
            texts = filled(part.column("text")).cast(pa.binary()).to_pylist()
            data = bytes([END]).join([*texts, b""])
            yield _batch(_PACKED, [(part.column("doc_id").to_pylist(), [hashlib.sha256(t).digest() for t in texts], len(data), pa.compress(data, "zstd", asbytes=True))])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = rows.mapInArrow(run, "ids array<bigint>, digests array<binary>, size bigint, data binary").withColumn("shard", F.monotonically_increasing_id())
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    # with fewer buckets than shuffle partitions, Spark would shuffle the table for a join
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    return bucketed(packed, "shard", files, "repeat-shards")


def copies(packed: DataFrame) -> DataFrame:
    """(shard, copies): the numbers of a shard's texts that equal one with a smaller doc_id."""
    each = packed.select("shard", F.posexplode(F.arrays_zip("ids", "digests")).alias("number", "d"))
    each = each.select("shard", "number", F.coalesce("d.ids", F.lit(LAST)).alias("at"), F.col("d.digests").alias("digest")).withColumn("place", F.xxhash64("shard", "number"))
    each = materialize(each, "repeat-digests")
    first = each.groupBy("digest").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last").drop("last")
    found = skew_safe_lookup(each, first, "digest", "place").where("at > first")
    return materialize(found.groupBy("shard").agg(F.collect_list("number").alias("copies")), "repeat-copies")  # of one shard


def _grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, the indices that have it)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    for a, b in zip(head, np.append(head[1:], len(keys))):
        yield int(ordered[a]), order[a:b]


_PACKED = pa.schema([("ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("size", pa.int64()), ("data", pa.binary())])
_ANCHORS = pa.schema([("range", pa.int64()), ("shard", pa.int64()), ("anchors", pa.binary()), ("counts", pa.binary())])
_KNOWN = pa.schema([("shard", pa.int64()), ("range", pa.int64()), ("often", pa.binary()), ("hot", pa.binary()), ("held", pa.int64())])


def _idents(anchor: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each anchor, and 32 bits of it below: anchors that share both are taken for one, which only lets more stretches pass."""
    with np.errstate(over="ignore"):
        return (anchor % np.uint64(ranges)) << np.uint64(32) | _stirred(anchor) >> np.uint64(32)


def _pressed(*columns: np.ndarray) -> tuple[list[int], bytes]:
    """(bytes of each column, all of them compressed)."""
    held = [c.tobytes() for c in columns]
    return [len(c) for c in held], pa.compress(b"".join(held), "zstd", asbytes=True)


def _unpressed(sizes, data, *kinds) -> list[np.ndarray]:
    sizes = sizes.as_py()
    held = pa.decompress(data.as_buffer(), sum(sizes), "zstd")
    return [np.frombuffer(held, kind, n // np.dtype(kind).itemsize, at) for kind, n, at in zip(kinds, sizes, np.cumsum([0, *sizes]))]


def _own_stretches(row: dict, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, strings, anchor, text) of the stretches of a shard's texts that are no copies."""
    start, count, anchor = stretches(data, length)
    text = np.searchsorted(np.flatnonzero(data == END), start)
    if not row["copies"].is_valid:
        return start, count, anchor, text
    own = np.ones(len(row["ids"]), bool)
    own[row["copies"].as_py()] = False
    own = own[text]
    return start[own], count[own], anchor[own], text[own]


def repeated_anchors(packed: DataFrame, length: int, ranges: int, hot: int) -> DataFrame:
    """(shard, range, often, hot, held): a bit for each anchor of a shard in a range, whether two documents or more hold it, and whether it is hot
    (null: none is); how many documents of the shard hold one."""

    def send(batches):
        for row in _rows(batches):
            _, _, anchor, text = _own_stretches(row, _unpacked(row), length)
            ident = _idents(anchor, ranges)
            order = np.argsort(ident, kind="stable")
            ident, text = ident[order], text[order]
            own = np.ones(len(ident), bool)  # once a document
            own[1:] = (ident[1:] != ident[:-1]) | (text[1:] != text[:-1])
            values, counts = np.unique(ident[own], return_counts=True)
            shard = row["shard"].as_py()
            yield _batch(_ANCHORS, [(k, shard, values[i].astype(np.uint32).tobytes(), counts[i].astype(np.int32).tobytes()) for k, i in _grouped(values >> np.uint64(32))])

    def meet(table: pa.Table) -> pa.Table:
        rows = list(zip(table["range"].to_pylist(), table["shard"].to_pylist(), table["anchors"], table["counts"]))
        values = np.concatenate([_ints(a, np.uint32) for *_, a, _ in rows])
        counts = np.concatenate([_ints(c, np.int32) for *_, c in rows]).astype(np.int64)
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        head = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        total = np.empty(len(values), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], head), np.diff(np.append(head, len(values))))
        out, at = [], 0
        for k, shard, a, _ in rows:
            some = slice(at, at := at + len(a.as_buffer()) // 4)
            often, warm = total[some] > 1, total[some] > hot
            if often.any():
                out.append((shard, k, np.packbits(often).tobytes(), np.packbits(warm).tobytes() if warm.any() else None, int(counts[some][often].sum())))
        return pa.Table.from_batches([_batch(_KNOWN, out)])

    sent = packed.select("shard", "ids", "size", "data", "copies").mapInArrow(send, "range bigint, shard bigint, anchors binary, counts binary")
    return sent.groupBy("range").applyInArrow(meet, "shard bigint, range bigint, often binary, hot binary, held bigint")


_STRINGS = pa.schema([("group", pa.int64()), ("shard", pa.int64()), ("first", pa.int64()), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])


def _candidates(row: dict, data: np.ndarray, length: int, ranges: int, buckets: int) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
    """(start, bucket key, bytes) of a shard's stretches with repeated anchors; those with hot ones come string by string."""
    start, count, key, _ = _own_stretches(row, data, length)
    ident = _idents(key, ranges)
    values = np.unique(ident)
    bits = lambda v, n: np.unpackbits(_ints(v, np.uint8), count=n).astype(bool) if v.is_valid else np.zeros(n, bool)
    often, warm = np.zeros(len(values), bool), np.zeros(len(values), bool)
    for k in row["known"]:
        a, b = np.searchsorted(values >> np.uint64(32), np.array([k["range"].as_py(), k["range"].as_py() + 1], np.uint64))
        often[a:b], warm[a:b] = bits(k["often"], b - a), bits(k["hot"], b - a)
    at = np.searchsorted(values, ident)
    kept = often[at]
    start, count, key, split = start[kept], count[kept], key[kept], warm[at[kept]]
    if split.any():
        _, single = _spread(start[split], count[split])
        _, flat = _parts_of(_cut(data, single, np.full(len(single), length)))
        hashes = gram_hashes(flat, length)[::length]
        start, count, key = (np.concatenate([x[~split], y]) for x, y in ((start, single), (count, np.ones(len(single), np.int64)), (key, hashes)))
    return start, _stirred(key) % np.uint64(buckets), _cut(data, start, count + length - 1).dictionary_encode()


def _numbers(bucket: np.ndarray, coded: pa.DictionaryArray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code of each stretch, group and bucket of each distinct one, its number by group and bucket)."""
    code = coded.indices.to_numpy(zero_copy_only=False)
    first_of = np.empty(len(coded.dictionary), np.int64)
    first_of[code[::-1]] = np.arange(len(code))[::-1]
    own = bucket[first_of]
    group = own % np.uint64(groups)
    number = np.empty(len(own), np.int64)
    number[np.lexsort((own, group))] = np.arange(len(own))
    return code, group, own, number


def candidate_strings(packed: DataFrame, length: int, ranges: int, buckets: int, groups: int) -> DataFrame:
    """Distinct stretches of each shard with repeated anchors, by group of buckets: group, shard, first (number of the first), and compressed
    their sizes, least ids, buckets and bytes."""

    def run(batches):
        for row in _rows(batches):
            data, shard = _unpacked(row), row["shard"].as_py()
            start, bucket, coded = _candidates(row, data, length, ranges, buckets)
            code, group, own, number = _numbers(bucket, coded, groups)
            ids = np.array([LAST if v is None else v for v in row["ids"].as_py()], np.int64)
            at = ids[np.searchsorted(np.flatnonzero(data == END), start)]
            order = np.argsort(code, kind="stable")
            least = np.minimum.reduceat(at[order], np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))) if len(order) else at
            by_number = np.argsort(number)
            rows = []
            for k, i in _grouped(group[by_number]):
                some = by_number[i]
                offsets, flat = _parts_of(coded.dictionary.take(pa.array(some)))
                rows.append((k, shard, int(i[0]), *_pressed(np.diff(offsets).astype(np.int32), least[some], own[some].astype(np.int32), flat)))
            yield _batch(_STRINGS, rows)

    rows = packed.where("known IS NOT NULL").select("shard", "ids", "size", "data", "copies", "known")
    return rows.mapInArrow(run, "group bigint, shard bigint, first bigint, sizes array<bigint>, data binary")


_LEAST = pa.schema([("shard", pa.int64()), ("first", pa.int64()), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])


def least_ids(strings: DataFrame, length: int) -> DataFrame:
    """(shard, first, and compressed runs, lengths, ids): for each string sent, the least doc_id that has the bytes at each of its places, as runs of places."""

    def meet(table: pa.Table) -> pa.Table:
        rows = list(zip(table["shard"].to_pylist(), table["first"].to_pylist(), table["sizes"], table["data"]))
        size, sent, bucket, flat = zip(*(_unpressed(*r[2:], np.int32, np.int64, np.int32, np.uint8) for r in rows))
        counts = [len(x) for x in size]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(size))]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(flat))]).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
        at, own = np.minimum.reduceat(np.concatenate(sent)[order], head), np.concatenate(bucket)[order[head]]
        places = np.diff(_parts_of(coded.dictionary)[0]) - length + 1
        offsets = np.concatenate([[0], np.cumsum(places)])
        least = np.empty(int(offsets[-1]), np.int64)
        for _, i in _grouped(own):  # bucket by bucket
            least[_spread(offsets[i], places[i])[1]] = least_sharing(coded.dictionary.take(pa.array(i)), at[i], length)[1]
        # runs of equal values inside each string
        new = np.concatenate([[True], least[1:] != least[:-1]])
        new[offsets[:-1]] = True
        at = np.flatnonzero(new)
        size, value = np.diff(np.append(at, len(least))), least[at]
        first_run = np.searchsorted(at, offsets)
        n_runs = np.diff(first_run)
        out, k = [], 0
        for (shard, first, *_), n in zip(rows, counts):
            mine = code[k : k + n]
            k += n
            _, runs = _spread(first_run[mine], n_runs[mine])
            out.append((shard, first, *_pressed(n_runs[mine].astype(np.int32), size[runs].astype(np.int32), value[runs])))
        return pa.Table.from_batches([_batch(_LEAST, out)])

    return strings.groupBy("group").applyInArrow(meet, "shard bigint, first bigint, sizes array<bigint>, data binary")


def removed_starts(row: dict, data: np.ndarray, ids: np.ndarray, ends: np.ndarray, length: int, ranges: int, buckets: int, groups: int) -> np.ndarray:
    """Whether the string at each place of a shard whose texts have these ends also starts in a document with a smaller id."""
    flag = np.zeros(int(ends[-1]) + 1, bool)
    for k in row["copies"].as_py() or ():
        flag[ends[k - 1] + 1 if k else 0 : max(0, ends[k] - length + 1)] = True
    if not row["found"].is_valid:
        return flag
    start, bucket, coded = _candidates(row, data, length, ranges, buckets)  # the same as were sent, in the same order
    code, *_, number = _numbers(bucket, coded, groups)
    number = number[code]
    found = sorted(((f["first"].as_py(), f) for f in row["found"]), key=lambda x: x[0])
    runs, lengths, least = zip(*(_unpressed(f["sizes"], f["data"], np.int32, np.int32, np.int64) for _, f in found))
    runs, lengths, least = np.concatenate(runs).astype(np.int64), np.concatenate(lengths).astype(np.int64), np.concatenate(least)
    first_run = np.cumsum(runs) - runs
    own, run = _spread(first_run[number], runs[number])
    before = np.cumsum(lengths) - lengths
    gone = least[run] < ids[np.searchsorted(ends, start[own])]
    own, run = own[gone], run[gone]
    _, at = _spread(start[own] + before[run] - before[first_run[number[own]]], lengths[run])
    flag[at] = True
    return flag


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (start and end of each removed run of bytes), kept (the other bytes).

    ``length`` is even, as symbols are taken by two, and 8 at least.
    """
    if length % 2 or length < 8:
        raise ValueError("length must be even and 8 at least")
    packed = shards(docs)
    packed = packed.join(copies(packed), "shard", "left")
    held = packed.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("shards")).first()
    ranges = max(1, -(-(held["size"] or 0) // RANGE_BYTES))
    known = materialize(repeated_anchors(packed, length, ranges, hot), "repeat-anchors")
    sent = (known.agg(F.sum("held")).first()[0] or 0) * 3 * length // 2
    buckets = max(1, -(-sent // BUCKET_BYTES))
    groups = max(1, min(buckets, max(-(-sent // GROUP_BYTES), sent // (ROW_BYTES * max(1, held["shards"])))))
    packed = packed.join(known.groupBy("shard").agg(F.collect_list(F.struct("range", "often", "hot")).alias("known")), "shard", "left")  # of one shard
    found = least_ids(candidate_strings(packed, length, ranges, buckets, groups), length)
    found = found.groupBy("shard").agg(F.collect_list(F.struct("first", "sizes", "data")).alias("found"))  # of one shard

    def run(batches):
        for row in _rows(batches):
            data = _unpacked(row)
            end = data == END
            ends = np.flatnonzero(end)
            ids = row["ids"].as_py()
            flag = removed_starts(row, data, np.array([LAST if v is None else v for v in ids], np.int64), ends, length, ranges, buckets, groups)
            total = np.cumsum(flag)
            gone = total > np.concatenate([np.zeros(min(length, len(data)), total.dtype), total[:-length]])
            keep = ~gone & ~end
            sizes = np.diff(np.concatenate([[-1], ends])) - 1
            starts = ends - sizes
            begin = np.flatnonzero(gone & ~np.concatenate([[False], gone[:-1]]))
            stop = np.flatnonzero(gone & ~np.concatenate([gone[1:], [False]])) + 1
            owner = np.searchsorted(ends, begin)
            spans = pa.StructArray.from_arrays([pa.array(begin - starts[owner]), pa.array(stop - starts[owner])], ["start", "end"])
            left = np.concatenate([[0], np.cumsum(np.add.reduceat(keep.astype(np.int64), starts))]).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(left), pa.py_buffer(data[keep])])
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), spans, kept], schema=_KEPT)

    return packed.select("shard", "ids", "size", "data", "copies", "known").join(found, "shard", "left").mapInArrow(run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")


def summary(kept: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``remove_repeats``."""
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
