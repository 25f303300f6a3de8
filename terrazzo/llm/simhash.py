"""SimHash near-duplicate classes by a segment-popcount embedding.

Fingerprints (64 bits, majority over the XXH64 of word shingles) are mapped to the bit counts of 32
segments of two bits. The Manhattan distance of two such count vectors never exceeds the Hamming
distance of their fingerprints. The vector is laid out in eight blocks of four segments: where the
Manhattan distance is at most ``8 - CHOSEN`` = 4, at least four blocks are equal, so a grid whose
cells are the count vectors of four blocks (one of 70 choices) holds every such pair in one cell.
Cells are read in sorted order; pairs of a cell whose embedding stays within the distance are
verified by the exact Hamming distance.

A cell yields links that connect what its exact links connect, not all its pairs: small cells
compare all pairs at once on arrays, larger ones grow classes from a frontier, whose members leave
the rest as soon as they are reached, so that a dense cell costs little more than its size. A cell
of more than ``CELL_ROWS`` fingerprints is dealt into blocks, and every pair of blocks is compared
in a task of its own. Links then join classes by min-label propagation with checkpoints.

Only distinct fingerprints take part; documents look their class up by (fingerprint, salt).

``keep_one`` takes all these steps, on the fingerprints of whole texts, and adds links to theirs: two documents also link where the Jaccard
similarity of their shingle sets is 0.8 or more, at which 64-bit fingerprints differ in about 10 bits, beyond what a grid
can hold. For those each document gets ``SAMPLES`` further fingerprints, each of the ``SAMPLE`` shingles that
come first in one random order (equal with probability 0.8 ** SAMPLE at that similarity; all of them
miss for 3 pairs in 1000), and the grid's cells are the segment counts of those. Pairs of a cell whose
sizes allow that similarity are verified by the shingle sets. In a cell of more than ``SET_ROWS`` documents all are first compared with one pivot:
its links join one class, and only pairs with a document outside it are compared further, in blocks.

Defined results: null and empty texts have fingerprint zero and link like any other; a null doc_id
never names a class (``component_id`` is null only if no doc_id is reachable); repeated rows share
their class; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from terrazzo.llm.common import SPACE_CLASS, filled, materialize, skew_safe_lookup, slices, unused
from terrazzo.llm.mixing import row_key

SEED = 42
MAX_BITS = 4
BLOCKS, CHOSEN = 8, 4
#: Fingerprints of one cell that one task compares.
CELL_ROWS = 4096
#: Largest cell whose pairs are compared as shifted arrays.
SMALL_CELL = 8

SIMILARITY = 0.8
#: Fingerprints of samples for each document, and the shingles in a sample.
SAMPLES, SAMPLE = 8, 3
#: Shingle sets that one task compares.
SET_ROWS = 1024

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACES = re.compile(f"[{SPACE_CLASS}]+".encode())


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of a text's ``words``-word shingles in order, repeats included; none without a word."""
    parts = [w for w in _SPACES.split(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if w]
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(joined[a:b], SEED) for a, b in zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist())), np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of ``h``; zero without any."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int) -> int:
    """Unsigned 64-bit fingerprint of a text's ``words``-word shingles, repeats included."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, row): fp holds the fingerprint's 64 bits as a signed long, row numbers the rows."""

    def run(batches):
        for part in slices(batches, "text"):
            fps = np.array([fingerprint(t, words) for t in filled(part.column("text")).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint").withColumn("row", F.monotonically_increasing_id())


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, packed two bits each into a 64-bit integer."""
    low = np.uint64(0x5555555555555555)
    return (fps & low) + ((fps >> np.uint64(1)) & low)


def _cells(batches):
    """Every fingerprint with the keys of its 70 grid cells: which four blocks, and their counts."""
    choices = list(itertools.combinations(range(BLOCKS), CHOSEN))
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        blocks = segment_counts(fp).view(np.uint8).reshape(-1, BLOCKS).astype(np.uint64)
        for c, chosen in enumerate(choices):
            key = np.full(len(fp), c, np.uint64)
            for b in chosen:
                key = (key << np.uint64(8)) | blocks[:, b]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["cell", "fp"])


def within_manhattan(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Whether the packed segment counts are within the Manhattan distance ``limit``, field by field.

    Fields hold 0, 1 or 2; their absolute differences are found on whole words.
    """
    low, high = np.uint64(0x5555555555555555), np.uint64(0xAAAAAAAAAAAAAAAA)
    a1, b1 = a & low, b & low
    a2, b2 = (a & high) >> np.uint64(1), (b & high) >> np.uint64(1)
    # |a-b|: 2 where one field is 2 and the other 0; 1 where exactly one field is 1
    ones = a1 ^ b1
    twos = (a2 ^ b2) & ~ones
    return np.bitwise_count(ones).astype(np.int16) + 2 * np.bitwise_count(twos).astype(np.int16) <= limit


def _near(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray, bits: int) -> np.ndarray:
    near = within_manhattan(ca, cb, bits)
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= bits
    return near


def connect(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (index pairs) that connect exactly the classes of fingerprints within ``bits``, at most n - 1."""
    counts = segment_counts(fp)
    rest = np.arange(len(fp))
    src, dst = [], []
    while len(rest):
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            i = frontier.pop()
            near = _near(np.broadcast_to(fp[i], len(rest)), fp[rest], np.broadcast_to(counts[i], len(rest)), counts[rest], bits)
            if near.any():
                found = rest[near]
                rest = rest[~near]
                src.append(np.full(len(found), i))
                dst.append(found)
                frontier.extend(found.tolist())
    return (np.concatenate(src), np.concatenate(dst)) if src else (np.zeros(0, np.int64),) * 2


def _links_of_sorted(bits: int, cell_rows: int):
    """Links of cells that arrive sorted; rows of too large cells come back with their cell, as links do with none."""

    def settle(cell: np.ndarray, fp: np.ndarray):
        """Rows of whole cells: (cell or None, a, b) arrays."""
        edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        sizes = np.diff(edges)
        keep = np.repeat(sizes > 1, sizes)
        cell, fp = cell[keep], fp[keep]
        sizes = sizes[sizes > 1]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        counts = segment_counts(fp)
        small = np.repeat(sizes <= SMALL_CELL, sizes)
        a, b = [], []
        for d in range(1, SMALL_CELL):
            i = np.flatnonzero((cell[d:] == cell[:-d]) & small[d:]) if len(cell) > d else np.zeros(0, np.int64)
            if not len(i):
                break
            near = _near(fp[i], fp[i + d], counts[i], counts[i + d], bits)
            a.append(fp[i[near]])
            b.append(fp[i[near] + d])
        for k in np.flatnonzero(sizes > SMALL_CELL):
            own = fp[edges[k] : edges[k + 1]]
            i, j = connect(own, bits)
            a.append(own[i])
            b.append(own[j])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
        return np.minimum(a, b), np.maximum(a, b)

    def batch_of(cell, a, b):
        return pa.RecordBatch.from_arrays([cell, pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["cell", "a", "b"])

    def links(cell, fp):
        pairs = np.unique(np.stack(settle(cell, fp), axis=1), axis=0)
        return batch_of(pa.nulls(len(pairs), pa.int64()), pairs[:, 0].copy(), pairs[:, 1].copy())

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows, spilling = 0, None
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            if spilling is not None:
                n = int(np.searchsorted(cell, spilling, side="right")) if cell[0] == spilling else 0
                if n:
                    yield batch_of(pa.array(cell[:n]), fp[:n], fp[:n])
                    cell, fp = cell[n:], fp[n:]
                if not len(cell):
                    continue
                spilling = None
            held.append((cell, fp))
            rows += len(cell)
            if rows < 50_000:
                continue
            cell, fp = (np.concatenate(x) for x in zip(*held))
            last = int(np.searchsorted(cell, cell[-1], side="left"))
            if last:
                yield from big_and_small(cell[:last], fp[:last])
            cell, fp = cell[last:], fp[last:]
            if len(cell) > cell_rows:
                spilling = cell[-1]
                yield batch_of(pa.array(cell), fp, fp)
                held, rows = [], 0
            else:
                held, rows = [(cell, fp)], len(cell)
        if rows:
            yield from big_and_small(*(np.concatenate(x) for x in zip(*held)))

    def big_and_small(cell, fp):
        edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        big = np.repeat(np.diff(edges) > cell_rows, np.diff(edges))
        if big.any():
            yield batch_of(pa.array(cell[big]), fp[big], fp[big])
            cell, fp = cell[~big], fp[~big]
        if len(cell):
            yield links(cell, fp)

    return run


def links(fps: DataFrame, bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b), a < b as unsigned: links that connect exactly the classes of the distinct fingerprints."""
    if bits > BLOCKS - CHOSEN:
        raise ValueError(f"the grid finds distances up to {BLOCKS - CHOSEN}")
    cells = fps.select("fp").mapInArrow(_cells, "cell bigint, fp bigint")
    read = _links_of_sorted(bits, cell_rows)
    found = materialize(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(read, "cell bigint, a bigint, b bigint"), "links")
    out = found.where("cell IS NULL").select("a", "b")
    large = found.where("cell IS NOT NULL").select("cell", F.col("a").alias("fp"))
    if not large.isEmpty():
        sizes = large.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) * 2 / F.lit(cell_rows)).cast("int").alias("_k"))
        mine = F.pmod(F.xxhash64("fp"), F.col("_k")).cast("int")
        dealt = large.join(sizes, "cell").withColumn("_c", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        dealt = dealt.select("cell", "fp", F.least("_c", "_o").alias("_i"), F.greatest("_c", "_o").alias("_j"))
        again = _links_of_sorted(bits, 1 << 62)
        block = F.xxhash64("cell", "_i", "_j")  # two blocks that share a hash are compared together, which loses nothing
        blocks = dealt.select(block.alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")
        out = out.unionByName(blocks.mapInArrow(again, "cell bigint, a bigint, b bigint").select("a", "b"))
    return out.where("a <> b").distinct()


def classes(nodes_links: DataFrame, rounds: int = 60) -> DataFrame:
    """(fp, root) of every linked node: the least of its class, by alternating large and small stars."""
    edges = materialize(nodes_links, "edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    for _ in range(rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m"))
        # large star: larger neighbours move to the least of the neighbourhood
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: the node and its smaller neighbours move to the least of them
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = materialize(small, "stars")
        # stable when every node has one smaller neighbour and no neighbour has one itself
        if small.groupBy("a").count().where("count > 1").isEmpty() and small.join(small.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            return small.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(small.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct())
        edges = small
    raise RuntimeError(f"classes did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    rows = materialize(fingerprints(docs, words), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = classes(links(nodes, bits))
    out = _labelled(rows, nodes, roots)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp, row) with component_id, from nodes (fp, first: its least doc_id) and the roots of linked ones."""
    rooted = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # the members of one class are distinct nodes; its root row is fetched by salted pairs
    labelled = skew_safe_lookup(rooted.select("fp", "root"), ids, "root", "fp").select("fp", "component_id")
    return skew_safe_lookup(rows, labelled, "fp", "row").drop("row")


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93)]


def sample_cells(h: np.ndarray) -> np.ndarray:
    """Grid cells of the distinct shingles ``h``: segment counts of the fingerprint of each min-wise sample."""
    if not len(h):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        turns = np.arange(1, SAMPLES + 1, dtype=np.uint64) * _ODD[0]
        order = (h[None, :] ^ turns[:, None]) * _ODD[1]
        order ^= order >> np.uint64(31)
        order *= _ODD[2]
        order ^= order >> np.uint64(32)
        first = np.argpartition(order, SAMPLE - 1, axis=1)[:, :SAMPLE] if len(h) > SAMPLE else np.tile(np.arange(len(h)), (SAMPLES, 1))
        bits = np.unpackbits(h[first].astype("<u8").view(np.uint8).reshape(SAMPLES, -1, 8), axis=2, bitorder="little").sum(axis=1)
        fps = np.packbits(2 * bits > first.shape[1], axis=1, bitorder="little").view("<u8").ravel()
        return segment_counts(fps) * _ODD[1] + turns


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, key, bits, fp, cells, shingles, row): key tells rows apart, bits is the fingerprint, fp digests the shingle set, shingles are its 32-bit hashes, sorted."""

    def run(batches):
        for part in slices(batches, "text"):
            columns: list[list] = [[], [], [], []]
            for text in filled(part.column("text")).to_pylist():
                every = shingle_hashes(text, words)
                h = np.unique(every)
                row = np.uint64(majority(every)).astype(np.int64), xxhash.xxh3_128_hexdigest(h.tobytes()), sample_cells(h).view(np.int64), np.unique((h >> np.uint64(32)).astype("<u4")).tobytes()
                for column, x in zip(columns, row):
                    column.append(x)
            kinds = pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "key", "bits", "fp", "cells", "shingles"])

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", row_key().alias("key"))
    return rows.mapInArrow(run, "doc_id bigint, key string, bits bigint, fp string, cells array<bigint>, shingles binary").withColumn("row", F.monotonically_increasing_id())


def _similar_to(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Whether the Jaccard similarity of the sorted set ``one`` to each of the others reaches ``similarity``."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    values = np.concatenate(others)
    found = one[np.minimum(np.searchsorted(one, values), len(one) - 1)] == values
    both = np.add.reduceat(found, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
    return both >= similarity * (len(one) + sizes - both) - 1e-9


def connect_sets(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (index pairs) that connect exactly the classes of similar sets, at most n - 1."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    rest, out = np.arange(len(sets)), []
    while len(rest):
        frontier, rest = [int(rest[0])], rest[1:]
        while frontier and len(rest):
            i = frontier.pop()
            near = np.minimum(sizes[i], sizes[rest]) >= similarity * np.maximum(sizes[i], sizes[rest]) - 1e-9
            if near.any():
                near[near] = _similar_to(sets[i], [sets[k] for k in rest[near]], similarity)
                found = rest[near].tolist()
                rest = rest[~near]
                out += [(i, k) for k in found]
                frontier += found
    return out


def _links_of_sets(similarity: float):
    """Links of groups (fp, shingles) that arrive sorted by group."""

    def settle(rows: list[tuple]):
        once = list({fp: (fp, shingles) for fp, shingles in rows}.values())
        sets = [np.frombuffer(x[1], "<u4") for x in once]
        for i, j in connect_sets(sets, similarity):
            yield min(once[i][0], once[j][0]), max(once[i][0], once[j][0])

    def run(batches):
        group, rows, out = None, [], []
        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("group", "fp", "shingles"))):
                if g != group:
                    out += settle(rows)
                    group, rows = g, []
                rows.append(row)
            yield _pairs(out)
            out = []
        yield _pairs(out + list(settle(rows)))

    return run


def _pairs(links_found: list[tuple[str, str]]) -> pa.RecordBatch:
    a, b = zip(*set(links_found)) if links_found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])


def _beside_pivot(similarity: float):
    """Members of large cells with ``linked``: whether they are similar to their cell's pivot."""

    def run(batches):
        for batch in batches:
            linked = []
            for s, p in zip(batch.column("shingles").to_pylist(), batch.column("pivot_shingles").to_pylist()):
                linked.append(bool(_similar_to(np.frombuffer(p, "<u4"), [np.frombuffer(s, "<u4")], similarity)[0]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cell", "fp", "pivot")), pa.array(linked)], ["cell", "fp", "pivot", "linked"])

    return run


def similar_links(rows: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, set_rows: int = SET_ROWS) -> DataFrame:
    """(a, b), a < b: links that connect exactly the classes of similar sets that share a cell."""
    members = materialize(rows.select("fp", F.explode("cells").alias("cell")).distinct(), "cell-members")
    shared = members.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(members.join(shared, "cell"), "shared-cells")
    wanted = members.select("fp").distinct().join(nodes, "fp").withColumnRenamed("first", "doc_id")
    held = rows.select("doc_id", "fp", "shingles").alias("r").join(wanted.alias("w"), F.expr("r.fp = w.fp AND r.doc_id <=> w.doc_id"))
    sets = materialize(held.select("r.fp", "shingles").dropDuplicates(["fp"]), "shingle-sets")

    compare = lambda groups: groups.join(sets, "fp").repartition("group").sortWithinPartitions("group").mapInArrow(_links_of_sets(similarity), "a string, b string")
    out = compare(members.where(f"n <= {set_rows}").select("fp", F.col("cell").alias("group")))
    large = members.where(f"n > {set_rows}")
    if not large.isEmpty():
        pivots = large.groupBy("cell").agg(F.min("fp").alias("pivot"))
        pivots = pivots.join(sets.select(F.col("fp").alias("pivot"), F.col("shingles").alias("pivot_shingles")), "pivot")
        beside = large.join(sets, "fp").join(pivots, "cell").mapInArrow(_beside_pivot(similarity), "cell bigint, fp string, pivot string, linked boolean")
        beside = materialize(beside, "beside-pivots")
        out = out.unionByName(beside.where("linked AND fp <> pivot").select(F.col("pivot").alias("a"), F.col("fp").alias("b")))
        # blocks of the documents outside the pivot's class meet each other, and each meets the blocks inside it
        k = lambda n: F.greatest(F.lit(1), F.ceil(2 * F.col(n) / F.lit(set_rows))).cast("int")
        sides = beside.groupBy("cell").agg(F.count_if("linked").alias("n_in"), F.count_if(~F.col("linked")).alias("n_out")).where("n_out > 0")
        dealt = beside.join(sides.select("cell", k("n_in").alias("k_in"), k("n_out").alias("k_out")), "cell")
        c = F.pmod(F.xxhash64("fp"), F.when(F.col("linked"), F.col("k_in")).otherwise(F.col("k_out"))).cast("int")
        inner = F.expr("transform(sequence(0, k_out - 1), o -> xxhash64(cell, 0, o, c))")
        outer = F.expr("concat(transform(sequence(0, k_in - 1), o -> xxhash64(cell, 0, c, o)), transform(sequence(0, k_out - 1), o -> xxhash64(cell, 1, least(o, c), greatest(o, c))))")
        dealt = dealt.withColumn("c", c).select("fp", F.explode(F.when(F.col("linked"), inner).otherwise(outer)).alias("group"))
        out = out.unionByName(compare(dealt))
    return out.distinct()


def fingerprint_links(rows: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: links of shingle sets (rows: fp, bits) that connect those of equal fingerprints, and those whose fingerprints differ in at most ``bits`` bits."""
    sets = materialize(rows.select("fp", "bits").distinct(), "set-fingerprints")
    first = materialize(sets.groupBy("bits").agg(F.min("fp").alias("first")), "distinct-fingerprints")
    equal = skew_safe_lookup(sets, first, "bits", "fp").where("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    of = lambda c: first.select(F.col("bits").alias(c), F.col("first").alias(f"_{c}"))
    near = links(first.select(F.col("bits").alias("fp")), bits).join(of("a"), "a").join(of("b"), "b").where("_a <> _b")
    return equal.unionByName(near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, set_rows: int = SET_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id (least doc_id of its class of similar shingle sets)."""
    rows = materialize(signatures(docs, words), "signatures")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-sets")
    roots = classes(similar_links(rows, nodes, similarity, set_rows))
    return _labelled(rows.select("doc_id", "fp", "row"), nodes, roots).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = SIMILARITY, set_rows: int = SET_ROWS, bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class of fingerprints within ``bits`` bits and of similar shingle sets: the one with the least doc_id.

    A row without a doc_id stays only if all of its class lack one; of rows that share the least doc_id, the
    least digest of id and text stays, and one of those that repeat both. Texts without a word are one class.
    """
    rows = materialize(signatures(docs, words), "signatures")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct(F.isnull("doc_id").alias("lacks"), "doc_id", "key")).alias("best")), "distinct-sets")
    roots = classes(fingerprint_links(rows, bits).unionByName(similar_links(rows, nodes.select("fp", "first"), similarity, set_rows)).distinct())
    rooted = nodes.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "best")
    own, key, n = unused(docs, "_own_key", "_key", "_n")
    keep = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.key").alias(key))
    copies = rows.groupBy(F.col("key").alias(key)).agg(F.count(F.lit(1)).alias(n))
    keep = materialize(keep.join(copies, key), "near-kept")
    keyed = docs.withColumn(own, row_key())
    of = lambda some: keyed.join(some, keyed[own] == some[key], "left_semi")
    several = keep.where(F.col(n) > 1)
    out = of(keep.where(F.col(n) == 1))
    return (out if several.isEmpty() else out.unionByName(of(several).dropDuplicates([own]))).drop(own)
