"""Masked pseudo-likelihood scores of documents.

A bidirectional window network predicts each word from the ``SIDE`` words on either side of it: the
neighbours' vectors, each scaled by its place, are added up and squashed, and a hierarchical softmax,
a Huffman tree with a vector per node, gives the probability of the word's leaf. The ``OWN`` most
frequent words have a leaf each; all other words share the leaf of their ending (a hash of their last
two bytes), in which a word has the probability n / (N + 1), n being its and N the leaf's occurrences in
all documents; the rest, 1 / (N + 1), is the share of words that no document has. So every distinct
word has a probability of its own; words are told apart by 64-bit ids. A document's score is the
sum of the conditional log-probabilities of all its words.

The nodes start at the frequencies of their sides, so the network starts as the model of plain word
frequencies and learns from there. Training is data-parallel: from common weights, each task runs
stochastic gradient descent in numpy over masked positions (one in as many as there are rounds, another
set each round, so that every position of every document is trained on once) of its share of the
documents. Spark adds the tasks' vectors up as a tree, each vector weighted by how often the task
trained it. Tasks are as many as the positions call for, ``TASK_POSITIONS`` each or more, however the documents are
dealt over partitions, so that each task learns what one task learns from that many, and more documents add
tasks and not shorter ones. The network has a fixed size; the vocabulary's counts grow with the corpus and stay in
Spark: only the counts of the most frequent words (``COMMON`` of them at most) are sent to the tasks,
those of others reach their documents by a join.

Defined results: a null or empty text has 0 tokens, log_prob 0 and a null mean; rows repeated with
their doc_id are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terrazzo.llm.common import filled, materialize, slices
from terrazzo.llm.words import ENDING_BITS, sums, word_ids

SIDE = 2
DIM = 8
ROUNDS = 4
BATCH, RATE = 2048, 0.05
#: Positions that a training task has at least, on average: with fewer, a task's share of the steps is too short to learn from.
TASK_POSITIONS = 1 << 21
#: Words with a leaf of their own, and leaves of endings.
OWN, ENDINGS = 7 << 12, 1 << ENDING_BITS
#: Words whose counts the tasks know.
COMMON = 1 << 17
#: Nodes near the root, computed for all positions at once.
TOP = 32
#: Weight rows that travel as one, and the partial means of each such block.
BLOCK, PARTS = 1024, 64

_REACH = np.array([k for k in range(-SIDE, SIDE + 1) if k])
_LOG2 = np.log(np.float32(2))


@dataclass(frozen=True)
class Tree:
    """Paths from the root to each leaf: turns (1 right, -1 left, 0 not on the path) at the top nodes, then ragged (node, turn)."""

    top: np.ndarray
    first: np.ndarray
    length: np.ndarray
    nodes: np.ndarray
    turns: np.ndarray
    start: np.ndarray  # log odds of a right turn by frequency

    @property
    def leaves(self) -> int:
        return len(self.first)


def huffman(counts: np.ndarray) -> Tree:
    """The Huffman tree of leaves with these counts (at least two); nodes are numbered by falling count."""
    m = len(counts)
    weight = np.concatenate([np.maximum(counts, 0.5), np.zeros(m - 1)])
    order = np.argsort(weight[:m], kind="stable")
    parent, turn = np.zeros(2 * m - 1, np.int64), np.zeros(2 * m - 1, np.float32)
    start = np.zeros(m - 1)
    leaf, node = 0, m
    for k in range(m, 2 * m - 1):
        pair = []
        for _ in range(2):
            if leaf < m and (node >= k or weight[order[leaf]] <= weight[node]):
                pair.append(order[leaf])
                leaf += 1
            else:
                pair.append(node)
                node += 1
        left, right = pair
        parent[left] = parent[right] = k
        turn[left], turn[right] = -1, 1
        weight[k] = weight[left] + weight[right]
        start[k - m] = np.log(weight[right] / weight[left])
    rank = np.empty(m - 1, np.int64)
    rank[np.argsort(-weight[m:], kind="stable")] = np.arange(m - 1)
    owners, nodes, turns, at, owner = [], [], [], np.arange(m), np.arange(m)
    while len(at):
        owners.append(owner)
        nodes.append(rank[parent[at] - m])
        turns.append(turn[at])
        at = parent[at]
        owner, at = owner[at < 2 * m - 2], at[at < 2 * m - 2]
    owner, node, way = (np.concatenate(x) for x in (owners, nodes, turns))
    top = np.zeros((m, min(TOP, m - 1)), np.float32)
    near = node < top.shape[1]
    top[owner[near], node[near]] = way[near]
    order = np.flatnonzero(~near)[np.argsort(owner[~near], kind="stable")]
    length = np.bincount(owner[~near], minlength=m)
    by_rank = np.empty(m - 1, np.float32)
    by_rank[rank] = start
    return Tree(top, np.cumsum(length) - length, length, node[order].astype(np.uint16), way[order], by_rank)


def unpack(flat: np.ndarray, leaves: int) -> dict[str, np.ndarray]:
    """Views of a weight matrix: neighbours' vectors (the last beyond a text's ends), nodes, places, shift."""
    cut = np.cumsum([0, leaves + 1, leaves - 1, 2 * SIDE, 1])
    return {name: flat[a:b] for name, a, b in zip(("near", "node", "place", "shift"), cut, cut[1:])}


def start(tree: Tree, seed: int = 11) -> np.ndarray:
    """Weights of the model of plain frequencies; the first hidden unit is 1, so a node's first weight is its bias."""
    flat = np.zeros((2 * tree.leaves + 2 * SIDE + 1, DIM), np.float32)
    w = unpack(flat, tree.leaves)
    w["near"][:] = np.random.default_rng(seed).normal(0, 0.1, w["near"].shape)
    w["node"][:, 0] = tree.start
    w["place"][:] = 1
    return flat


def neighbours(offsets: np.ndarray, ids: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """(padded, place): padded[place[i] + k] is the leaf k places from token i, ``leaves`` beyond its text."""
    place = np.arange(len(ids)) + SIDE * (np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)) + 1)
    padded = np.full(len(ids) + SIDE * len(offsets), leaves, np.uint16)
    padded[place] = ids
    return padded, place


def _hidden(w: dict[str, np.ndarray], near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    vectors = w["near"].take(near, axis=0)
    out = np.einsum("ikd,kd->id", vectors, w["place"])
    out += w["shift"]
    np.tanh(out, out=out)
    out[:, 0] = 1
    return vectors, out


def _further(tree: Tree, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes below the top on the paths to these leaves: (position of each, node, turn, start and length by position)."""
    length = tree.length[ids]
    end = np.cumsum(length)
    owner = np.repeat(np.arange(len(ids)), length)
    at = np.arange(len(owner)) + (tree.first[ids] - (end - length))[owner]
    return owner, tree.nodes.take(at), tree.turns.take(at), end - length, length


def log_probs(flat: np.ndarray, tree: Tree, ids: np.ndarray, padded: np.ndarray, place: np.ndarray, step: int = 4096) -> np.ndarray:
    """Log-probability of the leaf of each position given its neighbours."""
    w, out = unpack(flat, tree.leaves), np.zeros(len(ids))
    off = _LOG2 * (tree.top.shape[1] - np.count_nonzero(tree.top, axis=1))
    softplus = lambda x: np.log(np.add(np.exp(np.minimum(x, 80, out=x), out=x), 1, out=x), out=x)  # noqa: E731  below 1e-7 it is 0
    with np.errstate(over="ignore"):
        for at in range(0, len(ids), step):
            t = ids[at : at + step]
            _, h = _hidden(w, padded[place[at : at + step, None] + _REACH])
            top = tree.top.take(t, axis=0)
            z = h @ -w["node"][: top.shape[1]].T
            z *= top
            loss = softplus(z).sum(axis=1) - off[t]  # off the path: log 2
            owner, nodes, turns, _, _ = _further(tree, t)
            y = np.einsum("ij,ij->i", h.take(owner, axis=0), w["node"].take(nodes, axis=0))
            y *= -turns
            loss += np.bincount(owner, softplus(y), minlength=len(t))
            out[at : at + step] = -loss
    return out


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, sums of their values, how many)."""
    if not len(rows):
        return rows, values, np.zeros(0, np.float32)
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    return ordered[first], np.add.reduceat(values.take(order, axis=0), first, axis=0), np.diff(np.append(first, len(ordered))).astype(np.float32)


def gradients(w: dict[str, np.ndarray], tree: Tree, ids: np.ndarray, near: np.ndarray):
    """(name, rows, gradient of the summed log-probability, positions that use the row) of every weight these positions use."""
    vectors, h = _hidden(w, near)
    top = tree.top.take(ids, axis=0)
    k = top.shape[1]
    z = h @ w["node"][:k].T
    z *= top
    np.exp(z, out=z)
    z += 1
    np.divide(top, z, out=z)  # turn * P(other turn); 0 off the path
    back = z @ w["node"][:k]
    owner, nodes, turns, first, length = _further(tree, ids)
    seen, below = h.take(owner, axis=0), w["node"].take(nodes, axis=0)
    y = np.einsum("ij,ij->i", seen, below)
    y *= turns
    np.exp(y, out=y)
    y += 1
    np.divide(turns, y, out=y)
    below *= y[:, None]
    deep = length > 0
    if deep.any():
        back[deep] += np.add.reduceat(below, first[deep], axis=0)
    seen *= y[:, None]
    slope = h * h
    np.subtract(1, slope, out=slope)
    back *= slope
    back[:, 0] = 0
    yield "node", slice(0, k), z.T @ h, np.count_nonzero(top, axis=0).astype(np.float32)
    yield "node", *_by_row(nodes, seen)
    yield "place", slice(None), np.einsum("ikd,id->kd", vectors, back), np.full(2 * SIDE, len(ids), np.float32)
    yield "shift", slice(None), back.sum(axis=0, keepdims=True), np.full(1, len(ids), np.float32)
    np.multiply(back[:, None, :], w["place"], out=vectors)
    yield "near", *_by_row(near.ravel(), vectors.reshape(-1, DIM))


def train(flat: np.ndarray, squares: np.ndarray, used: np.ndarray, tree: Tree, ids: np.ndarray, padded: np.ndarray, place: np.ndarray) -> None:
    """One pass of Adagrad steps, one rate a row, over these positions; ``used`` counts them by row."""
    w, q, n = (unpack(x, tree.leaves) for x in (flat, squares, used))
    with np.errstate(over="ignore"):
        for at in range(0, len(ids), BATCH):
            near = padded[place[at : at + BATCH, None] + _REACH]
            for name, rows, grad, count in list(gradients(w, tree, ids[at : at + BATCH], near)):
                grad /= np.maximum(count, 1)[:, None]
                square = q[name][rows] + np.einsum("ij,ij->i", grad, grad) / DIM
                q[name][rows] = square
                grad *= (RATE / np.sqrt(square))[:, None]
                w[name][rows] += grad
                n[name][rows] += count


def masked(offsets: np.ndarray, r: int, rounds: int) -> np.ndarray:
    """Positions that round ``r`` trains on, one in ``rounds`` of every text: together the rounds have every position once."""
    size = np.diff(offsets)
    first = (r - size) % rounds
    held = np.maximum(0, -(-(size - first) // rounds))
    return np.repeat(offsets[:-1] + first - rounds * (np.cumsum(held) - held), held) + rounds * np.arange(held.sum())


_BLOCKS = "block int, mean binary, used binary"


def _added(rows: DataFrame, *by: str) -> DataFrame:
    """Blocks of weights, one row each, dealt by these columns and added up as they stream in."""

    def run(batches):
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for block, mean, used in zip(*(batch.column(c).to_pylist() for c in ("block", "mean", "used"))):
                n = np.frombuffer(used)
                sums = np.frombuffer(mean, np.float32).reshape(-1, DIM) * n[:, None]
                old = total.get(block)
                total[block] = [old[0] + sums, old[1] + n] if old else [sums, n]
        if total:
            means = [(sums / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes() for sums, n in total.values()]
            columns = [pa.array(list(total), pa.int32()), pa.array(means, pa.binary()), pa.array([n.tobytes() for _, n in total.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "mean", "used"])

    return rows.repartition(*by).select("block", "mean", "used").mapInArrow(run, _BLOCKS)


def fit(encoded: DataFrame, tree: Tree, rounds: int = ROUNDS, positions: int = TASK_POSITIONS) -> np.ndarray:
    """Weights after ``rounds`` of local training and averaging over all documents (column ``ids``: leaves as 16-bit integers), ``positions`` or more a task."""
    context = encoded.sparkSession.sparkContext
    size = encoded.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    dealt = encoded.select("ids").coalesce(max(1, size // 2 // positions))  # partitions joined, none split, nothing shuffled
    flat = start(tree)
    for r in range(rounds):
        shared = context.broadcast((flat, tree))

        def run(batches, r=r, shared=shared):
            common, tree = shared.value
            own, squares, used = common.copy(), np.full(len(common), 1e-4, np.float32), np.zeros(len(common), np.float32)
            for part in slices(batches, "ids", 1_000_000):
                offsets, ids = leaves_of(part.column("ids"))
                padded, place = neighbours(offsets, ids, tree.leaves)
                chosen = np.random.default_rng(r).permutation(masked(offsets, r, rounds))
                train(own, squares, used, tree, ids[chosen], padded, place[chosen])
            if used.any():
                n, at = used.astype(np.float64), range(0, len(own), BLOCK)
                columns = pa.array(range(len(at)), pa.int32()), pa.array([own[i : i + BLOCK].tobytes() for i in at], pa.binary()), pa.array([n[i : i + BLOCK].tobytes() for i in at], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns), ["block", "mean", "used"])

        rows = dealt.mapInArrow(run, _BLOCKS).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
        flat = flat.copy()
        for row in _added(_added(rows, "block", "part"), "block").collect():  # blocks of one network, whatever the input
            n = np.frombuffer(row.used)
            mine = np.flatnonzero(n)
            flat[row.block * BLOCK + mine] = np.frombuffer(row.mean, np.float32).reshape(-1, DIM)[mine]
    return flat


def leaves_of(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, leaves) of documents whose leaves are held as 16-bit integers."""
    blobs = pa.concat_arrays([blobs.cast(pa.binary())])
    ends = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, blobs.offset * 4).astype(np.int64)
    size = int(ends[-1] - ends[0])
    ids = np.frombuffer(blobs.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint16) if size else np.zeros(0, np.uint16)
    return (ends - ends[0]) // 2, ids


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the id of each distinct word and its occurrences in all documents."""

    def run(batches):
        for part in slices(batches, "text"):
            _, codes, words = word_ids(filled(part.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.bincount(codes, minlength=len(words)))], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


#: The size of a count, in 64ths of a power of two: the counts of at most COMMON words lie above a bound on it.
_GRADE = "floor(log2(n) * 64)"


@dataclass(frozen=True)
class Words:
    """What tasks know of the vocabulary: ``words`` (ids, sorted), log_n of each, leaf of each, log(N + 1) by ending, leaf counts."""

    words: np.ndarray
    log_n: np.ndarray
    leaf: np.ndarray
    log_rest: np.ndarray
    counts: np.ndarray


def common_words(counts: DataFrame, own: int, common: int) -> tuple[Words, int]:
    """The most frequent words (at most ``common``) with their leaves, and the grade from which counts are sent."""
    grades = sorted(((r.grade, r.k) for r in counts.groupBy(F.expr(_GRADE).alias("grade")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    held, bound = 0, 1 << 40
    for grade, k in grades:  # a few thousand grades at most
        if held + k > common:
            break
        held, bound = held + k, grade
    often = counts.where(f"{_GRADE} >= {bound}").sort("word").toArrow()
    words, n = often["word"].to_numpy(), often["n"].to_numpy().astype(np.float64)
    top = np.sort(np.lexsort((words, -n))[:own])
    leaf = len(top) + (words & (ENDINGS - 1))
    leaf[top] = np.arange(len(top))
    rest = np.zeros(ENDINGS)
    for row in counts.groupBy(F.col("word").bitwiseAND(F.lit(ENDINGS - 1)).alias("e")).agg(F.sum("n").alias("n")).collect():
        rest[row.e] = row.n
    np.subtract.at(rest, words[top] & (ENDINGS - 1), n[top])
    return Words(words, np.log(n), leaf, np.log(rest + 1), np.concatenate([n[top], rest])), bound


def encode(known: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, leaves, log share of each token in its leaf as far as known, whether its count is not, word ids)."""
    offsets, codes, ids = word_ids(texts)
    own = len(known.counts) - ENDINGS
    ending = ids & (ENDINGS - 1)
    leaf, share, rare = own + ending, -known.log_rest[ending], np.ones(len(ids), bool)
    if len(known.words) and len(ids):
        at = np.minimum(np.searchsorted(known.words, ids), len(known.words) - 1)
        hit = known.words[at] == ids
        rare = ~hit
        leaf[hit] = known.leaf[at[hit]]
        share[hit] += known.log_n[at[hit]]
        share[leaf < own] = 0
    return offsets, leaf.astype(np.uint16)[codes], share[codes], rare[codes], ids[codes]


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, log_prob (sum over all tokens), mean_log_prob."""
    context = docs.sparkSession.sparkContext
    counts = materialize(vocabulary(docs), "vocabulary")
    known, bound = common_words(counts, OWN, COMMON)
    tree = huffman(known.counts)
    words = context.broadcast(known)

    def code(batches):
        for part in slices(batches, "text", 4_000_000):
            offsets, ids, share, rare, hashes = encode(words.value, filled(part.column("text")))
            blobs = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((2 * offsets).astype(np.int32)), pa.py_buffer(ids)])
            unknown = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rare)])[offsets].astype(np.int32)), pa.array(hashes[rare]))
            columns = part.column("doc_id"), pa.array(np.diff(offsets)), blobs, pa.array(sums(share, offsets)), unknown
            yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "n_tokens", "ids", "share", "rare"])

    coded = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(code, "doc_id bigint, n_tokens bigint, ids binary, share double, rare array<bigint>")
    coded = materialize(coded.withColumn("row", F.monotonically_increasing_id()), "leaves")
    model = context.broadcast((fit(coded, tree, rounds), tree))

    def score(batches):
        flat, tree = model.value
        for part in slices(batches, "ids", 1_000_000):
            offsets, ids = leaves_of(part.column("ids"))
            value = log_probs(flat, tree, ids, *neighbours(offsets, ids, tree.leaves))
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("n_tokens"), pa.array(sums(value, offsets) + part.column("share").to_numpy())], ["row", "doc_id", "n_tokens", "log_prob"])

    out = coded.select("row", "doc_id", "n_tokens", "ids", "share").mapInArrow(score, "row bigint, doc_id bigint, n_tokens bigint, log_prob double")
    # the counts of rarer words come by a join; words that occur once add log 1
    rare = coded.select("row", F.explode("rare").alias("word")).join(counts.where(f"n > 1 AND {_GRADE} < {bound}"), "word")
    more = rare.groupBy(F.col("row").alias("_row")).agg(F.sum(F.log("n")).alias("more"))
    out = out.join(more, F.col("row") == F.col("_row"), "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))
