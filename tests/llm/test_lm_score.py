import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from terrazzo.llm import lm_score
from terrazzo.llm.words import word_ids

TEXTS = [" ".join(["left", f"mid{k % 7}", f"right{k % 7}"] * 3) for k in range(400)]


def known_words(texts, own=lm_score.OWN):
    """What ``common_words`` finds, counted here, with all counts known."""
    _, codes, ids = word_ids(pa.array(texts))
    n = np.bincount(codes, minlength=len(ids)).astype(np.float64)
    order = np.argsort(ids)
    words, n = ids[order], n[order]
    top = np.sort(np.lexsort((words, -n))[:own])
    leaf = len(top) + (words & (lm_score.ENDINGS - 1))
    leaf[top] = np.arange(len(top))
    rest = np.bincount(words & (lm_score.ENDINGS - 1), n, lm_score.ENDINGS)
    rest -= np.bincount(words[top] & (lm_score.ENDINGS - 1), n[top], lm_score.ENDINGS)
    return lm_score.Words(words, np.log(n), leaf, np.log(rest + 1), np.concatenate([n[top], rest]))


def coded(known, tree, texts):
    offsets, ids, *_ = lm_score.encode(known, pa.array(texts))
    return offsets, ids, *lm_score.neighbours(offsets, ids, tree.leaves)


def trained(tree, offsets, ids, padded, place, rounds=1):
    flat = lm_score.start(tree)
    for r in range(rounds):
        order = np.random.default_rng(r).permutation(len(ids))
        lm_score.train(flat, np.full(len(flat), 1e-4, np.float32), np.zeros(len(flat), np.float32), tree, ids[order], padded, place[order])
    return flat


def brute_log_prob(flat, tree, leaf, near):
    """Walks the path of one leaf, in plain Python."""
    w = lm_score.unpack(flat.astype(np.float64), tree.leaves)
    h = [math.tanh(w["shift"][0][d] + sum(w["near"][x][d] * w["place"][k][d] for k, x in enumerate(near))) for d in range(lm_score.DIM)]
    h[0] = 1.0
    path = [(k, t) for k, t in enumerate(tree.top[leaf]) if t]
    a = int(tree.first[leaf])
    path += [(int(tree.nodes[i]), tree.turns[i]) for i in range(a, a + int(tree.length[leaf]))]
    return sum(-math.log1p(math.exp(-t * sum(x * y for x, y in zip(h, w["node"][k])))) for k, t in path)


@pytest.mark.parametrize("rounds", [1, 2, 3, 5])
def test_rounds_train_on_every_position(rounds):
    lengths = [*range(20), 1000]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    every = np.concatenate([lm_score.masked(offsets, r, rounds) for r in range(rounds)])
    assert sorted(every.tolist()) == list(range(offsets[-1]))


def test_tree_starts_at_the_frequencies():
    counts = np.random.default_rng(0).integers(1, 5000, 300).astype(float)
    tree = lm_score.huffman(counts)
    ids = np.arange(300, dtype=np.uint16)
    offsets = np.arange(301)
    got = lm_score.log_probs(lm_score.start(tree), tree, ids, *lm_score.neighbours(offsets, ids, 300))
    assert np.allclose(got, np.log(counts / counts.sum()), atol=1e-4)
    depth = np.count_nonzero(tree.top, axis=1) + tree.length
    bits = -np.log2(counts / counts.sum())
    assert (bits * counts).sum() <= (depth * counts).sum() <= ((bits + 1) * counts).sum()


def test_log_probs_against_brute_force_and_sum_to_one():
    rng = np.random.default_rng(3)
    tree = lm_score.huffman(rng.integers(1, 900, 120).astype(float))
    flat = (lm_score.start(tree) + rng.normal(0, 0.7, (2 * tree.leaves + 2 * lm_score.SIDE + 1, lm_score.DIM))).astype(np.float32)
    offsets = np.array([0, 1, 3, 3, 40])
    ids = rng.integers(0, 120, 40).astype(np.uint16)
    padded, place = lm_score.neighbours(offsets, ids, tree.leaves)
    got = lm_score.log_probs(flat, tree, ids, padded, place, step=7)
    for i in range(40):
        doc = next(d for d in range(4) if offsets[d] <= i < offsets[d + 1])
        near = [int(ids[i + k]) if offsets[doc] <= i + k < offsets[doc + 1] else tree.leaves for k in (-2, -1, 1, 2)]
        assert math.isclose(got[i], brute_log_prob(flat, tree, int(ids[i]), near), rel_tol=1e-4, abs_tol=1e-4)
    near = padded[place[5] + np.array([-2, -1, 1, 2])]
    assert math.isclose(sum(math.exp(brute_log_prob(flat, tree, leaf, near)) for leaf in range(120)), 1, rel_tol=1e-6)


def test_gradients_against_differences(monkeypatch):
    rng = np.random.default_rng(4)
    tree = lm_score.huffman(rng.integers(1, 900, 90).astype(float))
    flat = lm_score.start(tree) + rng.normal(0, 0.5, (2 * tree.leaves + 2 * lm_score.SIDE + 1, lm_score.DIM))
    ids = rng.integers(0, 90, 50).astype(np.uint16)
    padded, place = lm_score.neighbours(np.array([0, 20, 50]), ids, tree.leaves)
    near = padded[place[:, None] + np.array([-2, -1, 1, 2])]
    total = lambda f: sum(brute_log_prob(f, tree, int(t), x) for t, x in zip(ids, near))
    want = np.zeros_like(flat)
    w = lm_score.unpack(want, tree.leaves)
    for name, rows, grad, _ in lm_score.gradients(lm_score.unpack(flat, tree.leaves), tree, ids, near):
        w[name][rows] += grad
    checked = [(int(r), int(d)) for r, d in zip(*np.nonzero(want))]
    assert len(checked) > 500
    for r, d in [checked[i] for i in rng.permutation(len(checked))[:60]] + [(len(flat) - 1, 2), (len(flat) - 3, 5)]:
        step = np.zeros_like(flat)
        step[r, d] = 1e-5
        assert math.isclose((total(flat + step) - total(flat - step)) / 2e-5, want[r, d], rel_tol=1e-3, abs_tol=1e-4)


def test_both_sides_are_learned():
    """A word that its two neighbours determine becomes likely."""
    known = known_words(TEXTS)
    tree = lm_score.huffman(known.counts)
    at = coded(known, tree, TEXTS)
    before, after = (lm_score.log_probs(f, tree, *at[1:]).mean() for f in (lm_score.start(tree), trained(tree, *at, rounds=40)))
    assert after > before + 1


@pytest.fixture(scope="module")
def halves(spark):
    """Half the documents of sf0.1 as learning table, the others coded, as they are and with their words shuffled."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").collect()]
    known = known_words(texts)
    tree = lm_score.huffman(known.counts)
    rows = [(bytearray(lm_score.encode(known, pa.array([t]))[1].tobytes()),) for t in texts[::2]]
    rng = np.random.default_rng(0)
    shuffled = coded(known, tree, [" ".join(rng.permutation(t.split())) for t in texts[1::2]])
    return spark.createDataFrame(rows, "ids binary").persist(), tree, coded(known, tree, texts[1::2]), shuffled


@pytest.mark.parametrize("partitions", [1, 8, 32])
def test_held_out_texts(halves, partitions):
    """However they are dealt, half the documents teach the model: of the others' words it knows far more than their frequencies, and less once they are shuffled."""
    encoded, tree, other, shuffled = halves
    flat = lm_score.fit(encoded.repartition(partitions), tree)
    plain, learned = (lm_score.log_probs(f, tree, *other[1:]).mean() for f in (lm_score.start(tree), flat))
    assert learned > plain + 1
    assert lm_score.log_probs(flat, tree, *shuffled[1:]).mean() < learned - 0.1


def test_short_texts_are_learned(spark):
    """On a table of texts of one to seven words the weights leave their start."""
    texts = [" ".join(f"w{k}" for k in range(1 + i % 7)) for i in range(70)]
    known = known_words(texts)
    tree = lm_score.huffman(known.counts)
    rows = [(bytearray(lm_score.encode(known, pa.array([t]))[1].tobytes()),) for t in texts]
    encoded = spark.createDataFrame(rows, "ids binary")
    assert not np.array_equal(lm_score.fit(encoded, tree), lm_score.start(tree))


def test_averages_are_weighted_by_use(spark):
    """Two tasks: a row that one of them trained has that task's value, one that neither did its start."""
    known = known_words(["a b c d e f"] * 3)
    tree = lm_score.huffman(known.counts)
    ids = [lm_score.encode(known, pa.array([t]))[1] for t in ("a b c a b c", "d e f d e f")]
    encoded = spark.createDataFrame([(bytearray(x.tobytes()),) for x in ids], "ids binary").repartitionByRange(2, "ids")
    got = lm_score.unpack(lm_score.fit(encoded, tree, rounds=1, positions=1), tree.leaves)["near"]
    for x in ids:
        flat = lm_score.start(tree)
        padded, place = lm_score.neighbours(np.array([0, 6]), x, tree.leaves)
        order = np.random.default_rng(0).permutation(6)
        lm_score.train(flat, np.full(len(flat), 1e-4, np.float32), np.zeros(len(flat), np.float32), tree, x[order], padded, place[order])
        assert np.allclose(got[np.unique(x)], lm_score.unpack(flat, tree.leaves)["near"][np.unique(x)], atol=1e-6)
    others = np.setdiff1d(np.arange(tree.leaves), np.concatenate(ids))
    assert np.array_equal(got[others], lm_score.unpack(lm_score.start(tree), tree.leaves)["near"][others])


@pytest.mark.parametrize("own, common", [(lm_score.OWN, lm_score.COMMON), (8, 20), (3, 5), (0, 0)])
def test_words_of_an_ending_share_its_probability(spark, docs, rows, monkeypatch, own, common):
    """Scores are of words: leaf, then the word's share of its leaf in all documents, whichever way the counts reach the tasks."""
    monkeypatch.setattr(lm_score, "OWN", own)
    monkeypatch.setattr(lm_score, "COMMON", common)
    held = {}
    fit = lm_score.fit
    monkeypatch.setattr(lm_score, "fit", lambda encoded, tree, rounds: held.setdefault("model", (fit(encoded, tree, rounds), tree))[0])
    text = {i: t or "" for i, t, _ in rows}
    more = [(5000, "zebra"), (5001, "zebra zebra yak"), (5001, "zebra zebra yak")]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    every = [t.split() for _, t in [*((i, t or "") for i, t, _ in rows), *more]]
    text |= dict(more)
    out = lm_score.pseudo_likelihood(table).collect()
    assert len(out) == len(every)

    flat, tree = held["model"]
    n = Counter(w for t in every for w in t)
    ident = {w: int(word_ids(pa.array([w]))[2][0]) for w in n}
    grade = {w: math.floor(math.log(k) / math.log(2) * 64) for w, k in n.items()}
    sent = 0
    for g in sorted(set(grade.values()), reverse=True):
        k = sum(v == g for v in grade.values())
        if sent + k > common:
            break
        sent += k
    often = sorted(n, key=lambda w: (-grade[w]))[:sent]
    of_own = sorted(sorted(often, key=lambda w: (-n[w], ident[w]))[:own], key=ident.get)
    leaf = {w: len(of_own) + ident[w] % lm_score.ENDINGS for w in n} | {w: k for k, w in enumerate(of_own)}
    total = Counter()
    for w, k in n.items():
        total[leaf[w]] += k
    for r in out:
        ws = text[r.doc_id].split()
        ids = np.array([leaf[w] for w in ws], np.uint16)
        value = lm_score.log_probs(flat, tree, ids, *lm_score.neighbours(np.array([0, len(ids)]), ids, tree.leaves)).sum()
        want = value + sum(math.log(n[w] / (total[leaf[w]] + 1)) for w in ws if leaf[w] >= len(of_own))
        assert math.isclose(r.log_prob, want, rel_tol=1e-4, abs_tol=1e-3)


def test_scoring_takes_no_slow_logarithm(monkeypatch):
    """log1p isn't vectorised and made most of the time of scoring: large and small odds are right without it."""
    tree = lm_score.huffman(np.arange(1, 101, dtype=float))
    flat = lm_score.start(tree)
    lm_score.unpack(flat, tree.leaves)["node"][:, 0] *= np.where(np.arange(99) % 3, 1, 60)
    ids = np.arange(100, dtype=np.uint16)
    want = [brute_log_prob(flat, tree, k, [100] * 4) for k in range(100)]
    monkeypatch.setattr(np, "log1p", None)
    got = lm_score.log_probs(flat, tree, ids, *lm_score.neighbours(np.arange(101), ids, tree.leaves))
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4)
