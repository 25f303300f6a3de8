import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terrazzo.llm import exact_dedup, simhash


def weak_digest(text):
    """Many texts share one of three digests."""
    return F.pmod(F.length(text), F.lit(3)).cast("string")


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, weak_digest])
def test_exact_groups(docs, rows, digest):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = Counter((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t, _ in rows)
    got = exact_dedup.decide(docs, digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    if digest is exact_dedup.sha256_digest:
        text = {i: t or "" for i, t, _ in rows}
        assert all(r.text_digest == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in got)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, weak_digest])
def test_exact_dedup_keeps_one_row(docs, rows, digest):
    out = exact_dedup.deduplicate(docs, digest)
    assert out.columns == docs.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for _, t, _ in rows})


def reference_fingerprint(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("k", [4, 5])
def test_simhash_components(docs, rows, k):
    fps = [reference_fingerprint(t, k) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    want = Counter((r[0], f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, k).collect()) == want


def brute_classes(fps, bits):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= bits:
                root[find(a)] = find(b)
    out = defaultdict(set)
    for f in fps:
        out[find(f)].add(f)
    return {frozenset(s) for s in out.values() if len(s) > 1}


@pytest.mark.parametrize("cell_rows", [4096, 16])
def test_links_of_random_and_dense_fingerprints(spark, cell_rows):
    """Chains at the limit, a dense ball, and noise; small cells force the blocks of large ones."""
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 2**63, 150)]
    chain = fps[0]
    for _ in range(20):
        for b in rng.choice(64, 4, replace=False):
            chain ^= 1 << int(b)
        fps.append(chain)
    fps += [fps[1] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (120, 2)) if a != b]
    fps = sorted(set(fps))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    found = simhash.classes(simhash.links(df, cell_rows=cell_rows)).collect()
    out = defaultdict(set)
    for r in found:
        out[r.root].add(r.fp & (2**64 - 1))
    assert {frozenset(s) for s in out.values()} == brute_classes(fps, 4)


def test_manhattan_bounds_hamming():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 2**63, 500, dtype=np.uint64) for _ in "ab")
    counts = lambda x: [[bin(int(v) >> s & 3).count("1") for s in range(0, 64, 2)] for v in x]
    l1 = np.abs(np.array(counts(a)) - np.array(counts(b))).sum(axis=1)
    for limit in (10, 16, 24):
        assert (simhash.within_manhattan(simhash.segment_counts(a), simhash.segment_counts(b), limit) == (l1 <= limit)).all()
    assert (l1 <= np.bitwise_count(a ^ b)).all()


def edited_texts():
    """Groups of texts with 0 to 8 words changed, a chain of growing edits, short texts, repeated and empty ones."""
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [" ".join(fresh(rng.randint(1, 60))) for _ in range(40)]
    for _ in range(12):
        base = fresh(rng.randint(30, 160))
        for _ in range(8):
            own = list(base)
            for k in rng.sample(range(len(own)), rng.randint(0, 8)):
                own[k] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    chain = fresh(120)
    for k in range(15):
        chain[7 * k : 7 * k + 2] = fresh(2)
        texts.append(" ".join(chain))
    crowd = fresh(40)
    texts += [" ".join([*crowd, f"copy{k}"]) for k in range(60)] + ["", " \n ", None]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("set_rows", [1024, 6])
def test_similar_classes_against_all_pairs(spark, set_rows):
    """Classes equal those of all similar pairs that share a cell, and next to all similar pairs share one."""
    rows = edited_texts()
    hashes = [np.unique(simhash.shingle_hashes(t or "", 5)) for _, t in rows]
    sets, cells = [set(h.tolist()) for h in hashes], [set(simhash.sample_cells(h).tolist()) for h in hashes]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    similar = shared = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                similar += 1
                if sets[i] == sets[j] or cells[i] & cells[j]:
                    shared += 1
                    root[max(find(i), find(j))] = min(find(i), find(j))
    assert shared >= 0.99 * similar > 0
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(df, set_rows=set_rows).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_near_copies_of_documents(spark):
    """On the driver's documents: every class lies in one of all similar pairs, and at least 0.99 of the similar pairs are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text or "", 5).tolist()) for r in docs.collect()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for h in s:
            holders[h].append(i)
    common = Counter()
    for ids in holders.values():
        if len(ids) > 1:
            common.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    similar = [(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    unequal = [(a, b) for a, b in similar if sets[a] != sets[b]]
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in similar:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(docs).collect()}
    assert all(find(i) == find(c) for i, c in got.items() if sets[i])
    assert len(unequal) > 100
    for pairs in (similar, unequal):
        assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)


def test_hot_rows_without_or_with_one_id(spark):
    """A third of all rows lack an id, another third share one; texts repeat among them."""
    rows = [(None, f"text {i % 3}") for i in range(300)] + [(7, f"text {i % 5}") for i in range(300)] + [(1000 + i, f"text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = Counter((i, max((x for x in groups[t] if x is not None), default=None), len(groups[t])) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.decide(docs).collect()) == want
    assert simhash.near_duplicates(docs).count() == len(rows)


def test_keep_one(docs):
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    classes = {r.component_id for r in simhash.similar_classes(docs).collect()}
    assert {r.doc_id for r in out.select("doc_id").collect()} == classes


def test_keep_one_links_fingerprints(spark):
    """Texts of few shingles whose fingerprints are near: one stays, though their shingle sets are not similar; of all classes by fingerprint one row or less stays."""
    rng = random.Random(3)
    texts = [" ".join([base, *([tail] * n)]) for base, tail in ((" ".join(rng.choices("abcdefghij", k=9)), "z") for _ in range(6)) for n in (60, 61, 90)]
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(20)]
    # the same words in the middle, others around it: less than 0.8 of the shingles are common, most of the occurrences are
    texts += [" ".join([*(f"{c}{k}" for k in range(6)), *(["y"] * 300)]) for c in "pq"]
    rows = list(enumerate(texts))
    fps = [reference_fingerprint(t, 5) for _, t in rows]
    assert bin(fps[-1] ^ fps[-2]).count("1") <= 4
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows[-2:]]
    assert len(sets[0] & sets[1]) < 0.8 * len(sets[0] | sets[1])
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for some in brute_classes(fps, 4):
        assert len(kept & {i for i, f in enumerate(fps) if f in some}) <= 1
    assert len(kept & {len(rows) - 2, len(rows) - 1}) == 1


def test_empty_tables(empty):
    assert exact_dedup.decide(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
