"""Repeated byte strings against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from terrazzo.llm import repeats
from terrazzo.session import ship

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def brute(rows, length):
    """For each row: (doc_id, bytes, removed, spans, digest of the rest)."""
    where = {}
    datas = [(t or "").encode() for _, t in rows]
    at = [2**63 - 1 if i is None else i for i, _ in rows]
    for i, d in zip(at, datas):
        for k in range(len(d) - length + 1):
            w = d[k : k + length]
            where[w] = min(i, where.get(w, i))
    out = []
    for (i, _), own, d in zip(rows, at, datas):
        gone = [False] * len(d)
        for k in range(len(d) - length + 1):
            if where[d[k : k + length]] < own:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    ship(spark)
    out = repeats.summary(repeats.remove_repeats(spark.createDataFrame(rows, SCHEMA), **options)).collect()
    return sorted(map(tuple, out), key=str)


def sample(n, seed):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeé €\n"), rng.integers(1, 7)))
    passages = [" ".join(word() for _ in range(rng.integers(2, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [passages[rng.integers(6)] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.integers(0, 30))) for _ in range(rng.integers(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 1, rows[4][1]), (n + 1, rows[4][1]), (None, rows[5][1]), (None, rows[5][1]), (7, None), (n + 2, ""), (n + 3, "ab" * 400), (n + 4, "x" * 500), (n + 5, "x" * 60), (n + 6, "ba" * 40)]
    rng.shuffle(rows)
    return [(None if i is None else int(i), t) for i, t in rows]


@pytest.mark.parametrize("length", [8, 20, 50])
@pytest.mark.parametrize("hot", [3, repeats.HOT])
def test_brute_force(spark, monkeypatch, length, hot):
    """Whatever the shards, buckets, parts and the share of anchors that count as hot."""
    monkeypatch.setattr(repeats, "PART_BYTES", 1500)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 20_000)
    rows = sample(120, length)
    assert found(spark, rows, length=length, hot=hot) == brute(rows, length)


def test_small_tables(spark):
    assert found(spark, []) == []
    rows = [(None, None), (1, ""), (2, "short")]
    assert found(spark, rows) == brute(rows, 50)
    rows = [(5, "y" * 50), (3, "y" * 50), (5, "y" * 49), (5, "y" * 51)]
    assert found(spark, rows) == brute(rows, 50)


def test_spans_and_columns(spark):
    text = "The same passage stands in both of these documents, word for word. "
    docs = spark.createDataFrame([(2, "é" + text + "end", "x", 1), (1, text, "y", 2)], "doc_id long, text string, spans string, shard int")
    out = {r.doc_id: r for r in repeats.remove_repeats(docs).collect()}
    assert [tuple(s) for s in out[2].spans] == [(2, 2 + len(text))]
    assert bytes(out[2].kept) == "éend".encode()
    assert out[1].spans == [] and bytes(out[1].kept) == text.encode()


def test_transforms_merge():
    """Merged transforms give the blocks that sorting all suffixes together gives."""
    rng = np.random.default_rng(4)
    texts = sorted({bytes(rng.choice([97, 98, 99], rng.integers(1, 40)).astype(np.uint8)) for _ in range(60)})
    parts = [texts[:20], texts[20:25], texts[25:]]
    suffixes, befores = [], []
    for some in parts:
        size = np.array([len(t) + 1 for t in some])
        data = np.frombuffer(b"".join(t + b"\xff" for t in some), np.uint8)
        order, before = repeats.transform(data, np.cumsum(size) - size, size)
        cycles = [t + b"\xff" for t in some]
        turn = [c[k:] + c[:k] for c in cycles for k in range(len(c))]
        suffixes += [turn[i] for i in order]
        befores.append(before)
        assert [(t * 30)[:200] for t in (turn[i] for i in order)] == sorted((t * 30)[:200] for t in turn)
    row, block = repeats.merged(befores, 5)
    place = np.empty(len(row), np.int64)
    place[row] = np.arange(len(row))
    heads = [(suffixes[i] * 10)[:10] for i in place]
    assert heads == sorted(heads)
    assert (np.diff(block) == [a != b for a, b in zip(heads, heads[1:])]).all()


def test_blocks_of_long_texts(spark):
    data = np.frombuffer(bytes(np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)), np.uint8)
    assert (repeats.anchors(data, 50, block=300) == repeats.anchors(data, 50)).all()


def test_whole_table(spark):
    """The smallest table against brute force."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert found(spark, rows) == brute(rows, 50)


def test_parts_of_a_bucket(monkeypatch):
    """Least ids by merged parts, whatever the size of the parts."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = sorted({bytes(rng.choice([97, 98], rng.integers(10, 30)).astype(np.uint8)) for _ in range(80)})
    ids = rng.permutation(len(texts))
    where = {}
    for t, i in zip(texts, ids):
        for k in range(len(t) - 9):
            where[t[k : k + 10]] = min(i, where.get(t[k : k + 10], i))
    for size in (1, 60, 500, 10**6):
        monkeypatch.setattr(repeats, "PART_BYTES", size)
        offsets, least = repeats.least_sharing(pa.array(texts, pa.binary()), ids, 10)
        assert least.tolist() == [where[t[k : k + 10]] for t in texts for k in range(len(t) - 9)]
        assert np.diff(offsets).tolist() == [len(t) - 9 for t in texts]


def test_only_strings_that_share_bytes_are_transformed(monkeypatch):
    """Of 400 random strings two share 50 bytes: only these two are sorted, and every place has its least id."""
    rng = np.random.default_rng(0)
    strings = [bytes(rng.integers(97, 123, 90, dtype=np.uint8)) for _ in range(400)]
    strings[7] = strings[300][20:80] + strings[7][60:]
    seen = []
    transform = repeats.transform
    monkeypatch.setattr(repeats, "transform", lambda data, *rest: seen.append(len(data)) or transform(data, *rest))
    at = np.arange(400)[::-1]
    offsets, least = repeats.least_sharing(pa.array(strings, pa.binary()), at, 50)
    want = np.repeat(at, 41)
    want[7 * 41 : 7 * 41 + 11] = at[300]
    assert offsets.tolist() == list(range(0, 401 * 41, 41)) and least.tolist() == want.tolist()
    assert sum(seen) == 182


def test_little_is_sent(spark, monkeypatch):
    """However many buckets there are, a shard sends few rows; stretches are written nowhere but to be sent, once, and of anchors bits come back."""
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 200)
    written, sent = {}, []
    write, least = repeats.materialize, repeats.least_ids
    monkeypatch.setattr(repeats, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    monkeypatch.setattr(repeats, "least_ids", lambda strings, length: sent.append(strings) or least(strings, length))
    rows = sample(60, 5)
    assert found(spark, rows) == brute(rows, 50)
    assert set(written) == {"repeat-digests", "repeat-copies", "repeat-anchors"}
    by_shard = sent[0].groupBy("shard").count().collect()
    assert by_shard and max(r["count"] for r in by_shard) <= 4
    known = written["repeat-anchors"].collect()
    assert sum(len(r.often) for r in known) < sum(r.held for r in known)  # bytes, for all anchors of the shards
