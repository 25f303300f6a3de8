"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from terrazzo.llm import resampling


def grams(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, longest, buckets, share, min_words):
    """doc_id, n_words, n_features, weight, score, rank of each row."""
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(of, grams(text, longest)[1]))
    for _, text in target:
        t.update(map(of, grams(text, longest)[1]))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for i, text in rows:
        n, own = grams(text, longest)
        weight = sum(gain(of(f)) for f in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = share * len(able) // 100
    return Counter([(*r, k + 1 if k < drawn else None) for k, r in enumerate(able)] + [(*r, None) for r in out if r[1] < min_words])


TARGET = [(1, "An be chi do el fra go"), (2, "hin is ka LO mer"), (3, None), (4, "")]


@pytest.mark.parametrize("common", [0, 3, 10, 1 << 16])
@pytest.mark.parametrize("longest, buckets, share, min_words", [(1, 10_000, 10, 20), (3, 50, 60, 1)])
def test_brute_force(spark, docs, rows, monkeypatch, common, longest, buckets, share, min_words):
    """Whichever way gains reach the documents: sent to the tasks, or by a join."""
    monkeypatch.setattr(resampling, "COMMON", common)
    more = [(5000, "café CAFÉ İx 1a2b_3c-d " * 9), (5001, "Z" * 100 + " z"), (5001, "Z" * 100 + " z"), (None, "Q " * 30), (None, "Q " * 30)]
    table = docs.select("doc_id", "text", "size", "score").unionByName(spark.createDataFrame([(*r, 1, 2) for r in more], "doc_id bigint, text string, size int, score int"))
    target = spark.createDataFrame(TARGET, "item_id bigint, text string")
    out = resampling.resample(table, target, longest, buckets, share, min_words)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, out.collect())) == brute([(i, t) for i, t, _ in rows] + more, TARGET, longest, buckets, share, min_words)


def test_hot_ids_and_empty_targets(spark):
    """A third of the rows lack an id, a third share one; an empty target."""
    rows = [(None, f"a b c w{i % 9} " * 8) for i in range(90)] + [(7, f"a b x{i} " * 8) for i in range(90)] + [(100 + i, "a b " * i) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    target = spark.createDataFrame([], "item_id bigint, text string")
    assert Counter(map(tuple, resampling.resample(docs, target).collect())) == brute(rows, [], 1, 10_000, 10, 20)


def test_empty_tables(empty, spark):
    assert resampling.resample(empty, spark.createDataFrame(TARGET, "item_id bigint, text string")).count() == 0
