"""The pipeline's filtering stages on a table in which a third of the rows lack an id and a third share one; what should stay is worked out here, in plain Python."""

import random
import re
from collections import Counter

import corpus_pipeline
from terrazzo.llm import token_counts

WORDS = [f"word{i}" for i in range(400)]


def table():
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = []
    for k in range(30):
        good, copy = text(120), text(150).split()
        near = copy[:140] + ["changed"] + copy[141:]
        for i in (None, 7, 1000 + k):
            rows += [(i, good + f" {i}", "a"), (i, "too short", "b"), (i, "again and again " * 40, "a")]
        rows += [(None, " ".join(copy), "b"), (7, " ".join(copy), "a"), (2000 + k, " ".join(near), "b")]
        rows += [(None, f"only {k} " + good, None)]
    rng.shuffle(rows)
    return rows


def passes(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {i + d for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for d in range(3)}
    return len(w) >= 50 and 100 * len(inside) <= 50 * len(w)


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages_judge_rows_not_ids(spark):
    rows = table()
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, source string, _document int").repartition(5)
    out = corpus_pipeline.quality_rules(spark, docs, "").select("doc_id", "text", "source").collect()
    kept = [r for r in rows if passes(r[1])]
    assert Counter(map(tuple, out)) == Counter(kept) and len(kept) < len(rows)

    docs = spark.createDataFrame(kept, "doc_id bigint, text string, source string").repartition(5)
    out = corpus_pipeline.exact_copies(spark, docs, "").collect()
    groups = {}
    for i, t, _ in kept:
        groups.setdefault(t, []).append(-1 if i is None else i)
    kept = [(None if max(ids) < 0 else max(ids), t) for t, ids in groups.items()]
    assert Counter((r.doc_id, r.text) for r in out) == Counter(kept)

    docs = spark.createDataFrame([(*r, "x") for r in kept], "doc_id bigint, text string, source string").repartition(5)
    out = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect())
    sets = [shingles(t) for _, t in kept]
    root = list(range(len(kept)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(kept)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    members = {}
    for k, r in enumerate(kept):
        members.setdefault(find(k), []).append(r)
    assert sum(out.values()) == len(members) < len(kept)
    for some in members.values():
        stays = [r for r in some if out[r]]
        least = min((r[0] is None, r[0] or 0) for r in some)
        assert len(stays) == 1 and (stays[0][0] is None, stays[0][0] or 0) == least


def test_tokens_without_ids(spark, tmp_path):
    """Rows that lack or share an id get the counts of their own texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t, _ in table()] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    out = token_counts.token_counts(docs, path, str(tmp_path / "cache")).collect()
    want = Counter((i, len((t or "").encode()), len(model.encode(t or "", add_special_tokens=False))) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in out) == want
