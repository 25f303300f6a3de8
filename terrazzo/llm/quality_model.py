"""Quality scores by supervised subword embeddings.

A document is the average of learned vectors of its words, of their character n-grams and of word
bigrams of one word repeated, hashed into a table of fixed size; a softmax layer on the average gives the label's probability. The model
is trained by stochastic gradient descent in numpy on at most ``TRAIN_ROWS`` labelled documents.
Tasks hash the features; the training loop gets sparse counts whose number is bounded by rows times
table size, whatever the lengths of the texts. Scoring reads every whole text: as the output layer
is linear in the average, a word counts by the sum of its features' logits, which tasks
remember per word.

Defined results: null and empty texts get the probability of the bias alone; rows repeated with
their doc_id are scored each; without any label of one kind the score is the share of the other; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from terrazzo.llm.common import filled, slices
from terrazzo.llm.labels import crc_mod, training_sample
from terrazzo.llm.words import WordCache, ngram_hashes, split_words, sums

#: Labelled documents that the model learns from, at most.
TRAIN_ROWS = 4000
BUCKETS = 1 << 15
DIM = 12
NGRAMS = (3, 4, 5)
EPOCHS, BATCH, RATE, MOMENTUM = 6, 32, 4.0, 0.9
#: Least number of steps; a small sample is read more often.
STEPS = 700

#: The last row of the table stands for every bigram of a word and itself.
REPEAT = BUCKETS

_CACHES: dict[str, WordCache] = {}


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every feature of every word."""
    owner, h = ngram_hashes(words, NGRAMS)
    return owner, (h % np.uint64(BUCKETS)).astype(np.int64)


def _repeats(offsets: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Bigrams of a word and itself in every text."""
    same = np.concatenate([[False], codes[1:] == codes[:-1]])[: len(codes)]
    same[offsets[:-1][offsets[:-1] < len(codes)]] = False
    return sums(same.astype(np.int64), offsets)


def sparse_features(sample: DataFrame) -> DataFrame:
    """(doc_id, y, buckets, counts) of the sampled documents."""

    def run(batches):
        for part in slices(batches, "text", 2_000_000):
            offsets, codes, words = split_words(filled(part.column("text")))
            owner, bucket = _features(words)
            order = np.argsort(owner, kind="stable")
            bucket = bucket[order]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])
            ids, counts = [], []
            for a, b, again in zip(offsets[:-1], offsets[1:], _repeats(offsets, codes)):
                own = codes[a:b]
                n = ends[own + 1] - ends[own]
                where = np.repeat(ends[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(own) else np.zeros(0, np.int64)
                full = np.bincount(bucket[where], minlength=BUCKETS + 1)
                full[REPEAT] = again
                some = np.flatnonzero(full)
                ids.append(some.astype(np.int32))
                counts.append(full[some].astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("y"), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))], ["doc_id", "y", "buckets", "counts"]
            )

    return sample.select(F.col("doc_id").cast("bigint"), "text", "y").mapInArrow(run, "doc_id bigint, y int, buckets array<int>, counts array<float>")


def fit(rows: pa.Table, seed: int = 7) -> tuple[np.ndarray, float]:
    """(logit per bucket, bias) after training on (y, buckets, counts)."""
    rows = rows.sort_by("doc_id").combine_chunks()
    y = rows["y"].to_numpy().astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        return np.zeros(BUCKETS + 1, np.float64), float(np.log(p / (1 - p)))
    lists, weights = (rows[c].combine_chunks() for c in ("buckets", "counts"))
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    ids, x = lists.flatten().to_numpy(), weights.flatten().to_numpy()
    total = sums(x, ends)
    x = x / np.repeat(np.maximum(total, 1), np.diff(ends)).astype(np.float32)

    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    out = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.log(np.array([1 - y.mean(), y.mean()]))
    per_epoch = -(-len(y) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // per_epoch))
    steps = epochs * per_epoch
    done, v_table, v_out, v_bias = 0, np.zeros_like(table), np.zeros_like(out), np.zeros(2)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            docs = order[at : at + BATCH]
            n = ends[docs + 1] - ends[docs]
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            where = np.repeat(ends[docs] - first, n) + np.arange(n.sum())
            some, w = ids[where], x[where]
            hidden = np.zeros((len(docs), DIM), np.float32)
            full = n > 0
            if full.any():
                hidden[full] = np.add.reduceat(table[some] * w[:, None], first[full], axis=0)
            logits = hidden @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(docs)), y[docs].astype(int)] -= 1
            g = (p / len(docs)).astype(np.float32)
            back = np.repeat(g @ out.T, n, axis=0) * w[:, None]
            touched, inverse = np.unique(some, return_inverse=True)
            grad = np.stack([np.bincount(inverse, back[:, d], len(touched)) for d in range(DIM)], axis=1).astype(np.float32)
            rate = RATE * (1 - done / steps)
            v_out = MOMENTUM * v_out - 0.1 * rate * (hidden.T @ g)
            v_bias = MOMENTUM * v_bias - 0.1 * rate * g.sum(axis=0)
            v_table[touched] = MOMENTUM * v_table[touched] - rate * grad
            table[touched] += v_table[touched]
            out += v_out
            bias = bias + v_bias
            done += 1
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((weights, bias))  # BUCKETS doubles
    import uuid

    name = uuid.uuid4().hex

    def run(batches):
        w, b = model.value
        if name not in _CACHES:

            def compute(words: list[str]) -> np.ndarray:
                owner, bucket = _features(words)
                return np.stack([np.bincount(owner, w[bucket], len(words)), np.bincount(owner, minlength=len(words))], axis=1)

            _CACHES.clear()
            _CACHES[name] = WordCache(compute, 800_000)
        cache = _CACHES[name]
        for part in slices(batches, "text"):
            offsets, codes, words = split_words(filled(part.column("text")))
            values = cache.get(words)[codes] if words else np.zeros((0, 2))
            again = _repeats(offsets, codes)
            z = (sums(values[:, 0], offsets) + again * w[REPEAT]) / np.maximum(sums(values[:, 1], offsets) + again, 1) + b
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    sample = training_sample(docs, labels, "quality", 3, 1, train_rows)
    weights, bias = fit(sparse_features(sample).toArrow())
    return score(docs, weights, bias).select("doc_id", (crc_mod(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
