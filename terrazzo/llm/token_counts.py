"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens) in a folder that all
executors share. A run

1. digests the normalised content (null becomes the empty text; a tokenizer's own normaliser stays
   inside the tokenizer) and the tokenizer file;
2. anti-joins the distinct digests to the cache;
3. fetches one text per missing digest, encodes only those and appends their counts;
4. joins the counts back to all documents, hot digests dealt over salts.

Inside a task, counts of single words are remembered where a text's words can be told apart
safely; any other text is encoded whole. Both give the library's numbers.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows repeated with their doc_id are
kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from terrazzo.llm.common import filled, materialize, shared_dir, skew_safe_lookup, slices, text_or_empty
from terrazzo.llm.words import WordCache, split_words, sums

#: RE2: white space other than single spaces and single line feeds between words, or a special token's start.
_UNSAFE = (
    r"[\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|[ \n][ \n]|^[ \n]|[ \n]$|<\|"
)
_HELD: dict[str, tuple] = {}

CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens bigint"


def _load(path: str):
    """The encoder of a tokenizer file, and a word cache where its words are independent; once a process."""
    if path in _HELD:
        return _HELD[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)

        def count(texts: list[str]) -> np.ndarray:
            return np.array([len(x) for x in model.encode(texts, num_threads=1)], dtype=np.int64)

        cache = None
    else:
        import json

        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()

        def count(texts: list[str]) -> np.ndarray:
            return np.array([len(x) for x in model.encode_batch(texts, add_special_tokens=False)], dtype=np.int64)

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        by_words = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        cache = WordCache(count, 500_000) if by_words else None
    _HELD[path] = count, cache
    return _HELD[path]


def count_tokens(texts: pa.Array, path: str) -> np.ndarray:
    """Tokens of every text, as the library counts them without special tokens added."""
    count, cache = _load(path)
    if cache is None:
        return count(texts.to_pylist())
    unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
    out = np.zeros(len(texts), dtype=np.int64)
    if unsafe.any():
        out[unsafe] = count(texts.filter(pa.array(unsafe)).to_pylist())
    if not unsafe.all():
        # a line's first word carries the line feed before it, any other word the space before it
        safe = texts.filter(pa.array(~unsafe))
        lines = pc.replace_substring(pc.binary_join_element_wise("\n", safe, ""), "\n", " \n")
        offsets, codes, words = split_words(lines, " ")
        counts = cache.get([w if not w or w[0] == "\n" else f" {w}" for w in words])
        first = count(["\n"])[0]  # the line feed set before the text
        out[~unsafe] = sums(counts[codes], offsets) - first
    return out


def tokenizer_digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def cache_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/token-cache/{hashlib.sha256(name.encode()).hexdigest()[:16]}"


def _read_cache(spark: SparkSession, folder: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(CACHE_SCHEMA).parquet(folder)
    return spark.createDataFrame([], CACHE_SCHEMA)


def token_counts(docs: DataFrame, tokenizer_path: str, cache: str, limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``cache`` is the folder of the cache table; missing counts are appended to it before this returns.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    keyed = docs.select("doc_id", F.sha2(text_or_empty().cast("binary"), 256).alias("content_digest"), F.octet_length(text_or_empty()).cast("bigint").alias("n_bytes"))
    keyed = materialize(keyed.withColumn("_row", F.monotonically_increasing_id()), "digests")

    known = _read_cache(spark, cache).where(F.col("tokenizer_digest") == version).select("content_digest")
    # one row stands for each digest; documents without an id are told apart by their digest below
    missing = keyed.groupBy("content_digest").agg(F.min("doc_id").alias("_rep")).join(known, "content_digest", "left_anti")
    missing = materialize(missing, "misses")
    if not missing.isEmpty():
        texts = docs.select(F.col("doc_id").alias("_rep"), text_or_empty().alias("_text"))
        wanted = missing.select("_rep", F.col("content_digest").alias("_want"))
        texts = texts.join(wanted, texts["_rep"].eqNullSafe(wanted["_rep"]) & (F.sha2(F.col("_text").cast("binary"), 256) == F.col("_want")))

        def encode(batches):
            for batch in batches:
                # rows repeated with their doc_id and text stand next to each other after the join
                own = batch.column("content_digest").to_pylist()
                once = [i for i, d in enumerate(own) if not i or d != own[i - 1]]
                for part in slices([batch.take(pa.array(once)) if len(once) < len(own) else batch], "_text", 6_000_000):
                    n = count_tokens(filled(part.column("_text")), tokenizer_path)
                    yield pa.RecordBatch.from_arrays([part.column("content_digest"), pa.array(n)], ["content_digest", "n_tokens"])

        fresh = texts.select(F.col("_want").alias("content_digest"), "_text").mapInArrow(encode, "content_digest string, n_tokens bigint")
        fresh.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").distinct().write.mode("append").parquet(cache)

    # a run that was cut short or ran twice may have appended a digest twice
    counts = _read_cache(spark, cache).where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    out = skew_safe_lookup(keyed, counts, "content_digest", "_row")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
