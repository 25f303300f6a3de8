"""Quality rules decided at the level of hosts, in DataFrame functions only.

Every document gets word, symbol, line and repetition counts and fails or passes the rules. Failures
are added up by host (``source``), each host's failure rate is shrunk towards the rate of all hosts
by a beta prior whose two parameters are fitted to the hosts by moments, and a host whose shrunk rate
of any rule exceeds the rule's limit is rejected. Host verdicts are joined back to the documents.

Failures are combined in map tasks, so a host with a third of all rows sends one row a task. Only
rejected hosts are joined back, by salted pairs. ``keep`` reads the documents twice instead of writing
their texts: rejected hosts are broadcast where their names stay below ``BROADCAST_BYTES``, and beyond
that the rows that pass the base rules are written once and joined by salted pairs.

Defined results: a null text has no words and fails; documents with a null source form one host of
their own; repeated rows are kept and counted; an empty table gives an empty result; other columns
pass through ``keep`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from terrazzo.llm.common import materialize, skew_safe_lookup, text_or_empty

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 50, 50
#: Bytes of names of rejected hosts, with 64 bytes a row, up to which ``keep`` broadcasts them.
BROADCAST_BYTES = 8_000_000

#: Rule -> (failure of one document, share of a host's documents, after shrinking, beyond which the host is rejected).
RULES: dict[str, tuple[str, float]] = {
    "few_words": (f"n_words < {MIN_WORDS}", 0.6),
    "repeated_words": (f"100 * n_repeat_words > {MAX_REPEATED} * n_words", 0.5),
    "symbols": ("10 * n_symbols > 3 * n_words", 0.5),
    "repeated_lines": ("2 * n_dup_lines > n_words", 0.5),
    "long_words": ("word_chars > 15 * n_words", 0.5),
}


def document_counts(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id and the carried columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long)."""
    words = F.filter(F.split("_t", SPACES), lambda w: w != "")
    rows = docs.select("doc_id", *carry, text_or_empty().alias("_t")).withColumn("_w", words)
    n_chars = F.length(F.translate("_t", " \t\n\x0b\x0c\r", ""))
    lines = F.filter(F.split("_t", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    hashes = F.expr("transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2]))")
    # windows as (hash, place), sorted; equal hashes stand together. The words of neighbours are compared too.
    entries = F.expr("array_sort(transform(_h, (h, i) -> struct(h AS h, i AS p)))")
    same = "(_s[{a}].h = _s[{b}].h AND _w[_s[{a}].p] = _w[_s[{b}].p] AND _w[_s[{a}].p + 1] = _w[_s[{b}].p + 1] AND _w[_s[{a}].p + 2] = _w[_s[{b}].p + 2])"
    before, after = same.format(a="i", b="i - 1"), same.format(a="i", b="i + 1")
    places = F.expr(f"""array_sort(transform(filter(transform(_s, (x, i) -> struct(x.p AS p,
        (CASE WHEN i > 0 THEN {before} ELSE false END) OR (CASE WHEN i < size(_s) - 1 THEN {after} ELSE false END) AS r)), x -> x.r), x -> x.p))""")
    covered = F.expr("aggregate(_p, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n)")
    few = F.expr("size(_w) < 3")
    rows = rows.withColumn("_h", F.when(few, F.array().cast("array<bigint>")).otherwise(hashes))
    plain = F.size("_h") == F.size(F.array_distinct("_h"))
    rows = rows.withColumn("_s", F.when(plain, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(entries))
    rows = rows.withColumn("_p", F.when(F.size("_s") == 0, F.array().cast("array<int>")).otherwise(places))
    rows = rows.withColumn("_l", lines)
    return rows.select(
        "doc_id",
        *carry,
        F.size("_w").cast("bigint").alias("n_words"),
        n_chars.cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
    )


def host_verdicts(counted: DataFrame) -> DataFrame:
    """One row per host: source, n_docs, the shrunk failure rate of every rule, rejected."""
    n = F.col("n_docs")
    fails = [F.sum(F.when(F.expr(rule), 1).otherwise(0)).alias(f"f_{k}") for k, (rule, _) in RULES.items()]
    hosts = materialize(counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *fails), "hosts")
    # moments of the hosts' rates, weighted by their documents: mean m, variance v beyond the binomial's
    sums = [F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("nn")]
    sums += [F.sum(F.col(f"f_{k}")).alias(f"f_{k}") for k in RULES] + [F.sum(F.col(f"f_{k}") * F.col(f"f_{k}") / n).alias(f"q_{k}") for k in RULES]
    s = hosts.agg(*sums).first()
    out = hosts
    rejected = F.lit(False)
    for k, (_, limit) in RULES.items():
        total, m = s["n"] or 1, (s[f"f_{k}"] or 0) / (s["n"] or 1)
        free = total - (s["nn"] or 0) / total
        spread = ((s[f"q_{k}"] or 0) - total * m * m - ((s["k"] or 0) - 1) * m * (1 - m)) / free if free > 0 else 0.0
        # a beta distribution of mean m and variance v has alpha + beta = m (1 - m) / v - 1
        strength = min(1e6, max(2.0, m * (1 - m) / spread - 1)) if spread > 0 else 1e6
        rate = (F.col(f"f_{k}") + F.lit(m * strength)) / (n + F.lit(strength))
        out = out.withColumn(f"rate_{k}", rate)
        rejected = rejected | (F.col(f"rate_{k}") > limit)
    return out.select("source", "n_docs", *(f"rate_{k}" for k in RULES), rejected.alias("rejected"))


def _base_failed() -> Column:
    return F.expr(f"{RULES['few_words'][0]} OR {RULES['repeated_words'][0]}")


def _rejected(counted: DataFrame) -> DataFrame:
    return materialize(host_verdicts(counted).where("rejected").select("source"), "rejected-hosts")


def _with_hosts(counted: DataFrame, bad: DataFrame) -> DataFrame:
    """``counted`` (with a number of each row, ``_row``) and whether the host of each row is among ``bad``."""
    if bad.isEmpty():
        return counted.withColumn("host_rejected", F.lit(False))
    bad = bad.select(F.col("source").alias("_b"), F.lit(True).alias("host_rejected"))
    every = counted.select("source").distinct().join(bad, F.col("source").eqNullSafe(F.col("_b")), "left")
    return skew_safe_lookup(counted, every.select("source", F.coalesce("host_rejected", F.lit(False)).alias("host_rejected")), "source", "_row")


def judge(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, host_rejected."""
    counted = materialize(document_counts(docs, "source").withColumn("_row", F.monotonically_increasing_id()), "quality-counts")
    out = _with_hosts(counted, _rejected(counted)).withColumn("base_failed", _base_failed())
    kept = ~F.col("base_failed") & ~F.col("host_rejected")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "host_rejected")


def keep(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and whose host is not rejected, each by its own verdict, whatever its doc_id."""
    bad = _rejected(document_counts(docs, "source"))
    rows = document_counts(docs.select("doc_id", "text", "source", F.struct("*").alias("_document")), "source", "_document")
    # a filter would be pushed through the projections and repeat their expressions in each other without end; a generator isn't
    none = F.array().cast(ArrayType(rows.schema["_document"].dataType))
    passed = rows.select("source", F.explode(F.when(_base_failed(), none).otherwise(F.array("_document"))).alias("_document"))
    size = bad.agg(F.sum(F.octet_length(F.coalesce("source", F.lit(""))) + 64)).first()[0] or 0
    if size > broadcast_bytes:
        passed = materialize(passed.withColumn("_row", F.monotonically_increasing_id()), "passed-rows")
        return _with_hosts(passed, bad).where("NOT host_rejected").select("_document.*")
    if size:
        bad = bad.select(F.col("source").alias("_b"))
        passed = passed.join(F.broadcast(bad), F.col("source").eqNullSafe(F.col("_b")), "left_anti")
    return passed.select("_document.*")
