"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
hold: literal runs give the AND of their trigrams, alternatives an OR. The index holds, for each
trigram of these queries, the documents that contain it (lower-cased). Postings meet by document,
the queries are evaluated on each document's set of trigrams, and the documents that pass are verified with
the regular expression. Rules without a mandatory trigram scan every text.

Spans come from the matches and from the gaps between them, so positions are code points of the whole text.

Defined results: a null or empty text has no spans; a null doc_id and repeated rows are scanned like any
other (rows that share an id share candidates, and each is verified on its own text); an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

try:
    from re import _parser as sre
except ImportError:  # pragma: no cover
    import sre_parse as sre

from pyspark.sql import Column, DataFrame, functions as F

from terrazzo.llm.common import materialize, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds leftmost non-overlapping matches; those whose group ``value`` has under ``least`` characters are dropped."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1


BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("url_login", r"://[A-Za-z0-9._~%-]{1,64}:[A-Za-z0-9._~%!*-]{3,128}@"),
    Rule("bearer", r"(?i)bearer\x20+[A-Za-z0-9._~+/=-]{20,}"),
)
RULES = BASE + MORE

#: Rows of candidates that are sent to all executors at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_MOST = 64  # alternatives of one literal run


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND over literal runs of OR over their alternatives of AND over trigrams, lower-cased; empty: scan fully."""
    found: list[set[str]] = []

    def close(runs: set[str]) -> set[str]:
        if runs and all(len(x) >= 3 for x in runs):
            found.append(set(runs))
        return {""}

    def exact(node) -> set[str] | None:
        """All strings of a node if they are few, else None."""
        op, arg = str(node[0]), node[1]
        if op == "LITERAL":
            return {chr(arg).lower()}
        if op == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in arg):
            chars = {chr(c).lower() for k, v in arg for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))}
            return chars if len(chars) <= 6 else None
        if op == "BRANCH":
            parts = [sequence(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op == "SUBPATTERN":
            return sequence(arg[3])
        if op == "MAX_REPEAT" and arg[1] == 1:
            inner = sequence(arg[2])
            return None if inner is None else inner | ({""} if arg[0] == 0 else set())
        if op == "MAX_REPEAT" and arg[0] == arg[1] and arg[0] <= 8:
            inner, out = sequence(arg[2]), {""}
            if inner is None:
                return None
            for _ in range(arg[0]):
                out = {a + b for a in out for b in inner}
            return out if len(out) <= _MOST else None
        return None

    def sequence(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            own = exact(node)
            if own is None or len(out) * len(own) > _MOST:
                return None
            out = {a + b for a in out for b in own}
        return out

    runs = {""}
    for node in sre.parse(pattern):
        own = exact(node)
        if own is not None and len(runs) * len(own) <= _MOST:
            runs = {a + b for a in runs for b in own}
        else:
            runs = close(runs)
            if own is not None:
                runs = own
    close(runs)
    grams = lambda x: frozenset(x[i : i + 3] for i in range(len(x) - 2))
    return [sorted({grams(x) for x in alternatives}, key=sorted) for alternatives in found]


def trigram_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram: place in ``grams``, doc_id) of the trigrams."""
    low = docs.select("doc_id", F.lower(text_or_empty()).alias("_low"))
    held = F.array(*(F.when(F.contains("_low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)))
    return low.select("doc_id", F.explode(F.array_compact(held)).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): bit k is set where the postings satisfy the query of the k-th rule."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for run in q for one in run for g in one})
    words = range(-(-len(grams) // 62))  # sets of trigrams as bits of BIGINT columns
    bit = lambda w: F.when(F.expr(f"gram DIV 62 = {w}"), F.expr("shiftleft(1L, CAST(gram % 62 AS INT))"))
    sets = trigram_index(docs, grams).groupBy("doc_id").agg(*(F.coalesce(F.bit_or(bit(w)), F.lit(0)).cast("bigint").alias(f"w{w}") for w in words))

    def holds(one: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in words:
            mask = sum(1 << (grams.index(g) % 62) for g in one if grams.index(g) // 62 == w)
            if mask:
                out = out & (F.col(f"w{w}").bitwiseAND(F.lit(mask)) == F.lit(mask))
        return out

    total = F.lit(0)
    for k, query in enumerate(queries):
        if query:
            passed = F.lit(True)
            for run in query:
                some = F.lit(False)
                for one in run:
                    some = some | holds(one)
                passed = passed & some
            total = total + F.when(passed, 1 << k).otherwise(0)
    return sets.select("doc_id", total.cast("int").alias("rules")).where("rules <> 0")


def spans_of(text: Column, rule: Rule, order: int, wanted: Column) -> Column:
    """Array of (start, kind order, end) of a rule's matches in ``text``, empty where not wanted."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.value))
    gaps = F.split(text, rule.pattern, -1)
    parts = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("m"), values.alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        own = F.array(F.struct(begin.alias("s"), F.lit(order).alias("k"), end.alias("e")))
        return F.struct(end.alias("at"), F.when(F.length(x["v"]) >= rule.least, F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"))

    every = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(wanted & text.rlike(rule.pattern), every).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"])), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_<kind> of the base rules, base_sha256, spans (kind:start:end, comma-joined)."""
    found = materialize(candidates(docs, rules).withColumnRenamed("doc_id", "_id"), "candidates")
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = docs.select("doc_id", text_or_empty().alias("_t"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("_rules", F.coalesce("rules", F.lit(0)))
    for k, rule in enumerate(rules):
        wanted = F.lit(True) if not trigram_query(rule.pattern) else F.col("_rules").bitwiseAND(F.lit(1 << k)) != 0
        rows = rows.withColumn(f"_{rule.kind}", spans_of(F.col("_t"), rule, k, wanted))
    of = lambda rs: F.concat(*(F.col(f"_{r.kind}") for r in rs))
    return rows.select(
        "doc_id",
        *(F.size(f"_{r.kind}").cast("bigint").alias(f"n_{r.kind}") for r in base),
        F.sha2(_joined(of(base), rules).cast("binary"), 256).alias("base_sha256"),
        _joined(of(rules), rules).alias("spans"),
    )
