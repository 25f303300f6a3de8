"""Fill-in-the-middle: exact round trips and a plain regular expression."""

import hashlib
import re
from collections import Counter

from hypothesis import given, strategies as st
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from terrazzo.llm import fill_middle

SPLITTER = Split(Regex(fill_middle.UNIT), "isolated")


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by Python's regular expressions."""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


@given(st.text(st.sampled_from("ab Z\n\r\x00é😀<PSM>"), max_size=60), st.integers(1, 20))
def test_places_of_units(text, size):
    """Places are those of the regular expression, whatever the pieces."""
    want = [m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text, re.S)]
    assert fill_middle.ends_of_units(SPLITTER, text).tolist() == want
    parts = list(fill_middle.pieces(text, size))
    assert "".join(p for _, p in parts) == text
    assert [e + at for at, p in parts for _, (_, e) in SPLITTER.pre_tokenize_str(p)] == want


def test_rows_and_round_trips(spark, docs, rows):
    more = [(2000 + k, t) for k, t in enumerate(["<", "S><", "a<P", "<P>x", "x<S>", "<M>", "S>M>", "<<<>>>", "é", "\x00", "ab" * 3000 + " " + "x y " * 3000])]
    more += [(k, "<S <P S> tricky < >" * (k % 4)) for k in range(3000, 3060)]
    table = docs.select("doc_id", "text", F.lit("x").alias("form"), F.lit(1).alias("n")).unionByName(spark.createDataFrame([(*r, "x", 1) for r in more], "doc_id bigint, text string, form string, n int"))
    every = [(i, t or "") for i, t, _ in rows] + more
    out = fill_middle.fill_in_middle(table)
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute(i, t)) for i, t in every)
    back = out.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(map(str, every))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fill_middle.summary(out).collect()}
    assert digests == {(i, sha(brute(i, t)[4]), sha(t)) for i, t in every}
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_tables(empty):
    assert fill_middle.summary(fill_middle.fill_in_middle(empty)).count() == 0
