"""Fill-in-the-middle form of documents.

The Split pre-tokenizer of the tokenizers library, with one regular expression and its matches isolated,
cuts a text into units; it needs no trained vocabulary and gives each unit's place in code points. The number of
places is n; two cuts, drawn from a digest of the doc_id, pick two of the places in order, and the
text between, before and after them is the middle, the prefix and the suffix. A share of documents stays plain, and
so do texts that are empty or hold a marker.

Texts are cut in pieces of about ``PIECE`` code points, each ended by a unit that is no letter, so that
the list of places of a long text is never held whole; a run of letters is never parted.

Defined results: a null text is empty; an empty text is plain with n = 0; a null doc_id draws from the
digest of the empty id; rows repeated with their doc_id are all transformed; an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from terrazzo.llm.common import filled, slices

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: Documents in 100 that are transformed, and of these, those with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
PIECE = 512

_LETTERS = re.compile("[A-Za-z]*")


def draws(doc_id: int | None, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2 ** 32 from the digest of a seed and a doc_id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def pieces(text: str, size: int = PIECE) -> Iterator[tuple[int, str]]:
    """(place, piece) of a text, each piece ended after its letters."""
    at = 0
    while at < len(text):
        end = _LETTERS.match(text, min(at + size, len(text))).end()
        yield at, text[at:end]
        at = end


def ends_of_units(splitter: Split, text: str) -> np.ndarray:
    """The place after each unit, in code points."""
    ends = [np.fromiter((e for _, (_, e) in splitter.pre_tokenize_str(piece)), np.int64) + at for at, piece in pieces(text)]
    return np.concatenate(ends) if ends else np.zeros(0, np.int64)


def transformed(text: str, doc_id: int | None, ends: np.ndarray) -> tuple[str, int | None, int | None, str]:
    """(form, prefix_chars, middle_chars, output) of one text whose units end at these places."""
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= RATE:
        return "plain", None, None, text
    first, second = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output."""

    def run(batches):
        splitter = Split(Regex(UNIT), "isolated")
        for part in slices(batches, "text", 4_000_000):
            rows = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), filled(part.column("text")).to_pylist()):
                ends = ends_of_units(splitter, text)
                rows.append((doc_id, len(ends), *transformed(text, doc_id, ends)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of an output. No text in a psm or spm output holds a marker, so the first of each is its own."""

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(a) + len(second) + 1)
        b = F.substring_index(rest, MIDDLE, 1)
        return a, b, F.substr(rest, F.length(b) + len(MIDDLE) + 1)

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = between(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_, middle_, suffix_))


def summary(rows: DataFrame) -> DataFrame:
    """``fill_in_middle`` with digests of the output and of the text restored from it."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
