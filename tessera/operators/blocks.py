"""Blocks of generated text: parsing, trimming and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import has_word


def labelled_blocks(text: Column, label: str) -> Column:
    """What follows each line that holds just the label and a number, brackets allowed; nothing before the first."""
    parts = F.split(text, rf"(?im)^[ \t]*\[?[ \t]*{label}[ \t]+\d+[ \t]*\]?[ \t]*$", -1)
    rest = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.filter(F.transform(rest, lambda b: F.btrim(b, F.lit(" \t\r\n"))), lambda b: b != "")


def paragraphs(text: Column, limit: int | None = None) -> Column:
    """Chunks between blank lines, trimmed; the first `limit` of them if given."""
    parts = F.filter(F.transform(F.split(text, r"\n[ \t]*\n", -1), lambda b: F.btrim(b, F.lit(" \t\r\n"))), lambda b: b != "")
    return parts if limit is None else F.slice(parts, 1, limit)


def before_first(parts: Column, marks: Sequence[str]) -> Column:
    """The leading parts, up to the first that begins with one of the marks in lower case."""
    hit = lambda p: F.greatest(*[F.startswith(F.lower(p), F.lit(m)) for m in marks], F.lit(False))
    flags = F.transform(parts, hit)
    at = F.array_position(flags, True)
    return F.when(at > 0, F.slice(parts, F.lit(1), at - 1)).otherwise(parts)


def without_word(rows: DataFrame, text: str, word: str) -> DataFrame:
    """Rows whose text does not have the word of their column `word`."""
    return rows.where(~has_word(F.col(text), F.col(word)))


def parse_quality(rows: DataFrame, keys: Sequence[str], parsed: str, expected: int, finish: str) -> DataFrame:
    """Per group: rows, parsed and expected blocks, rows that ended for length, and whether all were parsed."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.sum(F.size(parsed)).alias("n_parsed"),
        (F.count("*") * expected).alias("n_expected"),
        F.count_if(F.col(finish) == "length").alias("n_length"),
        (F.sum(F.size(parsed)) >= F.count("*") * expected).alias("passed"),
    )
