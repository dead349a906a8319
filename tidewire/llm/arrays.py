"""Small array expressions shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\\x20\\x09-\\x0D"
BLANK_CHARS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    trimmed = F.btrim(text, F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANKS}]+", -1))


def positions(n: Column) -> Column:
    """0 .. n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def without_chars(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c))
    return text


def running_sum(values: Column, block: int = 128) -> Column:
    """Sums of all elements before each one; blocks keep the work near linear."""
    zero = F.array().cast("array<bigint>")

    def inside(part: Column) -> Column:
        start = F.struct(zero.alias("out"), F.lit(0).cast("bigint").alias("sum"))
        grown = F.aggregate(
            part,
            start,
            lambda a, x: F.struct(F.concat(a["out"], F.array(a["sum"])).alias("out"), (a["sum"] + x).alias("sum")),
        )
        return grown["out"]

    n_blocks = F.ceil(F.size(values) / block).cast("int")
    cut = F.transform(positions(n_blocks), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    sums = F.transform(cut, lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x))
    return F.flatten(F.zip_with(cut, inside(sums), lambda part, base: F.transform(inside(part), lambda x: x + base)))
