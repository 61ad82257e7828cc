"""What a coder is given: raw bits, bins of symbols and header fields, as strings of 0 and 1 in coding order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F




def fixed(v: Column, bits: int | Column) -> Column:
    """The low bits of a number, highest first."""
    return F.when(F.lit(bits) > 0, F.lpad(F.bin(v), bits, "0") if isinstance(bits, int) else F.call_function("lpad", F.bin(v), bits, F.lit("0"))).otherwise("")


def golomb(v: Column) -> Column:
    """Exponential Golomb code of order 0 of a number that isn't negative."""
    digits = F.bin(v + 1)
    return F.concat(F.call_function("repeat", F.lit("0"), F.length(digits) - 1), digits)


def signed_golomb(v: Column) -> Column:
    """Positive numbers go before their opposites: 0, 1, -1, 2, -2."""
    return golomb(F.when(v > 0, 2 * v - 1).otherwise(-2 * v))


def residual_bins(v: Column) -> Column:
    """1 for zero, else 0, the sign (1 is positive), whether the size is 1, 2, 3, and beyond that its Golomb code less 4."""
    size = F.abs(v)
    rest = F.when(size == 1, "1").when(size == 2, "01").when(size == 3, "001").otherwise(F.concat(F.lit("000"), golomb(F.greatest(size - 4, F.lit(0)))))
    return F.when(v == 0, "1").otherwise(F.concat(F.lit("0"), F.when(v > 0, "1").otherwise("0"), rest))


def duplicate_bins(n: Column) -> Column:
    """Of the number of points in a leaf: 1 for a single one, else 0 and the Golomb code less 2."""
    return F.when(n == 1, "1").otherwise(F.concat(F.lit("0"), golomb(F.greatest(n - 2, F.lit(0)))))


KINDS = {"ue": golomb, "se": signed_golomb, "u1": lambda v: fixed(v, 1), "u8": lambda v: fixed(v, 8), "u16": lambda v: fixed(v, 16)}


def coded_fields(rows: DataFrame, keys: list[str], fields: list[tuple[str, str, str]]) -> DataFrame:
    """keys, place, field, value and bits of each header field (name, kind, SQL expression over the row)."""
    parts = []
    for place, (name, kind, value) in enumerate(fields):
        v = F.expr(value).cast("long")
        parts.append(F.struct(F.lit(place).alias("place"), F.lit(name).alias("field"), v.alias("value"), KINDS[kind](v).alias("bits")))
    return rows.select(*keys, F.explode(F.array(*parts)).alias("f")).select(*keys, "f.*")


__all__ = ["coded_fields", "duplicate_bins", "fixed", "golomb", "residual_bins", "signed_golomb"]
