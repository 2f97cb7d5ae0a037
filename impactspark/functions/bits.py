"""Bitsets: 64 members a word, words as rows, so set algebra is an expression and never a gathered set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(rows: DataFrame, member: str, flags: list[str]) -> DataFrame:
    """(word, *flags): for each flag the bits of the members that have it; members are not negative."""
    bit = F.expr(f"shiftleft(1L, cast({member} % 64 as int))")
    return rows.groupBy(F.floor(F.col(member) / 64).alias("word")).agg(*(F.bit_or(F.when(F.col(f), bit).otherwise(F.lit(0).cast("long"))).alias(f) for f in flags))


def members(sets: DataFrame, name: str, bits: str = "bits") -> DataFrame:
    """The members of (word, bits)."""
    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col(bits), i) == 1))
    return sets.where(F.col(bits) != 0).select("word", at.alias("i")).select((F.col("word") * 64 + F.col("i")).alias(name))


def union(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def intersect(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def differ(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def without(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def get_bit(a: Column, i: int) -> Column:
    return F.getbit(a, F.lit(i))


def set_bit(a: Column, i: int) -> Column:
    return a.bitwiseOR(F.lit(_bit(i)).cast("long"))


def unset_bit(a: Column, i: int) -> Column:
    return a.bitwiseAND(F.lit(~_bit(i)).cast("long"))


def _bit(i: int) -> int:
    return -(1 << 63) if i == 63 else 1 << i


def nth_set(a: Column, n: int) -> Column:
    """The place of the n-th set bit, from 0; null if there are fewer."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", a, i) == 1)
    return F.get(places, F.lit(n))


# -- Integer maths ------------------------------------------------------------------------------------------------


def floor_log2(x: Column) -> Column:
    return F.length(F.bin(x)) - 1


def ceiling_log2(x: Column) -> Column:
    return F.when(x <= 1, 0).otherwise(F.length(F.bin(x - 1)))


def first_set(x: Column) -> Column:
    """The place of the lowest set bit; 64 for zero."""
    return F.bit_count(x.bitwiseAND(-x) - 1)
