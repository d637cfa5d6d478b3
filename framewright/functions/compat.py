"""Scalar functions whose meaning differs from Spark's own, or that Spark lacks, as Catalyst expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*parts: Column) -> Column:
    """Concatenation that leaves nulls out."""
    return F.concat_ws("", *[p.cast("string") for p in parts])


def int_div(a: str, b: str) -> Column:
    """Division of two integer columns (by name) that cuts off towards zero; null on division by zero."""
    return F.expr(f"{a} div nullif({b}, 0)")


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor, by Euclid's steps; 93 cover any pair of longs."""
    start = F.struct(F.abs(a).cast("bigint").alias("x"), F.abs(b).cast("bigint").alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.pmod(s["x"], F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y"))))["x"]


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("bigint")).otherwise((F.abs(a) / g).cast("bigint") * F.abs(b))


def trunc(x: Column, places: int = 0) -> Column:
    """Cut off after this many decimal places, towards zero."""
    scaled = x * F.lit(10.0**places)
    return F.when(scaled >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)) / F.lit(10.0**places)


def iszero(x: Column) -> Column:
    return x == 0


def nanvl(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).otherwise(a)


def regexp_match(text: Column, pattern: str) -> Column:
    """The groups of the first match (the match itself without groups) as an array; null without a match."""
    groups = re.compile(pattern).groups
    found = [F.regexp_extract(text, pattern, g) for g in (range(1, groups + 1) if groups else [0])]
    return F.when(text.rlike(pattern), F.array(*found))


def array_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of equal length."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def array_positions(a: Column, x: Column) -> Column:
    """Every one-based position of a value."""
    return F.filter(F.transform(a, lambda v, i: F.when(v == x, i + 1)), lambda p: p.isNotNull())


def array_replace(a: Column, old: Column, new: Column, times: int | None = None) -> Column:
    """The first `times` occurrences (all by default) of a value replaced."""
    if times is None:
        return F.transform(a, lambda v: F.when(v.eqNullSafe(old), new).otherwise(v))
    before = F.transform(a, lambda v, i: F.struct(v.alias("v"), F.size(F.filter(F.slice(a, F.lit(1), i), lambda w: w.eqNullSafe(old))).alias("n")))
    return F.transform(before, lambda s: F.when(s["v"].eqNullSafe(old) & (s["n"] < times), new).otherwise(s["v"]))


def array_remove_n(a: Column, x: Column, times: int) -> Column:
    """The first `times` occurrences of a value removed."""
    marked = F.transform(a, lambda v, i: F.struct(v.alias("v"), F.size(F.filter(F.slice(a, F.lit(1), i), lambda w: w == x)).alias("n")))
    return F.transform(F.filter(marked, lambda s: F.coalesce(~((s["v"] == x) & (s["n"] < times)), F.lit(True))), lambda s: s["v"])


def array_resize(a: Column, n: Column, fill: Column) -> Column:
    """An array of exactly n elements: cut, or filled up."""
    return F.concat(F.slice(a, F.lit(1), n), F.array_repeat(fill, F.greatest(n - F.size(a), F.lit(0))))


def map_extract(m: Column, key: Column) -> Column:
    """The value of a key as an array of one, an empty array without it."""
    return F.when(F.map_contains_key(m, key), F.array(F.element_at(m, key))).otherwise(F.array())
