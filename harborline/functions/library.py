"""Column expressions for SQL library functions Spark names differently or defines differently.

All are built from Spark's own expressions and stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strpos(text: Column, part: Column | str) -> Column:
    """1-based position of ``part``, 0 if absent."""
    return F.locate(part, text) if isinstance(part, str) else F.position(part, text)


def to_hex(number: Column) -> Column:
    return F.lower(F.hex(number))


def regexp_replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Replace only the first match.  ``pattern`` must not use numbered groups itself."""
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{pattern})", f"$1{replacement}")


def trunc(number: Column) -> Column:
    """Drop the fraction, towards zero."""
    return F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))


def is_zero(number: Column) -> Column:
    return number == 0


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two bigints by Euclid's rule.

    The rule takes at most log base 1.618 of the smaller number steps, so each row folds over just
    that many.
    """
    smaller = F.least(F.abs(a), F.abs(b))
    steps = F.ceil(F.log2(smaller + 1) * 1.4405).cast("int") + 2
    start = F.struct(F.abs(a).alias("x"), F.abs(b).alias("y"))
    step = lambda s, _: F.struct(
        F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"),
        F.when(s["y"] == 0, F.lit(0).cast("bigint")).otherwise(s["x"] % s["y"]).alias("y"),
    )
    return F.aggregate(F.sequence(F.lit(1), steps), start, step, lambda s: s["x"])


def lcm(a: Column, b: Column) -> Column:
    parts = F.call_function("div", F.abs(a), F.nullif(gcd(a, b), F.lit(0)))
    return F.coalesce(parts * F.abs(b), F.lit(0).cast("bigint"))


def date_bin(seconds: int, ts: Column) -> Column:
    """Start of the ``seconds``-wide bin counted from 1970-01-01."""
    micros = F.unix_micros(ts.cast("timestamp"))
    width = seconds * 1_000_000
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width))).cast("timestamp_ntz")


def array_remove_first(array: Column, item: Column) -> Column:
    """Remove the first occurrence; Spark's ``array_remove`` removes all."""
    spot = F.array_position(array, item).cast("int")
    return F.when(spot == 0, array).otherwise(
        F.concat(F.slice(array, F.lit(1), spot - 1), F.slice(array, spot + 1, F.size(array)))
    )


def array_slice_between(array: Column, start: int, end: int) -> Column:
    """Elements ``start`` to ``end``, both 1-based and included; Spark takes a length instead."""
    return F.slice(array, F.lit(start), F.lit(max(end - start + 1, 0)))


def array_resize(array: Column, size: int, fill: Column) -> Column:
    return F.slice(F.concat(array, F.array_repeat(fill, size)), 1, size)


def array_replace_all(array: Column, old: Column, new: Column) -> Column:
    return F.transform(array, lambda x: F.when(x == old, new).otherwise(x))


def array_has_all(array: Column, wanted: Column) -> Column:
    return F.size(F.array_except(wanted, array)) == 0


def array_ndims(depth_one: Column) -> Column:
    """Dimensions of a nested array, from its type name."""
    kind = F.typeof(depth_one)
    return F.call_function("div", F.length(kind) - F.length(F.replace(kind, F.lit("array<"), F.lit(""))), F.lit(6))


def nth_value(values: Column, order: Column, n: int) -> Column:
    """Aggregate: the ``n``-th value by ``order``.  For groups of bounded size."""
    ordered = F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v"))))
    return F.get(ordered, F.lit(n - 1))["v"]
