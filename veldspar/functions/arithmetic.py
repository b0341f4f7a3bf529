"""Arithmetic with kinds, lengths, number literals and sorting by a comparator. An operation without a result is null.

What an operation means depends on the kinds of its operands, so these take Spark types beside columns; operands that do not
go together are a TypeError when the plan is made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_REPEATS = 1_000_000
#: Multipliers of number literals.
MULTIPLIERS = {"K": 1000, "M": 1000**2, "G": 1000**3, "T": 1000**4, "P": 1000**5, "Ki": 1024, "Mi": 1024**2, "Gi": 1024**3, "Ti": 1024**4, "Pi": 1024**5}
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _kind(t: T.DataType) -> str:
    if isinstance(t, WHOLE):
        return "int"
    return "number" if isinstance(t, T.NumericType) else "string" if isinstance(t, T.StringType) else "bytes" if isinstance(t, T.BinaryType) else "other"


def _refused(sign: str, ta: T.DataType, tb: T.DataType) -> TypeError:
    return TypeError(f"{ta.simpleString()} {sign} {tb.simpleString()}")


def _wide(c: Column, t: T.DataType) -> Column:
    return c.cast("long") if isinstance(t, WHOLE) else c


def add(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Sum of numbers (null beyond 64 bits for integers), or strings or bytes one after the other. Lists are refused."""
    kinds = {_kind(ta), _kind(tb)}
    if kinds <= {"int", "number"}:
        return F.try_add(_wide(a, ta), _wide(b, tb))
    if len(kinds) == 1 and kinds <= {"string", "bytes"}:
        return F.concat(a, b)
    raise _refused("+", ta, tb)


def subtract(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    if {_kind(ta), _kind(tb)} <= {"int", "number"}:
        return F.try_subtract(_wide(a, ta), _wide(b, tb))
    raise _refused("-", ta, tb)


def multiply(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Product of numbers, or a string repeated, on either side; a negative count or one over MOST_REPEATS has no result."""
    ka, kb = _kind(ta), _kind(tb)
    if {ka, kb} <= {"int", "number"}:
        return F.try_multiply(_wide(a, ta), _wide(b, tb))
    if (ka, kb) == ("int", "string"):
        return multiply(b, tb, a, ta)
    if (ka, kb) == ("string", "int"):
        return F.when(b.between(0, MOST_REPEATS), F.repeat(a, b.cast("int")))
    raise _refused("*", ta, tb)


def divide(a: Column, ta: T.DataType, b: Column, tb: T.DataType) -> Column:
    """Always a real number; null for a divisor of 0."""
    if {_kind(ta), _kind(tb)} <= {"int", "number"}:
        return F.try_divide(a.cast("double"), b.cast("double"))
    raise _refused("/", ta, tb)


def length(c: Column, t: T.DataType) -> Column:
    """Bytes of a string, elements of a list, present fields of a struct or map; null for null."""
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.octet_length(c)
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.when(c.isNotNull(), F.size(c))
    if isinstance(t, T.StructType):
        present = F.lit(0)
        for f in t.fields:
            present = present + c[f.name].isNotNull().cast("int")
        return F.when(c.isNotNull(), present)
    raise TypeError(f"len({t.simpleString()})")


def number_literal(s: Column) -> Column:
    """``1_000``, ``0x1f``, ``0o17``, ``0b11``, ``4Ki``, ``1.5G``, ``2e3`` as decimal(38,10); null for what is no literal or does not fit (digits of another base: 64 bits)."""
    digits = F.replace(s, F.lit("_"), F.lit(""))
    out = F.lit(None).cast("decimal(38,10)")
    for prefix, base, some in (("0x", 16, "[0-9A-Fa-f]"), ("0o", 8, "[0-7]"), ("0b", 2, "[01]")):
        out = F.when(s.rlike(rf"\A{prefix}{some}(_?{some})*\z") & (F.length(digits) <= 2 + 64 // (base.bit_length() - 1)), F.conv(F.substring(digits, 3, 64), base, 10).try_cast("decimal(38,10)")).otherwise(out)
    whole = "(0|[1-9](_?[0-9])*)"
    plain = rf"({whole}(\.([0-9](_?[0-9])*)?)?|\.[0-9](_?[0-9])*)"
    out = F.when(s.rlike(rf"\A{plain}([eE][+-]?[0-9]+)?\z"), digits.try_cast("decimal(38,10)")).otherwise(out)
    by = F.lit(None).cast("long")
    for name, n in MULTIPLIERS.items():
        by = F.when(F.regexp_extract(s, r"([KMGTP]i?)\z", 1) == name, F.lit(n)).otherwise(by)
    scaled = F.try_multiply(F.regexp_replace(digits, r"[KMGTP]i?\z", "").try_cast("decimal(18,9)"), by.cast("decimal(19,0)")).try_cast("decimal(38,10)")
    return F.when(s.rlike(rf"\A{plain}[KMGTP]i?\z"), scaled).otherwise(out)


def sort_by(a: Column, less: Callable[[Column, Column], Column]) -> Column:
    """A list in the order of ``less``; elements of which neither is less stay in their order. A null comparison is false."""
    no = F.lit(False)
    return F.array_sort(a, lambda x, y: F.when(F.coalesce(less(x, y), no), F.lit(-1)).when(F.coalesce(less(y, x), no), F.lit(1)).otherwise(F.lit(0)))
