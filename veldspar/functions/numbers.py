"""List, number, bit, conversion and time functions as Columns."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# integers: Euclidean and truncated division (null for a zero divisor)


def mod(x: Column, y: Column) -> Column: return F.when(y != 0, F.pmod(x, F.abs(y)))  # noqa: E704
def div(x: Column, y: Column) -> Column: return F.when(y != 0, F.try_subtract(quo(x, y), F.when(rem(x, y) < 0, F.signum(y.cast("double")).cast("long")).otherwise(0)))  # noqa: E704
def rem(x: Column, y: Column) -> Column: return F.try_mod(x, y)  # noqa: E704
def quo(x: Column, y: Column) -> Column:
    """Integer division towards zero, exact over all 64 bits (null beyond them)."""
    return F.call_function("div", x, F.when((y != 0) & ~((x.cast("long") == F.lit(-(2**63))) & (y == -1)), y))


# lists


def list_sum(a: Column, kind: str = "double") -> Column: return F.aggregate(a, F.lit(0).cast(kind), lambda s, x: (s + x).cast(kind))  # noqa: E704
def list_product(a: Column, kind: str = "double") -> Column: return F.aggregate(a, F.lit(1).cast(kind), lambda s, x: (s * x).cast(kind))  # noqa: E704
def list_avg(a: Column) -> Column: return F.try_divide(list_sum(a), F.size(a))  # noqa: E704
def list_min(a): return F.array_min(a)  # noqa: E704
def list_max(a): return F.array_max(a)  # noqa: E704
def drop(a: Column, n: int) -> Column: return F.slice(a, F.lit(n + 1), F.greatest(F.size(a) - n, F.lit(0)))  # noqa: E704
def take(a: Column, n: int) -> Column: return F.slice(a, 1, n)  # noqa: E704
def slice_(a: Column, lo: int, hi: int) -> Column: return F.when(F.size(a) >= hi, F.slice(a, lo + 1, hi - lo))  # noqa: E704
def reverse(a): return F.reverse(a)  # noqa: E704
def flatten(a: Column, depth: int) -> Column:
    for _ in range(depth):
        a = F.flatten(a)
    return a
def concat(*a): return F.concat(*a)  # noqa: E704
def repeat(a: Column, n: int) -> Column: return F.flatten(F.array_repeat(a, n))  # noqa: E704
def range_(start: int, limit: int, step: int) -> Column: return F.array(*map(F.lit, range(start, limit, step))) if not (limit - start) * step > 0 or abs(limit - start) <= 16 * abs(step) else F.sequence(F.lit(start), F.lit(start + (len(range(start, limit, step)) - 1) * step), F.lit(step))  # noqa: E704
def contains(a: Column, x) -> Column: return F.coalesce(F.array_contains(a, x), F.lit(False))  # noqa: E704
def min_items(a: Column, n: int) -> Column: return F.size(a) >= n  # noqa: E704
def max_items(a: Column, n: int) -> Column: return F.size(a) <= n  # noqa: E704
def unique_items(a: Column) -> Column: return F.size(F.array_distinct(a)) == F.size(a)  # noqa: E704
def sort(a: Column, descending: bool = False) -> Column: return F.sort_array(a, asc=not descending)  # noqa: E704
def is_sorted(a: Column) -> Column: return F.array_sort(a) == a  # noqa: E704


# numbers


def multiple_of(x: Column, n) -> Column: return F.try_mod(x, F.lit(n)) == 0  # noqa: E704
def trunc(x: Column) -> Column: return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))  # noqa: E704
def round_half_away(x: Column) -> Column: return F.signum(x) * F.floor(F.abs(x) + 0.5)  # noqa: E704
def round_to_even(x: Column) -> Column: return F.rint(x)  # noqa: E704
def dim(x: Column, y: Column) -> Column: return F.greatest(x - y, F.lit(0.0))  # noqa: E704
def copysign(x: Column, y: Column) -> Column: return F.when(signbit(y), -F.abs(x)).otherwise(F.abs(x))  # noqa: E704
def cbrt(x): return F.cbrt(x)  # noqa: E704
def hypot(x, y): return F.hypot(x, y)  # noqa: E704
def exp2(x): return F.pow(F.lit(2.0), x)  # noqa: E704
def expm1(x): return F.expm1(x)  # noqa: E704
def log1p(x): return F.log1p(x)  # noqa: E704
def logb(x: Column) -> Column: return F.floor(F.log2(F.abs(x)))  # noqa: E704
def ldexp(x: Column, n: int) -> Column: return x * float(2**n)  # noqa: E704
def signbit(x: Column) -> Column: return (x < 0) | F.startswith(x.cast("double").cast("string"), F.lit("-0"))  # noqa: E704


def from_math(name: str):
    """Functions that only the standard library has: erf, erfc, gamma."""
    f = getattr(math, name)

    def run(x: pd.Series) -> pd.Series:
        return x.map(f, na_action="ignore")

    return F.pandas_udf(run, "double")


# bits


def lsh(x: Column, n: int) -> Column: return F.shiftleft(x, n)  # noqa: E704
def rsh(x: Column, n: int) -> Column: return F.shiftright(x, n)  # noqa: E704
def bit_at(x: Column, i: int) -> Column: return F.getbit(x, F.lit(i))  # noqa: E704
def bit_set(x: Column, i: int, v: int) -> Column: return x.bitwiseOR(1 << i) if v else x.bitwiseAND(~(1 << i))  # noqa: E704
def bit_clear(x: Column, y: Column) -> Column: return x.bitwiseAND(F.bitwise_not(y))  # noqa: E704
def ones_count(x): return F.bit_count(x)  # noqa: E704
def bit_len(x: Column) -> Column: return F.when(x == 0, 0).otherwise(F.length(F.bin(F.abs(x))))  # noqa: E704


# conversion


def atoi(s: Column) -> Column: return F.when(s.rlike(r"^[+-]?[0-9]+\z"), s.try_cast("long"))  # noqa: E704
def parse_int(s: Column, base: int) -> Column:
    """Null unless the whole text is a number of the base that fits 64 bits."""
    digit = f"0-{chr(47 + min(base, 10))}" + (f"a-{chr(86 + base)}A-{chr(54 + base)}" if base > 10 else "")
    body = F.regexp_replace(s, "^[+-]?0*", "")
    value = F.conv(F.when(body == "", "0").otherwise(body), base, 10).try_cast("decimal(20,0)")
    fits = F.length(body) <= F.lit(next(n for n in range(1, 65) if base**n >= 2**63))
    return F.when(s.rlike(rf"^[+-]?[{digit}]+\z") & fits, F.when(F.startswith(s, F.lit("-")), -value).otherwise(value).try_cast("long"))
def format_int(x: Column, base: int) -> Column: return F.when(x < 0, F.concat(F.lit("-"), F.lower(F.conv(F.abs(x).cast("string"), 10, base)))).otherwise(F.lower(F.conv(x.cast("string"), 10, base)))  # noqa: E704
def parse_bool(s: Column) -> Column: return F.when(s.isin("1", "t", "T", "true", "TRUE", "True"), True).when(s.isin("0", "f", "F", "false", "FALSE", "False"), False)  # noqa: E704
def format_bool(b): return b.cast("string")  # noqa: E704
def parse_float(s): return s.try_cast("double")  # noqa: E704
def quote(s: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), s, F.lit('"'))


# time: RFC 3339 texts and nanosecond durations


def time_valid(s: Column) -> Column: return F.coalesce(s.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]\d\d:\d\d)\z") & F.left(s, F.lit(10)).try_cast("date").isNotNull(), F.lit(False))  # noqa: E704
def unix(seconds: Column) -> Column: return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")  # noqa: E704
def to_unix(s: Column) -> Column: return F.unix_seconds(F.try_to_timestamp(s))  # noqa: E704
def time_split(t: Column) -> Column:
    return F.struct(F.year(t).alias("year"), F.month(t).alias("month"), F.dayofmonth(t).alias("day"), F.hour(t).alias("hour"), F.minute(t).alias("minute"), F.second(t).alias("second"))
#: Nanoseconds of the units of a duration.
UNITS = {"h": 3_600_000_000_000, "m": 60_000_000_000, "s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}
def parse_duration(s: Column) -> Column:
    """Nanoseconds of a sum of numbers with units; null for any other text."""
    number = r"(?:\d+\.?\d*|\.\d+)"
    parts = F.regexp_extract_all(s, F.lit(rf"({number}(?:h|ms|us|\u00b5s|ns|m|s))"), 1)

    def value(part: Column) -> Column:
        unit = F.regexp_replace(F.regexp_replace(part, "[0-9.]", ""), "\u00b5", "u")
        scale = F.lit(None).cast("decimal(20,0)")
        for u, n in UNITS.items():
            scale = F.when(unit == u, F.lit(n).cast("decimal(20,0)")).otherwise(scale)
        return F.regexp_extract(part, "[0-9.]+", 0).try_cast("decimal(18,9)") * scale

    total = F.aggregate(parts, F.lit(0).cast("decimal(38,9)"), lambda t, p: (t + value(p)).cast("decimal(38,9)"))
    whole = F.floor(total).try_cast("long")
    return F.when(s.rlike(rf"^[+-]?(?:{number}(?:h|ms|us|\u00b5s|ns|m|s))+\z"), F.when(F.startswith(s, F.lit("-")), -whole).otherwise(whole)).when(s.rlike(r"^[+-]?0\z"), 0)


def format_duration(ns: Column) -> Column:
    """Like 1h2m3.5s; below a second in the largest unit that is not over it."""
    n = F.abs(ns.cast("decimal(20,0)"))
    digits = lambda unit, places: F.regexp_replace((n / F.lit(unit)).cast(f"decimal(30,{places})").cast("string"), r"\.?0+\z", "") if places else n.cast("string")
    trimmed = lambda unit, places: F.when(n % unit == 0, F.call_function("div", n, F.lit(unit).cast("decimal(20,0)")).cast("string")).otherwise(digits(unit, places))
    over = n - n % F.lit(60_000_000_000)
    rest = (n - over) / F.lit(1_000_000_000)
    seconds = F.concat(F.when(n % 1_000_000_000 == 0, rest.cast("long").cast("string")).otherwise(F.regexp_replace(rest.cast("decimal(20,9)").cast("string"), r"0+\z", "")), F.lit("s"))
    minutes = F.call_function("div", over, F.lit(60_000_000_000).cast("decimal(20,0)"))
    long = F.when(minutes == 0, seconds).when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m"), seconds)).otherwise(F.concat(F.call_function("div", minutes, F.lit(60)).cast("string"), F.lit("h"), (minutes % 60).cast("string"), F.lit("m"), seconds))
    small = F.when(n == 0, "0s").when(n < 1_000, F.concat(n.cast("string"), F.lit("ns"))).when(n < 1_000_000, F.concat(trimmed(1_000, 3), F.lit("\u00b5s"))).when(n < 1_000_000_000, F.concat(trimmed(1_000_000, 6), F.lit("ms")))
    return F.concat(F.when(ns < 0, "-").otherwise(""), small.otherwise(long))
def duration_valid(s: Column) -> Column: return parse_duration(s).isNotNull()  # noqa: E704
def to_unix_nano(s: Column) -> Column: return to_unix(s) * 1_000_000_000 + F.rpad(F.regexp_extract(s, r"\.(\d{1,9})", 1), 9, "0").cast("long")  # noqa: E704


# counts over lists and maps


def match_n(a: Column, n: int, test) -> Column: return F.size(F.filter(a, test)) == n  # noqa: E704
def min_fields(m: Column, n: int) -> Column: return F.size(m) >= n  # noqa: E704
def max_fields(m: Column, n: int) -> Column: return F.size(m) <= n  # noqa: E704
