"""Unification, difference and comprehension operators on whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unify_aggregate(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """All partial records of a key as one: a field's value if all that have one agree, else null and ``<field>_conflict``.

    Least and greatest combine before the shuffle, so a hot key costs no more than any other.
    """
    out = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in fields for n, f in (("lo", F.min), ("hi", F.max))])
    clash = {c: F.coalesce(F.col(f"_lo_{c}") != F.col(f"_hi_{c}"), F.lit(False)) for c in fields}
    return out.select(*keys, *[F.when(~clash[c], F.col(f"_lo_{c}")).alias(c) for c in fields], *[clash[c].alias(f"{c}_conflict") for c in fields])


def unify_frames(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables merged by key: fields of either side, a conflict where both have one and they differ. Keys are unique in each."""
    shared = [c for c in a.columns if c in b.columns and c not in keys]
    x, y = a.alias("x"), b.alias("y")
    j = x.join(y, reduce(Column.__and__, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]), "full_outer")
    out = [F.coalesce(F.col(f"x.{k}"), F.col(f"y.{k}")).alias(k) for k in keys]
    for c in shared:
        clash = F.coalesce(F.col(f"x.{c}") != F.col(f"y.{c}"), F.lit(False))
        out += [F.when(~clash, F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}"))).alias(c), clash.alias(f"{c}_conflict")]
    out += [F.col(f"x.{c}") for c in a.columns if c not in keys and c not in shared] + [F.col(f"y.{c}") for c in b.columns if c not in keys and c not in shared]
    return j.select(*out)


def layered(df: DataFrame, keys: list[str], field: str, priority: str) -> DataFrame:
    """One value a key: of values that differ the one with the highest priority wins (the greatest on a tie)."""
    return df.groupBy(*keys).agg(F.max(F.struct(priority, field)).getField(field).alias(field))


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """key, change: removed, added, modified or identical."""
    fields = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*fields).alias("a"))
    b = new.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*fields).alias("b"))
    j = a.join(b, reduce(Column.__and__, [F.col(k) == F.col(f"_{k}") for k in keys]), "full_outer")
    change = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a").eqNullSafe(F.col("b")), "identical").otherwise("modified")
    return j.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], change.alias("change"))


def lookup(df: DataFrame, table: DataFrame, key: str, by: str, most_rows: int = 100_000, most_bytes: int = 64 << 20) -> DataFrame:
    """``table[key]`` for each row: broadcast if the table has at most ``most_rows`` rows of ``most_bytes`` as JSON, else a shuffled join."""
    rows, size = table.limit(most_rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()
    small = rows <= most_rows and size <= most_bytes
    return df.join(F.broadcast(table) if small else table, df[key] == table[by], "left")


def keyed(df: DataFrame, key: str, value: str) -> DataFrame:
    """``{for x in df {"\\(key)": value}}``: values of equal keys must be equal."""
    return unify_aggregate(df, [key], [value])


def take(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def nth_range(df: DataFrame, low: int, high: int, *order: Column | str) -> DataFrame:
    """Rows low (included) to high (excluded) in order."""
    return df.orderBy(*order).offset(low).limit(high - low)


def is_sorted(df: DataFrame, group: str, by: str, *order: str) -> DataFrame:
    """Per group whether ``by`` never falls in the given order."""
    before = F.lag(by).over(Window.partitionBy(group).orderBy(*order))
    return df.select(group, F.coalesce(before > F.col(by), F.lit(False)).alias("_falls")).groupBy(group).agg((~F.bool_or("_falls")).alias("is_sorted"))


def unique_items(df: DataFrame, group: str, item: str) -> DataFrame:
    """Per group whether no item comes twice; two partial aggregations, no list is built."""
    return df.groupBy(group, item).agg(F.count("*").alias("_n")).groupBy(group).agg((F.max("_n") == 1).alias("unique_items"))
