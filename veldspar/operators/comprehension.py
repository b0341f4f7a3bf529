"""Comprehensions over tables: for, if, let, joins, lookups and fallbacks, as one lazy DataFrame plan.

``each(orders).if_("o_totalprice > 10").let(net="o_totalprice * 2").yield_("o_orderkey", "net")``

A second ``for`` always comes with the condition that binds it: equalities become shuffled or broadcast joins, whichever
Spark picks; nothing is multiplied out first. Clauses apply in the order they are written.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _expr(c: Column | str) -> Column:
    return F.expr(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Comprehension:
    rows: DataFrame

    def if_(self, condition: Column | str) -> Comprehension:
        """Rows for which the condition is true; a null is not."""
        return replace(self, rows=self.rows.where(_expr(condition)))

    def let(self, **names: Column | str) -> Comprehension:
        """Names for expressions, usable from the next clause on."""
        return replace(self, rows=self.rows.withColumns({n: _expr(c) for n, c in names.items()}))

    def for_(self, other: DataFrame, on: Column | str) -> Comprehension:
        """Every pair with a row of another table that satisfies ``on``."""
        return replace(self, rows=self.rows.join(other, _expr(on)))

    def where_any(self, other: DataFrame, on: Column | str) -> Comprehension:
        """Rows that have a partner in another table, once each."""
        return replace(self, rows=self.rows.join(other, _expr(on), "left_semi"))

    def where_none(self, other: DataFrame, on: Column | str) -> Comprehension:
        """Rows without a partner in another table."""
        return replace(self, rows=self.rows.join(other, _expr(on), "left_anti"))

    def try_(self, other: DataFrame, on: Column | str, **fallback: object) -> Comprehension:
        """Every row with its partners, or with nulls where there is none; ``fallback`` values stand for nulls of its columns."""
        rows = self.rows.join(other, _expr(on), "left")
        return replace(self, rows=rows.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in fallback.items()}))

    def yield_(self, *columns: Column | str, **named: Column | str) -> DataFrame:
        return self.rows.select(*columns, *[_expr(c).alias(n) for n, c in named.items()])


def each(rows: DataFrame) -> Comprehension:
    return Comprehension(rows)


def or_else(result: DataFrame, fallback: DataFrame) -> DataFrame:
    """The rows of ``result``, or those of ``fallback`` if it has none; at most one row of it is looked at for that."""
    there = result.limit(1).select(F.lit(1).alias("_there"))
    return result.unionByName(fallback.withColumn("_one", F.lit(1)).join(there, F.col("_one") == F.col("_there"), "left_anti").drop("_one"))
