"""Arithmetic with kinds, lengths, literals and comparators on small values."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldspar.functions import arithmetic as A

I, L, D, S, B = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.BinaryType()


def test_operations(spark):
    n = lambda v: F.lit(v)
    todo = [
        (A.add(n(2147483647), I, n(1), I), 2147483648), (A.add(n((1 << 63) - 1).cast("long"), L, n(1), I), None), (A.add(n("a"), S, n("b"), S), "ab"), (A.add(n(1), I, n(0.5), D), 1.5), (A.subtract(n(1), I, n(3), I), -2),
        (A.multiply(n("ab"), S, n(2), I), "abab"), (A.multiply(n(3), I, n("a"), S), "aaa"), (A.multiply(n("a"), S, n(-1), I), None), (A.multiply(n("a"), S, n(0), I), ""), (A.multiply(n("a"), S, n(1_000_001), I), None), (A.multiply(n(3), I, n(4), I), 12),
        (A.divide(n(6), I, n(3), I), 2.0), (A.divide(n(1), I, n(0), I), None), (A.length(n("é"), S), 2), (A.length(F.array(n(1), n(2)), T.ArrayType(I)), 2), (A.length(F.lit(None).cast("array<int>"), T.ArrayType(I)), None),
        (A.length(F.struct(n(1).alias("a"), F.lit(None).cast("int").alias("b")), T.StructType([T.StructField("a", I), T.StructField("b", I)])), 1),
        (A.sort_by(F.array(*map(n, (3, -1, 1, -3, 2))), lambda x, y: F.abs(x) < F.abs(y)), [-1, 1, 2, 3, -3]), (A.sort_by(F.array(n("b"), F.lit(None), n("a")), lambda x, y: x > y), ["b", None, "a"]),
    ]
    got = spark.range(1).select(*[c.alias(str(i)) for i, (c, _) in enumerate(todo)]).first()
    assert [got[i] for i in range(len(todo))] == [want for _, want in todo]


def test_literals(spark):
    want = {
        "0": 0, "1_000": 1000, "0x1F": 31, "0o17": 15, "0b1_1": 3, "4Ki": 4096, "1.5G": 1_500_000_000, "2e3": 2000, ".5": Decimal("0.5"), "1.": 1, "0xffffffffffffffff": (1 << 64) - 1, "0x1ffffffffffffffff": None,
        "1__0": None, "_1": None, "1_": None, "01": None, "0x": None, "4Kib": None, "": None, "a": None, "1e999": None, "1\n": None, "2P": 2 * 10**15,
    }
    rows = spark.createDataFrame([(k,) for k in [*want, None]], "s string").select("s", A.number_literal(F.col("s")).alias("n")).collect()
    assert {r["s"]: r["n"] for r in rows} == want | {None: None}


@pytest.mark.parametrize(("f", "a", "b"), [(A.add, S, I), (A.add, T.ArrayType(I), T.ArrayType(I)), (A.subtract, S, S), (A.multiply, T.ArrayType(I), I), (A.multiply, S, D), (A.divide, B, B)])
def test_kinds_that_do_not_go_together(f, a, b):
    with pytest.raises(TypeError):
        f(F.lit(1), a, F.lit(1), b)
