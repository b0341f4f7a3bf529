"""Walk, fields, fill at a path, equality, pointers and interpolation on small values."""

import pytest
from pyspark.sql import functions as F

from veldspar.operators import schema as S
from veldspar.operators import values as V


@pytest.fixture(scope="module")
def one(spark):
    return spark.sql("""SELECT named_struct('a', 1, 'b', named_struct('x y', CAST(NULL AS INT), 'c', array(named_struct('d', 'q'), NULL)), 'm', map('k~/', array(1, NULL)), 'e', array()) AS v,
        CAST(NULL AS STRUCT<a: INT, m: MAP<STRING, INT>>) AS n, map('p', map(1, 2, 3, 4)) AS p, map('p', map(3, 4, 1, 2)) AS q""")


def kind(d, name):
    return d.schema[name].dataType


def test_walk(one):
    got = one.select(V.walk(one["v"], kind(one, "v")).alias("w"), V.walk(one["n"], kind(one, "n")).alias("n"), V.fields(one["v"], kind(one, "v")).alias("f"), V.fields(one["p"], kind(one, "p")).alias("g")).first()
    assert [tuple(x) for x in got["w"]] == [("a", "/a", "1"), ("b.c[0].d", "/b/c/0/d", "q"), ('m."k~/"[0]', "/m/k~0~1/0", "1"), ('m."k~/"[1]', "/m/k~0~1/1", None)]
    assert got["n"] == [] and got["f"] == ["a", "b", "m", "e"] and got["g"] == ["p"]


def test_equals(one):
    p, n = kind(one, "p"), kind(one, "n")
    got = one.select(V.equals(one["p"], one["q"], p), V.equals(one["n"], one["n"], n), V.equals(one["p"], F.lit(None).cast(p), p)).first()
    assert tuple(got) == (True, True, False)


def test_fill_path(one):
    v = kind(one, "v")
    for path, what, conflict, pointer, want in (
        ("a", F.lit(1), False, "/a", 1), ("a", F.lit(2), True, "/a", 1), ("a", F.lit("no"), True, "/a", 1), ("b.x y", F.lit(7), False, "/b/x y", 7), ("b.x y", F.lit("no"), True, "/b/x y", None),
        ("b.new.z", F.lit(3), False, "/b/new/z", 3), ("a.z", F.lit(3), True, "/a", 1), ("a", F.lit(None), False, "/a", 1),
    ):
        filled, bad = V.fill_path(one["v"], v, path, what)
        d = one.select(filled.alias("f"), bad.alias("bad"))
        assert tuple(d.select(V.at_pointer(d["f"], kind(d, "f"), pointer), "bad").first()) == (want, conflict), path
    filled, bad = V.fill_path(one["n"], kind(one, "n"), "a", F.lit(5))
    assert one.select(filled["a"], bad).first()[:] == (5, False)


def test_pointer_allows_interpolate(one):
    v = kind(one, "v")
    at = lambda p: V.at_pointer(one["v"], v, p)
    got = one.select(at("/b/c/0/d"), at("/b/c/9/d"), at("/m/k~0~1/0"), at("/m/none/0"), at("/z"), at("/b/c/01"), V.interpolate(r"<\(x)|\( y )>", x=one["v"]["a"], y=F.lit("1.50").cast("decimal(5,2)")), V.interpolate(r"\(x)", x=F.lit(None)), V.interpolate("plain")).first()
    assert tuple(got) == ("q", None, 1, None, None, None, "<1|1.50>", None, "plain")
    with pytest.raises(ValueError, match="JSON Pointer"):
        at("b")
    s = S.Struct((("a", S.Field(S.Any())),), (("^x", S.Any()),), True)
    assert [V.allows(s, n) for n in ("a", "xy", "b")] == [True, True, False] and V.allows(S.Struct(()), "b")
