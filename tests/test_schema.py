"""The lattice, by the tables of the constraint language's specification, and its compilation."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldspar.operators import schema as S
from veldspar.sources import jsonschema

INT = S.Kind("int")
simple = st.one_of(
    st.sampled_from([S.Any(), INT, S.Kind("number"), S.Kind("string"), S.Const("x")]),
    st.builds(S.Const, st.integers(0, 5)),
    st.builds(S.Bound, st.sampled_from(["<", "<=", ">", ">="]), st.integers(0, 5)),
)


@given(simple, simple)
def test_unify_commutes(a, b):
    x, y = a & b, b & a
    assert isinstance(x, S.Nothing) == isinstance(y, S.Nothing)
    if not isinstance(x, S.Nothing):
        assert set(x.parts if isinstance(x, S.All) else [x]) == set(y.parts if isinstance(y, S.All) else [y])


@given(simple, simple)
def test_unified_is_subsumed(a, b):
    assert (a & a) == a
    x = a & b
    if not isinstance(x, S.Nothing | S.All):
        assert S.subsumes(a, x)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (S.Bound(">=", 0), S.Bound(">=", 3), S.Bound(">=", 3)),
        (S.Bound(">", 3), S.Bound(">=", 3), S.Bound(">", 3)),
        (S.Const(1), S.Const(2), None),
        (S.Const(1), S.Const(1.0), None),
        (S.Bound(">", 5), S.Bound("<", 2), None),
        (S.Const(7), S.Bound("<", 10), S.Const(7)),
    ],
)
def test_bounds(a, b, want):
    got = a & b
    assert isinstance(got, S.Nothing) if want is None else got == want


def test_no_integer_between():
    assert isinstance(INT & S.Bound(">", 1) & S.Bound("<", 2), S.Nothing)


def test_defaults():
    tcp = S.Const("tcp").default() | S.Const("udp")
    assert S.default_of(tcp) == S.Const("tcp")
    assert S.default_of(tcp & (S.Const("tcp") | S.Const("udp").default())) != S.Const("tcp")
    assert (tcp & S.Const("udp")) == S.Const("udp")
    assert S.default_of((S.Const(1).default() | INT) & S.Bound(">", 0)) == S.Const(1)


def test_closed_structs():
    a = S.struct(True, x=INT)
    assert isinstance(a & S.struct(y=INT), S.Nothing)
    assert isinstance(S.struct(x=INT) & S.struct(y=INT), S.Struct)
    assert S.subsumes(S.struct(x=INT), S.struct(x=S.Const(1), y=INT))
    assert not S.subsumes(a, S.struct(x=S.Const(1), y=INT))


def test_lists():
    assert isinstance(S.ListOf((INT,), None) & S.ListOf((INT, INT), None), S.Nothing)
    assert (S.ListOf((S.Any(),), INT) & S.ListOf((INT,), S.Bound(">", 0))).prefix == (INT,)


def test_violations(spark):
    df = spark.createDataFrame([(1, "a", [1, 2]), (9, None, []), (None, "abc\n", [5])], "n int, s string, l array<int>")
    schema = S.struct(n_req=S.Bound("<", 5), s_opt=S.Bound("=~", "c$"), l=S.ListOf((), S.Bound("<", 3), 1))
    got = [[v["path"] + ":" + v["code"] for v in r["violations"]] for r in S.vet(df, schema).collect()]
    assert got == [["s:bound"], ["n:bound", "l:length"], ["n:required", "s:bound", "l.0:value"]]


def test_complete_and_trim(spark):
    s = S.Const("O").default() | S.Kind("string")
    df = spark.createDataFrame([("F",), (None,)], "v string")
    done = df.select(S.complete(s, df["v"]).alias("v"))
    assert [r["v"] for r in done.collect()] == ["F", "O"]
    assert [r["v"] for r in done.select(S.trim(s, done["v"]).alias("v")).collect()] == ["F", None]


def test_maps(spark):
    df = spark.createDataFrame([({"k": 1},), ({"k": 60, "z": 1},), ({},)], "m map<string,int>")
    s = S.Struct((("k", S.Field(S.Bound("<", 50), "required")),), (), True)
    got = df.select(S.map_violations(s, F.col("m")).alias("v")).collect()
    assert [[x["path"] for x in r["v"]] for r in got] == [[], ["k", "z"], ["k"]]


@pytest.mark.parametrize(
    "doc",
    [
        {"type": "integer", "minimum": 3, "maximum": 9},
        {"enum": ["a", "b"], "default": "a"},
        {"type": "object", "properties": {"a": {"type": "string"}}, "required": ["a"], "additionalProperties": False},
        {"type": "array", "items": {"type": "integer"}, "minItems": 1, "uniqueItems": True},
    ],
)
def test_json_schema_round_trip(doc):
    s = jsonschema.extract(doc)
    assert jsonschema.extract(jsonschema.generate(s)) == s


def test_json_schema_refs():
    s = jsonschema.extract({"$ref": "#/$defs/p", "$defs": {"p": {"minimum": 1}}})
    assert s == S.MatchIf(S.Kind("number"), S.Bound(">=", 1), S.Any())
    with pytest.raises(ValueError):
        jsonschema.extract({"unheardOf": 1})


def test_types():
    t = S.to_type(S.struct(a=INT, b_opt=S.Kind("string"), c=S.ListOf(rest=S.Kind("float"))))
    assert t.simpleString() == "struct<a:bigint,b:string,c:array<double>>"
    assert S.subsumes(S.from_type(t), S.from_type(t))


def test_kinds_are_checked(spark):
    df = spark.createDataFrame([(1, "7", 1.5, [1]), (2, "x", 2.0, [])], "i int, s string, d double, l array<int>")
    bad = lambda s: [sorted((v["path"], v["code"]) for v in r["violations"]) for r in S.vet(df, s).orderBy("i").collect()]
    assert bad(S.struct(i=S.Kind("string"), s=INT, d=INT, l=S.struct(x=INT))) == [[("d", "kind"), ("i", "kind"), ("l", "kind"), ("s", "kind")], [("i", "kind"), ("l", "kind"), ("s", "kind")]]
    assert bad(S.struct(i=S.Kind("number"), s=S.Kind("string"), d=S.Kind("number"), l=S.Kind("list"))) == [[], []]
    assert bad(S.struct(s=S.Bound(">=", 5), i=S.Bound("=~", "a"))) == [[("i", "bound"), ("s", "bound")]] * 2
    dynamic = df.orderBy("i").select(S.matches(INT, df["d"]).alias("d"), S.matches(INT, df["s"]).alias("s"), S.matches(S.Bound(">=", 5), df["s"]).alias("b"), S.matches(S.Const(7), df["s"]).alias("c")).collect()
    assert [tuple(r) for r in dynamic] == [(False, False, False, False), (True, False, False, False)]


def test_variants(spark):
    df = spark.sql("SELECT parse_json(x) AS v, n FROM VALUES ('1', 0), ('\"a\"', 1), ('[1]', 2), ('2.5', 3) AS t(x, n)").orderBy("n")
    t = df.schema["v"].dataType
    got = df.select(*[S.matches(s, df["v"], t).alias(str(i)) for i, s in enumerate((INT, S.Kind("string"), S.Kind("list"), S.Bound(">", 2)))]).collect()
    assert [tuple(r) for r in got] == [(True, False, False, False), (False, True, False, False), (False, False, True, False), (False, False, False, True)]


def test_nested_patterns_and_closedness(spark):
    df = spark.createDataFrame([((1, 2, 3),), ((5, None, None),)], "a struct<x1:int,x2:int,y:int>")
    s = S.struct(a=S.Struct((), (("^x", S.Bound("<", 2)),), True))
    got = [sorted((v["path"], v["code"]) for v in r["violations"]) for r in S.vet(df, s).collect()]
    assert got == [[("a.x2", "bound"), ("a.y", "closed")], [("a.x1", "bound")]]
    assert [[v["path"] for v in r["violations"]] for r in S.vet(df, S.struct(True, b_opt=INT)).collect()] == [["a"], ["a"]]


@pytest.mark.parametrize(
    ("doc", "good"),
    [
        ({"minProperties": 2}, [0]), ({"maxProperties": 1}, [1, 2]), ({"propertyNames": {"pattern": "^[ab]$"}}, [0, 1]), ({"dependentRequired": {"a": ["b"]}}, [0, 2]), ({"dependencies": {"a": {"required": ["b"]}}}, [0, 2]),
        ({"type": "object", "properties": {"a": {}}, "additionalProperties": {"minimum": 4}}, [1, 2]), ({"properties": {"a": {"type": "string"}}}, [2]), ({"properties": {"a": {"minLength": 9}}}, [0, 1, 2]), ({"type": "array"}, []),
    ],
)
def test_json_schema_object_keywords(spark, doc, good):
    df = spark.createDataFrame([(0, (1, 2, None)), (1, (1, None, None)), (2, (None, None, 5))], "n int, o struct<a:int,b:int,c:int>")
    s = jsonschema.extract(doc)
    assert [r["n"] for r in df.where(S.matches(s, df["o"], df.schema["o"].dataType)).orderBy("n").collect()] == good


def test_json_schema_lists_and_recursion(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, [7, 8, 9]), (2, [])], "n int, l array<int>")
    good = lambda doc: [r["n"] for r in df.where(S.matches(jsonschema.extract(doc), df["l"], df.schema["l"].dataType)).orderBy("n").collect()]
    assert good({"contains": {"minimum": 7}}) == [1] and good({"contains": {"minimum": 7}, "maxContains": 2, "minContains": 0}) == [0, 2]
    assert good({"items": [{"minimum": 0}], "additionalItems": {"minimum": 8}}) == [1, 2]
    with pytest.raises(ValueError, match="recursive"):
        jsonschema.extract({"properties": {"next": {"$ref": "#"}}})
