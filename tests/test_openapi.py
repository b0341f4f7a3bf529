"""OpenAPI components and resource definitions, applied to small JSON values."""

import pytest

from veldspar.operators import schema as S
from veldspar.sources import openapi

DOC = {"components": {"schemas": {
    "Size": {"type": "integer", "minimum": 1, "example": 3, "x-note": "any"},
    "Item": {"type": "object", "required": ["size"], "properties": {"size": {"$ref": "#/components/schemas/Size"}, "name": {"type": "string", "nullable": True, "maxLength": 3}}, "xml": {"name": "i"}},
}}}
CRD = {"spec": {"versions": [
    {"name": "v1alpha1", "schema": {"openAPIV3Schema": {"type": "object"}}},
    {"name": "v1", "storage": True, "schema": {"openAPIV3Schema": {"type": "object", "properties": {"spec": {"type": "object", "properties": {
        "port": {"x-kubernetes-int-or-string": True}, "tags": {"type": "array", "items": {"type": "string"}, "x-kubernetes-list-type": "set"},
    }}}}}},
]}}


def ok(spark, schema, sql):
    d = spark.sql(f"SELECT {sql} AS v")
    return d.select(S.matches(schema, d["v"], d.schema["v"].dataType)).first()[0]


@pytest.mark.parametrize(("value", "want"), [
    ("named_struct('size', 2, 'name', 'abc')", True), ("named_struct('size', 0, 'name', 'abc')", False), ("named_struct('size', 2, 'name', 'abcd')", False),
    ("named_struct('size', 2, 'name', CAST(NULL AS STRING))", True), ("named_struct('name', 'a')", False), ("named_struct('size', 2, 'more', 1)", True), ("named_struct('size', 'two')", False),
])
def test_component(spark, value, want):
    assert ok(spark, openapi.extract(DOC, "Item"), value) is want


@pytest.mark.parametrize(("value", "want"), [
    ("named_struct('kind', 'A', 'spec', named_struct('port', 80, 'tags', array('a', 'b')))", True), ("named_struct('spec', named_struct('port', 'http'))", True), ("named_struct('spec', named_struct('port', 1.5))", False),
    ("named_struct('spec', named_struct('tags', array('a', 'a')))", True), ("named_struct('spec', named_struct('tags', array(1)))", False), ("named_struct('spec', named_struct('other', 1))", False), ("named_struct('other', 1)", False), ("named_struct('metadata', named_struct('name', 'x'))", True),
])
def test_resource(spark, value, want):
    assert ok(spark, openapi.resource(CRD), value) is want


def test_edges(spark):
    assert openapi.components(DOC) == ["Size", "Item"]
    assert ok(spark, openapi.resource(CRD, "v1alpha1"), "named_struct('kind', 'A')")
    with pytest.raises(KeyError):
        openapi.resource(CRD, "v2")
    with pytest.raises(KeyError):
        openapi.extract(DOC, "None")
    assert openapi.plain({"x-kubernetes-validations": [{"rule": "self > 0"}], "minimum": 1}) == {"minimum": 1}
