"""OpenAPI components and Kubernetes resource definitions to schemas.

Both are written as JSON Schema with words of their own, which are put into JSON Schema's terms first. Annotations
(``example``, ``xml``, ``externalDocs``, ``discriminator``, other ``x-`` words) say nothing about values. The kinds of lists
and maps, merge keys and rules in an expression language (``x-kubernetes-validations``) are not checked.
"""

from __future__ import annotations

from ..operators import schema as S
from . import jsonschema

_ANNOTATIONS = ("example", "xml", "externalDocs", "discriminator")
#: What every resource has beside its own fields.
_RESOURCE = {"apiVersion": {"type": "string"}, "kind": {"type": "string"}, "metadata": {"type": "object"}}
#: Words whose values are schemas by name, lists of schemas, and schemas.
_BY_NAME, _LISTS, _ONE = ("properties", "patternProperties"), ("allOf", "anyOf", "oneOf"), ("items", "additionalProperties", "not")


def plain(doc: dict | bool, closed: bool = False) -> dict | bool:
    """A schema in JSON Schema's words. ``closed``: objects with properties refuse others, unless they say otherwise."""
    if isinstance(doc, bool):
        return doc
    if "$ref" in doc:
        return {"$ref": doc["$ref"]}
    out = {k: v for k, v in doc.items() if k not in _ANNOTATIONS and not k.startswith("x-") and k != "nullable"}
    for k in out:
        if k in _BY_NAME:
            out[k] = {n: plain(d, closed) for n, d in out[k].items()}
        elif k in _LISTS:  # parts of one value: none of them closes it
            out[k] = [plain(d) for d in out[k]]
        elif k in _ONE:
            out[k] = plain(out[k], closed and k != "not")
    if doc.get("x-kubernetes-int-or-string"):
        out.pop("type", None)
        out.setdefault("anyOf", [{"type": "integer"}, {"type": "string"}])
    if doc.get("x-kubernetes-embedded-resource"):
        out["properties"] = _RESOURCE | out.get("properties", {})
        out["required"] = sorted({"apiVersion", "kind", *out.get("required", [])})
    if closed and "properties" in out and not doc.get("x-kubernetes-preserve-unknown-fields"):
        out.setdefault("additionalProperties", False)
    return {"anyOf": [{"type": "null"}, out]} if doc.get("nullable") else out


def components(doc: dict) -> list[str]:
    """Names of the schemas of a document."""
    return list(doc.get("components", {}).get("schemas", {}))


def extract(doc: dict, name: str) -> S.Schema:
    """A named schema of an OpenAPI document; KeyError if there is none."""
    schemas = {n: plain(d) for n, d in doc["components"]["schemas"].items()}
    return jsonschema.extract(schemas[name], {"components": {"schemas": schemas}})


def resource(doc: dict, version: str | None = None) -> S.Schema:
    """The schema of a resource definition's version (default: the stored one). Unknown fields are refused where the definition drops them."""
    for v in doc["spec"]["versions"]:
        if v["name"] == version or (version is None and v.get("storage")):
            own = v["schema"]["openAPIV3Schema"]
            return jsonschema.extract(plain(own | {"properties": _RESOURCE | own.get("properties", {})}, closed=True))
    raise KeyError(version or "stored version")
