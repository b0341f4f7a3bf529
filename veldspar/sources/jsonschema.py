"""JSON Schema documents to schemas, and back."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import schema as S

KINDS = {"null": "null", "boolean": "bool", "integer": "int", "number": "number", "string": "string", "array": "list", "object": "struct"}
#: The formats that are checked.
FORMATS = {
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "date-time": r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$",
    "email": r"^[^@\s]+@[^@\s]+$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:",
    "hostname": r"^(?=.{1,253}$)[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.|$)){4}$",
    "json-pointer": r"^(/([^~/]|~[01])*)*$",
    "time": r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
}
META = ("$schema", "$id", "id", "$comment", "title", "description", "examples", "deprecated", "readOnly", "writeOnly", "$defs", "definitions", "default", "contentMediaType", "contentEncoding", "contentSchema", "$vocabulary", "example", "externalDocs", "xml", "discriminator")


def extract(doc: dict | bool, root: dict | None = None, within: tuple[str, ...] = ()) -> S.Schema:
    """The schema of a document; keywords that are neither enforced nor annotations are refused, as are recursive references.

    A keyword of one type (a bound, a pattern, properties, items) passes values of other types, unless ``type`` refuses them.
    """
    if isinstance(doc, bool):
        return S.Any() if doc else S.Nothing("false schema")
    root = doc if root is None else root
    if "$ref" in doc:
        if doc["$ref"] in within:
            raise ValueError(f"recursive reference: {doc['$ref']}")
        return extract(_resolve(doc["$ref"], root), root, (*within, doc["$ref"]))
    sub = lambda d: extract(d, root, within)
    only_type = {KINDS[doc["type"]]} if isinstance(doc.get("type"), str) else set()

    def of(kind: str, s: S.Schema) -> S.Schema:
        """Under the condition that a value has the kind."""
        return s if only_type and only_type <= {kind, *(("int",) if kind == "number" else ())} else S.MatchIf(S.Kind(kind), s, S.Any())

    keys = lambda c: F.json_object_keys(F.to_json(c))
    parts: list[S.Schema] = []
    done = set(META)

    def use(*names: str) -> bool:
        done.update(names)
        return names[0] in doc

    if use("type"):
        names = doc["type"] if isinstance(doc["type"], list) else [doc["type"]]
        shapes = {"object": ("properties", "required", "additionalProperties", "patternProperties"), "array": ("items", "prefixItems", "minItems", "maxItems", "uniqueItems")}
        if not (len(names) == 1 and any(k in doc for k in shapes.get(names[0], ()))):  # else the shape itself refuses other kinds
            parts.append(reduce(S.union, [S.Kind(KINDS[n]) for n in names]))
    if use("nullable") and doc["nullable"] and parts:
        parts[-1] = S.union(parts[-1], S.Kind("null"))
    if use("const"):
        parts.append(S.Const(doc["const"]))
    if use("enum"):
        parts.append(S.one_of(*doc["enum"]))
    for word, op in (("minimum", ">="), ("maximum", "<="), ("exclusiveMinimum", ">"), ("exclusiveMaximum", "<")):
        if use(word) and not isinstance(doc[word], bool):
            flag = {"minimum": "exclusiveMinimum", "maximum": "exclusiveMaximum"}.get(word)
            parts.append(of("number", S.Bound(op[0] if flag and doc.get(flag) is True else op, doc[word])))
    if use("multipleOf"):
        m = doc["multipleOf"]
        parts.append(of("number", S.Check(f"multipleOf({m})", lambda c: F.try_mod(c.cast("decimal(30,10)"), F.lit(m).cast("decimal(30,10)")) == 0)))
    if use("minLength"):
        least = doc["minLength"]
        parts.append(of("string", S.Check(f"minLength({least})", lambda c: F.char_length(c) >= least)))
    if use("maxLength"):
        most = doc["maxLength"]
        parts.append(of("string", S.Check(f"maxLength({most})", lambda c: F.char_length(c) <= most)))
    if use("pattern"):
        parts.append(of("string", S.Bound("=~", doc["pattern"])))
    if use("format") and doc["format"] in FORMATS:
        parts.append(of("string", S.Bound("=~", FORMATS[doc["format"]])))
    if use("allOf"):
        parts += map(sub, doc["allOf"])
    if use("anyOf"):
        parts.append(S.MatchN(S.Bound(">=", 1), tuple(map(sub, doc["anyOf"]))))
    if use("oneOf"):
        parts.append(S.MatchN(S.Const(1), tuple(map(sub, doc["oneOf"]))))
    if use("not"):
        parts.append(S.MatchN(S.Const(0), (sub(doc["not"]),)))
    if use("if", "then", "else"):
        parts.append(S.MatchIf(sub(doc["if"]), sub(doc.get("then", True)), sub(doc.get("else", True))))
    if any([use("properties"), use("required"), use("additionalProperties"), use("patternProperties")]):
        required = doc.get("required", [])
        fields = {n: S.Field(sub(d), "required" if n in required else "optional") for n, d in doc.get("properties", {}).items()}
        fields |= {n: S.Field(S.Any(), "required") for n in required if n not in fields}
        patterns = tuple((p, sub(d)) for p, d in doc.get("patternProperties", {}).items())
        more = doc.get("additionalProperties", True)
        if isinstance(more, dict):  # the names that nothing else describes
            named = "|".join(map(re.escape, doc.get("properties", {})))
            patterns += ((rf"^(?!(?:{named})$)" * bool(named) + "".join(rf"(?![\s\S]*?(?:{p}))" for p in doc.get("patternProperties", {})), sub(more)),)
        parts.append(of("struct", S.Struct(tuple(fields.items()), patterns, more is False)))
    if use("minProperties"):
        parts.append(of("struct", S.Check("minProperties", lambda c, n=doc["minProperties"]: F.size(keys(c)) >= n)))
    if use("maxProperties"):
        parts.append(of("struct", S.Check("maxProperties", lambda c, n=doc["maxProperties"]: F.size(keys(c)) <= n)))
    if use("propertyNames"):
        names_as = sub(doc["propertyNames"])
        parts.append(of("struct", S.Check("propertyNames", lambda c: F.forall(keys(c), lambda k: S.matches(names_as, k, T.StringType())))))
    needs: dict = {}
    for word in ("dependentRequired", "dependentSchemas", "dependencies"):
        needs |= doc[word] if use(word) else {}
    for name, need in needs.items():
        has = S.Check(f"has {name}", lambda c, name=name: F.array_contains(keys(c), name))
        then = S.Check(f"with {name}", lambda c, need=need: F.size(F.array_except(F.array(*map(F.lit, need)).cast("array<string>"), keys(c))) == 0) if isinstance(need, list) else sub(need)
        parts.append(of("struct", S.MatchIf(has, then, S.Any())))
    if any([use("items"), use("prefixItems"), use("minItems"), use("maxItems"), use("uniqueItems"), use("additionalItems")]):
        items = doc.get("items", True)
        prefix = doc.get("prefixItems", items if isinstance(items, list) else [])
        items = doc.get("additionalItems", True) if isinstance(items, list) else items
        rest = None if items is False else sub(items)
        parts.append(of("list", S.ListOf(tuple(map(sub, prefix)), rest, doc.get("minItems", 0), doc.get("maxItems"), bool(doc.get("uniqueItems")), bool(prefix))))
    if use("contains", "minContains", "maxContains"):
        inner, least, most = sub(doc["contains"]), doc.get("minContains", 1), doc.get("maxContains", 1 << 31)
        parts.append(of("list", S.Check("contains", lambda c: F.size(F.filter(c, lambda x: S.matches(inner, x))).between(least, most))))
    use("minContains", "maxContains")  # without contains they say nothing
    if unknown := set(doc) - done:
        raise ValueError(f"keywords without a meaning here: {', '.join(sorted(unknown))}")
    out = reduce(S.unify, parts, S.Any())
    return out if "default" not in doc else S.union(S.Const(doc["default"]).default(), out)


def _resolve(ref: str, root: dict) -> dict:
    if not ref.startswith("#"):
        raise ValueError(f"only local references are followed: {ref}")
    at = root
    for step in ref[1:].strip("/").split("/") if ref != "#" else []:
        at = at[step.replace("~1", "/").replace("~0", "~")]
    return at


def generate(s: S.Schema) -> dict:
    """A JSON Schema document of a schema."""
    if isinstance(s, S.Branch):
        return generate(s.schema)
    if isinstance(s, S.Nothing):
        return {"not": {}}
    if isinstance(s, S.Kind):
        return {"type": {v: k for k, v in KINDS.items()}.get(s.name, "number" if s.name == "float" else "string")}
    if isinstance(s, S.Const):
        return {"const": s.value}
    if isinstance(s, S.Bound):
        word = {">=": "minimum", "<=": "maximum", ">": "exclusiveMinimum", "<": "exclusiveMaximum", "=~": "pattern"}.get(s.op)
        return {word: s.value} if word else {"not": {"const": s.value} if s.op == "!=" else {"pattern": s.value}}
    if isinstance(s, S.All):
        docs = [generate(p) for p in s.parts]
        merged = reduce(lambda a, b: a | b, docs)
        return merged if len(merged) == sum(map(len, docs)) else {"allOf": docs}
    if isinstance(s, S.Choice):
        if all(isinstance(b.schema, S.Const) for b in s.branches):
            out: dict = {"enum": [b.schema.value for b in s.branches]}
        else:
            out = {"anyOf": [generate(b.schema) for b in s.branches]}
        d = S.default_of(s)
        return out | ({"default": d.value} if isinstance(d, S.Const) else {})
    if isinstance(s, S.Struct):
        out = {"type": "object", "properties": {n: generate(f.schema) for n, f in s.fields}}
        required = [n for n, f in s.fields if f.presence != "optional"]
        return out | ({"required": required} if required else {}) | ({"additionalProperties": False} if s.closed else {}) | ({"patternProperties": {p: generate(c) for p, c in s.patterns}} if s.patterns else {})
    if isinstance(s, S.ListOf):
        out = {"type": "array"} | ({"prefixItems": list(map(generate, s.prefix))} if s.prefix else {}) | ({"items": False if s.rest is None else generate(s.rest)} if not isinstance(s.rest, S.Any) else {})
        return out | ({"minItems": s.least} if s.least else {}) | ({"maxItems": s.most} if s.most is not None else {}) | ({"uniqueItems": True} if s.unique else {})
    if isinstance(s, S.MatchN):
        docs = list(map(generate, s.schemas))
        if s.count == S.Const(1):
            return {"oneOf": docs}
        return {"not": docs[0]} if s.count == S.Const(0) and len(docs) == 1 else {"anyOf": docs}
    if isinstance(s, S.MatchIf):
        return {"if": generate(s.test), "then": generate(s.then), "else": generate(s.other)}
    return {}
