"""Constraints as values of one lattice, and their compilation to Columns.

A schema is a small immutable tree on the driver. ``a & b`` is the greatest lower bound, ``a | b`` a choice, ``a.default()``
marks the branch of a choice that fills missing data. A schema compiles to ordinary Column expressions:

* ``matches(schema, col)``: boolean, never null;
* ``violations(schema, col, path)``: array of (path, code, message), empty for good data;
* ``complete(schema, col)``: the column with defaults filled in.

Data is always concrete, so a null is an absent field: allowed for optional fields, a violation for required and
regular ones (unless the constraint admits null).

Where the Spark type of a column is given (``vet`` gives it), kinds, patterns over field names and closedness are decided
from it when the plan is built. Without it kinds are compared with typeof(), which Spark folds; names of nested fields are
then not known. A value of another kind is a violation, never a failed cast. Whole doubles are ints.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIOLATION = "array<struct<path:string,code:string,message:string>>"


class Schema:
    def __and__(self, other: Schema) -> Schema:
        return unify(self, lift(other))

    def __or__(self, other: Schema) -> Schema:
        return union(self, lift(other))

    def default(self) -> Branch:
        """This branch as the default of a choice."""
        return Branch(self, True)


@dataclass(frozen=True)
class Any(Schema):
    """Top: everything."""


@dataclass(frozen=True)
class Nothing(Schema):
    """Bottom: no value, and why."""

    why: str = "conflict"


@dataclass(frozen=True)
class Kind(Schema):
    """A type: null, bool, int, float, number, string, bytes, list or struct."""

    name: str


@dataclass(frozen=True)
class Const(Schema):
    value: object

    def __eq__(self, other):
        return isinstance(other, Const) and type(self.value) is type(other.value) and self.value == other.value

    def __hash__(self):
        return hash((type(self.value), repr(self.value)))


@dataclass(frozen=True)
class Bound(Schema):
    """One of < <= > >= != =~ !~ with its operand."""

    op: str
    value: object


@dataclass(frozen=True)
class All(Schema):
    parts: tuple[Schema, ...]


@dataclass(frozen=True)
class Branch(Schema):
    schema: Schema
    marked: bool = False


@dataclass(frozen=True)
class Choice(Schema):
    branches: tuple[Branch, ...]


@dataclass(frozen=True)
class Field:
    schema: Schema
    #: regular, optional (may be absent) or required (the data must have it)
    presence: str = "regular"


@dataclass(frozen=True)
class Struct(Schema):
    """Named fields, constraints on all fields whose names match a pattern, and whether others are refused."""

    fields: tuple[tuple[str, Field], ...]
    patterns: tuple[tuple[str, Schema], ...] = ()
    closed: bool = False


@dataclass(frozen=True)
class ListOf(Schema):
    """A prefix of element constraints, then any number under ``rest`` (None: no more); a ``partial`` prefix need not be filled."""

    prefix: tuple[Schema, ...] = ()
    rest: Schema | None = Any()
    least: int = 0
    most: int | None = None
    unique: bool = False
    partial: bool = False


@dataclass(frozen=True)
class MatchN(Schema):
    """The number of schemas that match satisfies ``count``."""

    count: Schema
    schemas: tuple[Schema, ...]


@dataclass(frozen=True)
class MatchIf(Schema):
    test: Schema
    then: Schema
    other: Schema


@dataclass(frozen=True)
class Check(Schema):
    """A named validator: a function from Column to a boolean Column."""

    name: str
    test: object


def lift(x: object) -> Schema:
    return x if isinstance(x, Schema) else Const(x)


def struct(closed: bool = False, patterns: dict[str, Schema] | None = None, /, **fields: object) -> Struct:
    """``name=schema``; a trailing ``_opt`` or ``_req`` of a name marks it as optional or required."""
    out = []
    for name, s in fields.items():
        for tail, presence in (("_opt", "optional"), ("_req", "required"), ("", "regular")):
            if name.endswith(tail):
                out.append((name[: len(name) - len(tail)], Field(lift(s), presence)))
                break
    return Struct(tuple(out), tuple((patterns or {}).items()), closed)


def between(low: object, high: object) -> Schema:
    return Bound(">=", low) & Bound("<=", high)


def one_of(*values: object) -> Schema:
    return reduce(union, [lift(v) for v in values])


#: Ranges of the sized numbers: (low, high), integers.
RANGES = {f"{'u' * u}int{b}": (0 if u else -(1 << (b - 1)), (1 << (b if u else b - 1)) - 1) for b in (8, 16, 32, 64, 128) for u in (0, 1)} | {"rune": (0, 0x10FFFF)}


def sized(name: str) -> Schema:
    if name == "uint":
        return Kind("int") & Bound(">=", 0)
    if name.startswith("float"):
        most = 3.4028234663852886e38 if name == "float32" else 1.7976931348623157e308
        return Kind("float") & between(-most, most)
    return Kind("int") & between(*RANGES[name])


# ---- the lattice


def kinds(s: Schema) -> frozenset[str]:
    """The kinds that values of a schema can have."""
    every = frozenset(("null", "bool", "int", "float", "string", "bytes", "list", "struct"))
    if isinstance(s, Kind):
        return frozenset(("int", "float")) if s.name == "number" else frozenset((s.name,))
    if isinstance(s, Const):
        return frozenset((_kind_of(s.value),))
    if isinstance(s, Bound):
        if s.op == "!=":
            return every
        k = _kind_of(s.value)
        return frozenset(("int", "float")) if k in ("int", "float") else frozenset((k,))
    if isinstance(s, All):
        return reduce(frozenset.intersection, map(kinds, s.parts), every)
    if isinstance(s, Choice):
        return reduce(frozenset.union, (kinds(b.schema) for b in s.branches), frozenset())
    if isinstance(s, Struct):
        return frozenset(("struct",))
    if isinstance(s, ListOf):
        return frozenset(("list",))
    return frozenset() if isinstance(s, Nothing) else every


def _kind_of(v: object) -> str:
    for kind, of in (("null", type(None)), ("bool", bool), ("int", int), ("float", float), ("bytes", bytes), ("list", list | tuple), ("struct", dict)):
        if isinstance(v, of):
            return kind
    return "string"


def _holds(op: str, a, b) -> bool:
    import re

    return {"<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b, "!=": lambda: a != b, "=~": lambda: bool(re.search(b, a)), "!~": lambda: not re.search(b, a)}[op]()


def unify(a: Schema, b: Schema) -> Schema:
    """Greatest lower bound. Commutative, associative, idempotent."""
    if isinstance(a, Branch):
        a = Choice((a,))
    if isinstance(b, Branch):
        b = Choice((b,))
    if isinstance(a, Any) or a == b:
        return b
    if isinstance(b, Any):
        return a
    for x in (a, b):
        if isinstance(x, Nothing):
            return x
    if isinstance(a, Choice) or isinstance(b, Choice):
        return _cross(a, b)
    if not kinds(a) & kinds(b):
        return Nothing(f"conflicting kinds {'|'.join(sorted(kinds(a)))} and {'|'.join(sorted(kinds(b)))}")
    if isinstance(a, Struct) and isinstance(b, Struct):
        return _merge(a, b)
    if isinstance(a, ListOf) and isinstance(b, ListOf):
        return _zip(a, b)
    parts = [*(a.parts if isinstance(a, All) else (a,)), *(b.parts if isinstance(b, All) else (b,))]
    return _simplified(parts)


def _cross(a: Schema, b: Schema) -> Schema:
    left = a.branches if isinstance(a, Choice) else (Branch(a),)
    right = b.branches if isinstance(b, Choice) else (Branch(b),)
    # a side without any mark has no say in what is a default
    l_any, r_any = any(x.marked for x in left), any(x.marked for x in right)
    out: list[Branch] = []
    for x in left:
        for y in right:
            s = unify(x.schema, y.schema)
            if not isinstance(s, Nothing):
                out.append(Branch(s, (l_any or r_any) and (x.marked or not l_any) and (y.marked or not r_any)))
    return _choice(out)


def _choice(branches: list[Branch]) -> Schema:
    seen: dict[Schema, bool] = {}
    for b in branches:
        if not isinstance(b.schema, Nothing):
            seen[b.schema] = seen.get(b.schema, False) or b.marked
    if not seen:
        return Nothing("no alternative is left")
    if len(seen) == 1:
        return next(iter(seen))
    return Choice(tuple(Branch(s, m) for s, m in seen.items()))


def union(a: Schema, b: Schema) -> Schema:
    """Least upper bound: a choice without equal branches."""
    flat: list[Branch] = []
    for x in (a, b):
        flat += x.branches if isinstance(x, Choice) else [x if isinstance(x, Branch) else Branch(x)]
    return _choice(flat)


def default_of(s: Schema) -> Schema:
    """What a schema stands for where data is missing: its marked branch if there is just one."""
    if isinstance(s, Choice):
        marked = [b.schema for b in s.branches if b.marked]
        if len(marked) == 1:
            return default_of(marked[0])
        return _choice([Branch(x) for x in marked]) if marked else s
    return s


def _simplified(parts: list[Schema]) -> Schema:
    """Conjunction of scalars and validators: tighter bounds stay, empty intervals are bottom."""
    parts = list(dict.fromkeys(parts))
    consts = [p for p in parts if isinstance(p, Const)]
    if len(consts) > 1:
        return Nothing(f"conflicting values {consts[0].value!r} and {consts[1].value!r}")
    bounds = [p for p in parts if isinstance(p, Bound)]
    others = [p for p in parts if not isinstance(p, Bound | Const | Kind)]
    kind = reduce(frozenset.intersection, (kinds(p) for p in parts))
    if not kind:
        return Nothing("conflicting kinds")
    if consts:
        for b in bounds:
            if not _holds(b.op, consts[0].value, b.value):
                return Nothing(f"{consts[0].value!r} is out of bound {b.op}{b.value!r}")
        return All((consts[0], *others)) if others else consts[0]
    whole = kind == {"int"}
    low, high, rest = None, None, []
    for b in bounds:
        v, op = b.value, b.op
        if op in (">", ">="):
            if whole and isinstance(v, float):
                v, op = (math.ceil(v), ">=") if v != int(v) else (int(v), op)
            if low is None or (v, op == ">") > (low.value, low.op == ">"):
                low = Bound(op, v)
        elif op in ("<", "<="):
            if whole and isinstance(v, float):
                v, op = (math.floor(v), "<=") if v != int(v) else (int(v), op)
            if high is None or (v, op != "<") < (high.value, high.op != "<"):
                high = Bound(op, v)
        else:
            rest.append(b)
    if low and high:
        if low.value > high.value or (low.value == high.value and (low.op, high.op) != (">=", "<=")):
            return Nothing(f"incompatible bounds {low.op}{low.value} and {high.op}{high.value}")
        if whole and (low.op, high.op) == (">", "<") and high.value - low.value == 1:
            return Nothing(f"no integer in {low.op}{low.value} and {high.op}{high.value}")
    names = [p for p in parts if isinstance(p, Kind)]
    if Kind("number") in names and len(names) > 1:
        names.remove(Kind("number"))
    out = [*names, *[b for b in (low, high) if b], *rest, *others]
    return out[0] if len(out) == 1 else All(tuple(out))


#: Order of strength of the presence of a field.
_STRENGTH = ("optional", "required", "regular")


def _merge(a: Struct, b: Struct) -> Schema:
    import re

    fields: dict[str, Field] = dict(a.fields)
    for name, f in b.fields:
        if name in fields:
            g = fields[name]
            f = Field(unify(g.schema, f.schema), max(g.presence, f.presence, key=_STRENGTH.index))
        fields[name] = f
    for own, other in ((a, b), (b, a)):
        mine = dict(own.fields)
        for name, f in other.fields:
            hit = [s for p, s in own.patterns if re.search(p, name)]
            for s in hit:
                fields[name] = replace(fields[name], schema=unify(fields[name].schema, s))
            if own.closed and name not in mine and not hit and f.presence != "optional":
                return Nothing(f"field not allowed: {name}")
    if a.closed or b.closed:
        fields = {n: f for n, f in fields.items() if all(not s.closed or n in dict(s.fields) or any(re.search(p, n) for p, _ in s.patterns) for s in (a, b))}
    for name, f in fields.items():
        if isinstance(f.schema, Nothing) and f.presence != "optional":
            return Nothing(f"{name}: {f.schema.why}")
    return Struct(tuple(fields.items()), tuple(dict.fromkeys((*a.patterns, *b.patterns))), a.closed or b.closed)


def _zip(a: ListOf, b: ListOf) -> Schema:
    n = max(len(a.prefix), len(b.prefix))
    at = lambda s, i: s.prefix[i] if i < len(s.prefix) else s.rest
    out = []
    for i in range(n):
        x, y = at(a, i), at(b, i)
        if x is None or y is None:
            if (a if x is None else b).partial or (b if x is None else a).partial:
                break  # the shorter list is the longest there is
            return Nothing("lists of different lengths")
        out.append(unify(x, y))
        if isinstance(out[-1], Nothing):
            return Nothing(f"{i}: {out[-1].why}")
    rest = None if a.rest is None or b.rest is None else unify(a.rest, b.rest)
    most = min((m for m in (a.most, b.most) if m is not None), default=None)
    partial = a.partial or b.partial
    least = max(a.least, b.least, *(0 if x.partial or not partial else len(x.prefix) for x in (a, b)))
    return ListOf(tuple(out), rest, least, most, a.unique or b.unique, partial)


def subsumes(a: Schema, b: Schema) -> bool:
    """Every value of ``b`` is one of ``a`` (sound; answers False where it can't tell)."""
    if isinstance(a, Any) or isinstance(b, Nothing) or a == b:
        return True
    if isinstance(b, Branch | Choice):
        return all(subsumes(a, x.schema) for x in (b.branches if isinstance(b, Choice) else (b,)))
    if isinstance(a, Branch | Choice):
        return any(subsumes(x.schema, b) for x in (a.branches if isinstance(a, Choice) else (a,)))
    if isinstance(a, All):
        return all(subsumes(p, b) for p in a.parts)
    if isinstance(a, Kind):
        return bool(kinds(b)) and kinds(b) <= kinds(a)
    if isinstance(b, All):
        return any(subsumes(a, p) for p in b.parts)
    if isinstance(a, Bound):
        if isinstance(b, Const):
            return _kind_of(b.value) in kinds(a) and _holds(a.op, b.value, a.value)
        if isinstance(b, Bound) and kinds(a) == kinds(b):
            if a.op in (">", ">=") and b.op in (">", ">="):
                return b.value > a.value or (b.value == a.value and not (a.op == ">" and b.op == ">="))
            if a.op in ("<", "<=") and b.op in ("<", "<="):
                return b.value < a.value or (b.value == a.value and not (a.op == "<" and b.op == "<="))
        return False
    if isinstance(a, Struct) and isinstance(b, Struct):
        mine, theirs = dict(a.fields), dict(b.fields)
        for name, f in mine.items():
            g = theirs.get(name)
            if g is None:
                if f.presence != "optional" or (not b.closed and not isinstance(f.schema, Any)):
                    return False
            elif _STRENGTH.index(g.presence) < _STRENGTH.index(f.presence) or not subsumes(f.schema, g.schema):
                return False
        return not a.closed or (b.closed and set(theirs) <= set(mine))
    if isinstance(a, ListOf) and isinstance(b, ListOf):
        if a.rest is None and (b.rest is not None or len(a.prefix) != len(b.prefix)):
            return False
        at = lambda s, i: s.prefix[i] if i < len(s.prefix) else s.rest
        n = max(len(a.prefix), len(b.prefix))
        same = all(at(b, i) is not None and subsumes(at(a, i), at(b, i)) for i in range(n))
        return same and len(a.prefix) <= max(len(b.prefix), b.least) and (b.rest is None or subsumes(a.rest, b.rest))
    return False


# ---- compilation


def _literal(v: object) -> Column:
    return F.lit(v)


def _re(pattern: str) -> str:
    """The dialect's ``$`` is the very end of the text; in a class of characters it is itself."""
    out, i, inside = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        inside += (c == "[") - (c == "]" and inside > 0)
        out.append(r"\z" if c == "$" and not inside else c)
        i += 1
    return "".join(out)


#: Names that typeof() gives, by kind.
_TYPEOF = {
    "int": r"^(tinyint|smallint|int|bigint|decimal\(\d+,0\))$", "float": r"^(float|double|decimal\(\d+,[1-9]\d*\))$", "number": r"^(tinyint|smallint|int|bigint|float|double|decimal)",
    "bool": "^boolean$", "string": r"^(string|char|varchar|date|timestamp|time)", "bytes": "^binary$", "list": "^array<", "struct": "^(struct|map)<",
}
#: Names that schema_of_variant() gives, by kind.
_VARIANT = {"int": r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$", "float": r"^(FLOAT|DOUBLE|DECIMAL)", "number": "^(BIGINT|INT|SMALLINT|TINYINT|FLOAT|DOUBLE|DECIMAL)", "bool": "^BOOLEAN$", "string": "^(STRING|DATE|TIMESTAMP)", "bytes": "^BINARY$", "list": "^ARRAY<", "struct": "^OBJECT<"}


def column_kinds(t: T.DataType) -> frozenset[str]:
    """The kinds that values of a Spark type (but null) can have."""
    if isinstance(t, T.VariantType):
        return frozenset(("bool", "int", "float", "string", "bytes", "list", "struct"))
    if isinstance(t, T.IntegralType) or (isinstance(t, T.DecimalType) and t.scale == 0):
        return frozenset(("int",))
    if isinstance(t, T.NumericType):
        return frozenset(("int", "float"))
    for of, kind in ((T.BooleanType, "bool"), (T.BinaryType, "bytes"), (T.ArrayType, "list"), (T.StructType | T.MapType, "struct"), (T.NullType, "null")):
        if isinstance(t, of):
            return frozenset((kind,))
    return frozenset(("string",))  # dates and times are texts


def of_kind(name: str, col: Column, dtype: T.DataType | None = None) -> Column:
    """Whether a value that is not null has a kind."""
    whole = lambda d: d == F.floor(d)
    if isinstance(dtype, T.VariantType):
        return F.schema_of_variant(col).rlike(_VARIANT[name])
    if dtype is not None:
        has = column_kinds(dtype)
        if name == "int" and "float" in has:
            return whole(col.cast("double"))
        return F.lit(bool(has & {"int", "float"}) if name == "number" else name in has)
    kind = F.typeof(col)
    if name == "int":  # a text first, as the column may be of any type
        return kind.rlike(_TYPEOF["int"]) | (kind.rlike(_TYPEOF["float"]) & F.coalesce(whole(col.cast("string").try_cast("double")), F.lit(False)))
    return kind.rlike(_TYPEOF[name])


def _comparable(value: object, dtype: T.DataType | None, col: Column) -> bool | Column:
    """Whether a value can be compared with a column: known at once, or (without a type) a Column that Spark folds."""
    kind = _kind_of(value)
    kind = "number" if kind in ("int", "float") else kind
    if dtype is None:
        return F.typeof(col).rlike(_TYPEOF[kind]) if kind in ("number", "string", "bool") else True
    has = column_kinds(dtype)
    return not isinstance(dtype, T.VariantType) and bool(has & {"int", "float"} if kind == "number" else kind in has)


def _when_comparable(value: object, dtype: T.DataType | None, col: Column, test, other: bool = False) -> Column:
    if isinstance(dtype, T.VariantType):  # compared as the value's own type
        cast = F.try_variant_get(col, "$", {"int": "double", "float": "double", "bool": "boolean"}.get(_kind_of(value), "string"))
        kind = _kind_of(value)
        return F.when(of_kind("number" if kind in ("int", "float") else kind, col, dtype), test(cast)).otherwise(F.lit(other))
    able = _comparable(value, dtype, col)
    if isinstance(able, bool):
        return test(col) if able else F.lit(other)
    return F.when(able, test(col)).otherwise(F.lit(other))


def _bound(b: Bound, col: Column, dtype: T.DataType | None = None) -> Column:
    v = _literal(b.value)
    test = {"<": lambda c: c < v, "<=": lambda c: c <= v, ">": lambda c: c > v, ">=": lambda c: c >= v, "!=": lambda c: ~c.eqNullSafe(v), "=~": lambda c: c.rlike(_re(b.value)), "!~": lambda c: ~c.rlike(_re(b.value))}[b.op]
    return _when_comparable(b.value, dtype, col, test, b.op == "!=")


def _solid(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def matches(s: Schema, col: Column, dtype: T.DataType | None = None) -> Column:
    """Whether a value satisfies a schema; a null satisfies Any and what admits null only."""
    if isinstance(s, Any):
        return F.lit(True)
    if isinstance(s, Nothing):
        return F.lit(False)
    if isinstance(s, Kind):
        return col.isNull() if s.name == "null" else col.isNotNull() & _solid(of_kind(s.name, col, dtype))
    if isinstance(s, Const):
        return col.isNull() if s.value is None else _solid(_when_comparable(s.value, dtype, col, lambda c: c == _literal(s.value)))
    if isinstance(s, Bound):
        return _solid(_bound(s, col, dtype))
    if isinstance(s, All):
        return reduce(Column.__and__, [matches(p, col, dtype) for p in s.parts])
    if isinstance(s, Branch):
        return matches(s.schema, col, dtype)
    if isinstance(s, Choice):
        plain = [b.schema.value for b in s.branches if isinstance(b.schema, Const) and b.schema.value is not None]
        if len(plain) == len(s.branches) and len({_kind_of(v) for v in plain}) == 1 and not isinstance(dtype, T.VariantType):
            return _solid(_when_comparable(plain[0], dtype, col, lambda c: c.isin(plain)))
        return reduce(Column.__or__, [matches(b.schema, col, dtype) for b in s.branches])
    if isinstance(s, Check):
        return _solid(s.test(col))
    if isinstance(s, MatchN):
        return matches(s.count, reduce(Column.__add__, [matches(x, col, dtype).cast("int") for x in s.schemas]), T.IntegerType())
    if isinstance(s, MatchIf):
        known = _decided(s, dtype)
        if known is not None:
            return matches(known, col, dtype)
        return F.when(matches(s.test, col, dtype), matches(s.then, col, dtype)).otherwise(matches(s.other, col, dtype))
    return F.size(violations(s, col, "", dtype)) == 0


def _decided(s: MatchIf, dtype: T.DataType | None) -> Schema | None:
    """The branch of a condition on a kind that the column's type decides, for values that are not null."""
    if dtype is None or not isinstance(s.test, Kind) or isinstance(dtype, T.VariantType) or s.other != Any():
        return None
    has, want = column_kinds(dtype), kinds(s.test)
    if not has & want:
        return s.other
    return Choice((Branch(Kind("null")), Branch(s.then))) if has <= want and not isinstance(s.then, Struct | ListOf) else s.then if has <= want else None


def _violation(path: Column | str, code: str, message: str) -> Column:
    at = path if isinstance(path, Column) else F.lit(path)
    return F.struct(at.alias("path"), F.lit(code).alias("code"), F.lit(message).alias("message"))


NONE = lambda: F.array().cast(VIOLATION)


def describe(s: Schema) -> str:
    if isinstance(s, Bound):
        return f"{s.op}{s.value!r}" if not isinstance(s.value, str) else f'{s.op}"{s.value}"'
    if isinstance(s, Const):
        return f'"{s.value}"' if isinstance(s.value, str) else str(s.value)
    if isinstance(s, Kind):
        return s.name
    if isinstance(s, All):
        return " & ".join(map(describe, s.parts))
    if isinstance(s, Choice):
        return " | ".join(("*" if b.marked else "") + describe(b.schema) for b in s.branches)
    return s.name if isinstance(s, Check) else type(s).__name__.lower()


def violations(s: Schema, col: Column, path: str = "", dtype: T.DataType | None = None) -> Column:
    """All violations of a value, each conjunct for itself; ``dtype`` is the Spark type of the value."""
    if isinstance(s, Branch):
        return violations(s.schema, col, path, dtype)
    if isinstance(s, All):
        return F.concat(*[violations(p, col, path, dtype) for p in s.parts])
    if isinstance(s, MatchIf) and isinstance(known := _decided(s, dtype), Struct | ListOf | Any):
        return violations(known, col, path, dtype)
    if isinstance(s, Struct | ListOf) and dtype is not None and not isinstance(dtype, T.VariantType) and ("struct" if isinstance(s, Struct) else "list") not in column_kinds(dtype):
        return F.array(_violation(path, "kind", f"invalid value (not {'struct' if isinstance(s, Struct) else 'list'})"))
    if isinstance(s, Struct):
        return map_violations(s, col, path, dtype.valueType) if isinstance(dtype, T.MapType) else _struct_violations(s, col, path, dtype)
    if isinstance(s, ListOf):
        parts, inner = [], dtype.elementType if isinstance(dtype, T.ArrayType) else None
        for i, p in enumerate(s.prefix):
            at = f"{path}.{i}" if path else str(i)
            parts.append(F.when(F.size(col) <= i, NONE() if s.partial else F.array(_violation(at, "incomplete", f"{at} is missing"))).otherwise(violations(p, F.try_element_at(col, F.lit(i + 1)), at, inner)))
        if s.rest is None:
            parts.append(F.when(F.size(col) > len(s.prefix), F.array(_violation(path, "length", f"more than {len(s.prefix)} elements"))).otherwise(NONE()))
        elif not isinstance(s.rest, Any):
            bad = F.filter(F.transform(col, lambda x, i: F.struct(i.alias("i"), ((i >= len(s.prefix)) & ~matches(s.rest, x, inner)).alias("bad"))), lambda z: z["bad"])
            parts.append(F.transform(bad, lambda z: _violation(F.concat(F.lit(f"{path}." if path else ""), z["i"].cast("string")), "value", f"invalid value (not {describe(s.rest)})")))
        if s.least:
            parts.append(F.when(F.size(col) < s.least, F.array(_violation(path, "length", f"fewer than {s.least} elements"))).otherwise(NONE()))
        if s.most is not None:
            parts.append(F.when(F.size(col) > s.most, F.array(_violation(path, "length", f"more than {s.most} elements"))).otherwise(NONE()))
        if s.unique:
            parts.append(F.when(F.size(F.array_distinct(col)) < F.size(col), F.array(_violation(path, "unique", "equal elements"))).otherwise(NONE()))
        return F.concat(*parts) if parts else NONE()
    if isinstance(s, Any):
        return NONE()
    code = "bound" if isinstance(s, Bound) else "kind" if isinstance(s, Kind) else "value"
    return F.when(matches(s, col, dtype), NONE()).otherwise(F.array(_violation(path, code, f"invalid value (out of bound {describe(s)})" if code == "bound" else f"invalid value (not {describe(s)})")))


def _names_null(s: Schema) -> bool:
    """Whether null is among the values a schema names."""
    if isinstance(s, Branch | Choice):
        return any(_names_null(b.schema) for b in (s.branches if isinstance(s, Choice) else (s,)))
    return s in (Kind("null"), Const(None))


def _struct_violations(s: Struct, col: Column, path: str, dtype: T.DataType | None) -> Column:
    import re

    types = {f.name: f.dataType for f in dtype.fields} if isinstance(dtype, T.StructType) else None
    place = lambda name: f"{path}.{name}" if path else name
    parts = []
    for name, f in s.fields:
        at = place(name)
        absent = F.array(_violation(at, "required" if f.presence == "required" else "incomplete", f"{at} is missing"))
        admits = _names_null(f.schema) if f.presence == "required" else isinstance(f.schema, Any) or "null" in kinds(f.schema)
        if types is not None and name not in types:
            parts += [] if f.presence == "optional" or (admits and f.presence != "required") else [absent]  # a column that is not there
            continue
        value = col.getField(name)
        bad = violations(f.schema, value, at, types and types[name])
        parts.append(F.when(value.isNull(), NONE()).otherwise(bad) if f.presence == "optional" else bad if admits else F.when(value.isNull(), absent).otherwise(bad))
    for name, t in (types or {}).items():
        value, hit = col.getField(name), [c for p, c in s.patterns if re.search(p, name)]
        parts += [F.when(value.isNull(), NONE()).otherwise(violations(c, value, place(name), t)) for c in hit]
        if s.closed and not hit and name not in dict(s.fields):
            parts.append(F.when(value.isNull(), NONE()).otherwise(F.array(_violation(place(name), "closed", "field not allowed"))))
    return F.concat(*parts) if parts else NONE()


def map_violations(s: Struct, entries: Column, path: str = "", dtype: T.DataType | None = None) -> Column:
    """Of a map column with values of ``dtype``: pattern constraints and closedness by key, fields by name."""
    parts = []
    for name, f in s.fields:
        at, value = f"{path}.{name}" if path else name, F.try_element_at(entries, F.lit(name))
        bad = violations(f.schema, value, at, dtype)
        absent = NONE() if f.presence == "optional" else F.array(_violation(at, "required", f"{at} is missing"))
        parts.append(F.when(~F.map_contains_key(entries, name), absent).otherwise(bad))
    names = F.array(*[F.lit(n) for n, _ in s.fields]).cast("array<string>")
    for pattern, c in s.patterns:
        bad = _bad_keys(entries, pattern, c, dtype)
        parts.append(F.transform(bad, lambda k: _violation(F.concat(F.lit(f"{path}." if path else ""), k), "value", "invalid value for the field's pattern")))
    if s.closed:
        extra = F.array_except(F.map_keys(entries), names)
        if s.patterns:
            extra = F.filter(extra, lambda k: ~reduce(Column.__or__, [k.rlike(_re(p)) for p, _ in s.patterns]))
        parts.append(F.transform(extra, lambda k: _violation(F.concat(F.lit(f"{path}." if path else ""), k), "closed", "field not allowed")))
    return F.concat(*parts) if parts else NONE()


def _bad_keys(entries: Column, pattern: str, c: Schema, dtype: T.DataType | None) -> Column:
    return F.map_keys(F.map_filter(entries, lambda k, v: k.rlike(_re(pattern)) & ~matches(c, v, dtype)))


def complete(s: Schema, col: Column) -> Column:
    """The value, or the default where it is missing."""
    d = default_of(s.schema if isinstance(s, Branch) and s.marked else s)
    return F.coalesce(col, _literal(d.value)) if isinstance(d, Const) else col


def trim(s: Schema, col: Column) -> Column:
    """Null where the value is what the default would fill in."""
    d = default_of(s)
    return F.when(~_solid(col == _literal(d.value)), col) if isinstance(d, Const) else col


def vet(df, s: Schema, name: str = "violations", ordered: bool = False):
    """``df`` with an array column of violations; a closed schema also refuses columns it does not name.

    ``ordered``: sorted by path, code and message, equal ones once.
    """
    found = violations(s, F.struct(*[df[c] for c in df.columns]), "", df.schema)
    return df.withColumn(name, F.array_sort(F.array_distinct(found)) if ordered else found)


def complete_frame(df, s: Struct):
    """``df`` with the defaults of a struct schema filled in."""
    return df.withColumns({n: complete(f.schema, df[n]) for n, f in s.fields if n in df.columns})


_TYPES = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType(), "null": T.NullType()}


def to_type(s: Schema) -> T.DataType:
    """The Spark type of a schema's values."""
    if isinstance(s, Struct):
        return T.StructType([T.StructField(n, to_type(f.schema), f.presence == "optional") for n, f in s.fields])
    if isinstance(s, ListOf):
        return T.ArrayType(to_type(s.rest if s.rest is not None and not isinstance(s.rest, Any) else s.prefix[0] if s.prefix else Any()))
    k = kinds(s) - {"null"}
    if k == {"int", "float"}:
        return T.DoubleType()
    return _TYPES[next(iter(k))] if len(k) == 1 and next(iter(k)) in _TYPES else T.VariantType()


def from_type(t: T.DataType) -> Schema:
    """The schema of a Spark type."""
    if isinstance(t, T.StructType):
        return Struct(tuple((f.name, Field(from_type(f.dataType), "optional" if f.nullable else "regular")) for f in t.fields))
    if isinstance(t, T.ArrayType):
        return ListOf(rest=from_type(t.elementType))
    for kind in ("int8", "int16", "int32", "int64"):
        if t.typeName() == {"int8": "byte", "int16": "short", "int32": "integer", "int64": "long"}[kind]:
            return sized(kind)
    return {"string": Kind("string"), "boolean": Kind("bool"), "double": Kind("float"), "float": sized("float32"), "binary": Kind("bytes")}.get(t.typeName(), Any())
