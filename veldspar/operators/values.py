"""Operations on whole values: walk, fields, fill at a path, structural equality, JSON Pointers, interpolation.

A value is a column and its Spark type, so all of these are ordinary Column expressions. A null field of a struct is an
absent field; a null element of a list is a value.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numbers as N
from . import schema as S

_NAME = "^[A-Za-z_$][A-Za-z0-9_$]*$"
_LEAF = "array<struct<path:string,pointer:string,value:string>>"


def _escaped(label: Column) -> Column:
    return F.replace(F.replace(label, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _below(path: Column, label: Column) -> Column:
    label = F.when(label.rlike(_NAME), label).otherwise(N.quote(label))
    return F.when(path == "", label).otherwise(F.concat(path, F.lit("."), label))


def walk(value: Column, dtype: T.DataType) -> Column:
    """All leaves as (path, pointer, value): a dotted path, a JSON Pointer, and the leaf as a string."""

    def visit(c: Column, t: T.DataType, path: Column, pointer: Column) -> Column:
        if isinstance(t, T.StructType):
            each = [F.when(c[f.name].isNotNull(), visit(c[f.name], f.dataType, _below(path, F.lit(f.name)), F.concat(pointer, F.lit("/"), _escaped(F.lit(f.name))))) for f in t.fields]
            inner = F.concat(*[F.coalesce(e, none) for e in each]) if each else none
        elif isinstance(t, T.ArrayType):
            inner = F.flatten(F.transform(c, lambda v, i: visit(v, t.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), F.concat(pointer, F.lit("/"), i.cast("string")))))
        elif isinstance(t, T.MapType):
            inner = F.flatten(F.transform(F.map_entries(c), lambda e: visit(e["value"], t.valueType, _below(path, e["key"].cast("string")), F.concat(pointer, F.lit("/"), _escaped(e["key"].cast("string"))))))
        else:
            return F.array(F.struct(path.alias("path"), pointer.alias("pointer"), c.cast("string").alias("value"))).cast(_LEAF)
        return F.coalesce(inner.cast(_LEAF), none)

    none = F.array().cast(_LEAF)
    return visit(value, dtype, F.lit(""), F.lit(""))


def fields(value: Column, dtype: T.DataType) -> Column:
    """Names of the present fields, in order."""
    if isinstance(dtype, T.MapType):
        return F.map_keys(value)
    return F.array_compact(F.array(*[F.when(value[f.name].isNotNull(), F.lit(f.name)) for f in dtype.fields]).cast("array<string>"))


def canonical(value: Column, dtype: T.DataType) -> Column:
    """The value with every map as a list of entries by key: comparable, and fit for grouping."""
    if isinstance(dtype, T.StructType) and dtype.fields:
        return F.when(value.isNotNull(), F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda v: canonical(v, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], dtype.valueType).alias("value"))))
    return value


def equals(a: Column, b: Column, dtype: T.DataType) -> Column:
    """Structural equality of two values of a type: order counts in lists, not in maps; absent equals absent."""
    return canonical(a, dtype).eqNullSafe(canonical(b, dtype))


def fill_path(value: Column, dtype: T.StructType, path: str, what: Column) -> tuple[Column, Column]:
    """(value with ``what`` unified in at a dotted path, whether that conflicts). Missing structs on the way are made.

    A present and different value at the path is a conflict, and so are a value of another kind and a scalar or list on the
    way; what was there stays.
    """

    def fill(c: Column, t: T.DataType | None, names: list[str]) -> tuple[Column, Column]:
        if not names:
            if t is None:
                return what, F.lit(False)
            new = what.try_cast(t)
            return F.coalesce(c, new), what.isNotNull() & (new.isNull() | (c.isNotNull() & ~equals(c, new, t)))
        name, rest = names[0], names[1:]
        if t is None:
            inner, bad = fill(c, None, rest)
            return F.struct(inner.alias(name)), bad
        if not isinstance(t, T.StructType):
            return c, c.isNotNull()
        types = {f.name: f.dataType for f in t.fields}
        whole = F.coalesce(c, F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in t.fields])) if t.fields else c
        inner, bad = fill(c[name], types[name], rest) if name in types else fill(c, None, rest)
        return F.struct(*[(inner if n == name else whole[n]).alias(n) for n in [*types, *([] if name in types else [name])]]), bad

    return fill(value, dtype, path.split("."))


def at_pointer(value: Column, dtype: T.DataType, pointer: str) -> Column:
    """What a JSON Pointer names; null where it names nothing."""
    if pointer and not pointer.startswith("/"):
        raise ValueError(f"not a JSON Pointer: {json.dumps(pointer)}")
    for label in pointer.split("/")[1:]:
        label = label.replace("~1", "/").replace("~0", "~")
        if isinstance(dtype, T.StructType) and label in dtype.names:
            value, dtype = value[label], dtype[label].dataType
        elif isinstance(dtype, T.ArrayType) and re.fullmatch("0|[1-9][0-9]*", label):
            value, dtype = F.get(value, int(label)), dtype.elementType
        elif isinstance(dtype, T.MapType):
            value, dtype = F.try_element_at(value, F.lit(label).cast(dtype.keyType)), dtype.valueType
        else:
            return F.lit(None)
    return value


def allows(schema: S.Struct, name: str) -> bool:
    """Whether a struct of the schema may have a field of that name."""
    return not schema.closed or name in dict(schema.fields) or any(re.search(p, name) for p, _ in schema.patterns)


def interpolate(template: str, **columns: Column) -> Column:
    r"""``"\(x) of \(y)"`` with the columns' spellings; null if one is null. A name without a column is a KeyError."""
    out = re.split(r"\\\(\s*([A-Za-z_]\w*)\s*\)", template)
    return F.concat(*[columns[p].cast("string") if i % 2 else F.lit(p) for i, p in enumerate(out)])
