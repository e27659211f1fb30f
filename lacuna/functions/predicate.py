"""Compiles a question into a condition of built-in functions that is true or false, never null."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .question import CONTAINS, EQUALS, GREATER, LACKS, LESS, LONGER, SHORTER, Condition, Node

_INTS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}


def _constant(text: str, kind: T.DataType):
    """The condition's value in the attribute's type, or None where it isn't one."""
    try:
        if type(kind) in _INTS:
            n, bits = int(text), _INTS[type(kind)]
            return n if -(2 ** (bits - 1)) <= n < 2 ** (bits - 1) else None
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(text)
        if isinstance(kind, T.DecimalType):
            return Decimal(text)
        if isinstance(kind, T.DateType):
            return date.fromisoformat(text)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return datetime.fromisoformat(text)
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False}.get(text.lower())
    except (ValueError, InvalidOperation):
        return None
    return None


def _atomic(c: Condition, col: Column, kind: T.DataType) -> Column:
    no = F.lit(False)
    if isinstance(kind, T.StringType):
        if c.op == EQUALS:
            return col == F.lit(c.value)
        if c.op in (CONTAINS, LACKS):
            has = F.contains(col, F.lit(c.value))
            return has if c.op == CONTAINS else ~has
        if c.op in (LONGER, SHORTER):
            return F.length(col) > int(c.value) if c.op == LONGER else F.length(col) < int(c.value)
        return no
    value = _constant(c.value, kind)
    if value is None or c.op not in (EQUALS, LESS, GREATER) or (c.op != EQUALS and isinstance(kind, T.BooleanType)):
        return no
    value = F.lit(value).cast(kind)
    return col == value if c.op == EQUALS else col < value if c.op == LESS else col > value


def predicate(node: Node, col: Column, kind: T.DataType) -> Column:
    """Whether a value answers the node. Null never does. An array counts its elements that answer the first child,
    or, without one, is asked only to be non-empty unless min allows empty; a field the struct lacks is ignored."""
    if isinstance(kind, T.ArrayType):
        if not node.children:
            ok = (F.size(col) > 0) | F.lit(node.min <= 0)
        else:
            n = F.size(F.filter(col, lambda x: predicate(node.children[0], x, kind.elementType)))
            ok = n >= node.min
            if node.max != -1:
                ok = ok & (n <= node.max)
        return F.coalesce(col.isNotNull() & ok, F.lit(False))
    ok = col.isNotNull()
    if isinstance(kind, T.StructType):
        fields = {f.name: f.dataType for f in kind.fields}
        for child in node.children:
            if child.name in fields:
                ok = ok & predicate(child, col.getField(child.name), fields[child.name])
        return F.coalesce(ok, F.lit(False))
    if node.children:
        return F.lit(False)
    for c in node.conditions:
        ok = ok & _atomic(c, col, kind)
    return F.coalesce(ok, F.lit(False))


def row_predicate(root: Node, schema: T.StructType) -> Column:
    fields = {f.name: f.dataType for f in schema.fields}
    ok = F.lit(True)
    for child in root.children:
        if child.name in fields:
            ok = ok & predicate(child, F.col(f"`{child.name}`"), fields[child.name])
    return ok
