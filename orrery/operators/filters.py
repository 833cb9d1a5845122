"""The filter language: JSON clauses to a tree, and the tree to a Column.

Predicates are two-valued: a missing key (or null document) fails every positive test and passes every
negated one. Positive tests are left bare and negated ones written as `c IS NULL OR ...`, so that both
reach the Parquet scan; a null of a bare test counts as false in a filter, also under $and and $or,
which are never negated.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import InvalidArgument
from orrery.functions.regex import java_pattern

Scalar = bool | int | float | str
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1
RANGES = ("$lt", "$lte", "$gt", "$gte")


@dataclass(frozen=True)
class All:
    children: tuple


@dataclass(frozen=True)
class Any:
    children: tuple


@dataclass(frozen=True)
class Compare:
    key: str
    op: str
    value: Scalar


@dataclass(frozen=True)
class Among:
    key: str
    negated: bool
    values: tuple


@dataclass(frozen=True)
class Member:
    key: str
    negated: bool
    value: Scalar


@dataclass(frozen=True)
class Text:
    negated: bool
    regex: bool
    pattern: str


Expr = All | Any | Compare | Among | Member | Text


def _bad_where() -> InvalidArgument:
    return InvalidArgument("Invalid where clause")


def _bad_document() -> InvalidArgument:
    return InvalidArgument("Invalid where document clause")


def _load(clause, error):
    if isinstance(clause, (str, bytes)):
        try:
            return json.loads(clause)
        except ValueError:
            raise error() from None
    return clause


def _is_long(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and LONG_MIN <= value <= LONG_MAX


def _is_scalar(value) -> bool:
    return isinstance(value, (str, bool, float)) or _is_long(value)


def parse(where=None, where_document=None) -> Expr | None:
    """The conjunction of both clauses, JSON text or decoded; None where both are absent."""
    where, where_document = _load(where, _bad_where), _load(where_document, _bad_document)
    found = []
    if where is not None:
        found.append(parse_where(where))
    if where_document is not None:
        found.append(parse_document(where_document))
    return All(tuple(found)) if len(found) == 2 else found[0] if found else None


def _one(clause, error) -> tuple[str, object]:
    if not isinstance(clause, Mapping) or len(clause) != 1:
        raise error()
    return next(iter(clause.items()))


def parse_where(clause) -> Expr:
    key, value = _one(clause, _bad_where)
    if key in ("$and", "$or"):
        if not isinstance(value, list):
            raise _bad_where()
        return (All if key == "$and" else Any)(tuple(map(parse_where, value)))
    if key.startswith("$"):
        raise _bad_where()
    if _is_scalar(value):
        return Compare(key, "$eq", value)
    op, operand = _one(value, _bad_where)
    return _operator(key, op, operand)


def _operator(key: str, op: str, operand) -> Expr:
    if isinstance(operand, list):
        return Among(key, op == "$nin", _list(op, operand))
    if not _is_scalar(operand):
        raise _bad_where()
    if op in ("$contains", "$not_contains"):
        negated = op == "$not_contains"
        if key != "#document":
            return Member(key, negated, operand)
        if not isinstance(operand, str):
            raise _bad_where()
        return Text(negated, False, operand)
    if op in ("$regex", "$not_regex"):
        if key != "#document" or not isinstance(operand, str):
            raise _bad_where()
        java_pattern(operand)
        return Text(op == "$not_regex", True, operand)
    numeric = not isinstance(operand, (str, bool))
    if op in ("$eq", "$ne") or numeric and op in RANGES:
        return Compare(key, op, operand)
    raise _bad_where()


def _list(op: str, values: list) -> tuple:
    """A list holds strings, booleans or numbers; a leading integer asks for integers, a leading float takes both."""
    if op not in ("$in", "$nin") or not values:
        raise _bad_where()
    first = values[0]
    if isinstance(first, (str, bool)):
        good = all(type(v) is type(first) for v in values)
    elif isinstance(first, float):
        good = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values)
        values = [float(v) for v in values] if good else values
    else:
        good = all(map(_is_long, values))
    if not good:
        raise _bad_where()
    return tuple(values)


def parse_document(clause) -> Expr:
    key, value = _one(clause, _bad_document)
    if key in ("$and", "$or"):
        if not isinstance(value, list):
            raise _bad_document()
        return (All if key == "$and" else Any)(tuple(map(parse_document, value)))
    if not isinstance(value, str) or key not in ("$contains", "$not_contains", "$regex", "$not_regex"):
        raise _bad_document()
    if "regex" in key:
        java_pattern(value)
    return Text(key.startswith("$not"), "regex" in key, value)


def long_test(c: Column, op: str, value: int | float) -> Column:
    """c (BIGINT) against a number, exactly: Spark would compare BIGINT and DOUBLE as doubles."""
    if isinstance(value, float) and not math.isfinite(value):
        return c.isNotNull() if (value > 0) == (op in ("$lt", "$lte")) and op not in ("$eq", "$ne") else F.lit(False)
    low, high = math.floor(value), math.ceil(value)
    if op == "$eq":
        return c == F.lit(low).cast("long") if low == high and LONG_MIN <= low <= LONG_MAX else F.lit(False)
    bound = {"$gt": low, "$lte": low, "$gte": high, "$lt": high}[op]
    if not LONG_MIN <= bound <= LONG_MAX:
        return c.isNotNull() if (bound < 0) == (op in ("$gt", "$gte")) else F.lit(False)
    literal = F.lit(bound).cast("long")
    return {"$gt": c > literal, "$gte": c >= literal, "$lt": c < literal, "$lte": c <= literal}[op]


def double_test(c: Column, op: str, value: int | float) -> Column:
    """c (DOUBLE) against a number, exactly also for integers that no double equals."""
    near = float(value)
    literal = F.lit(near)
    if op == "$eq":
        return c == literal if near == value else F.lit(False)
    if near > value:  # no double lies in [value, near)
        return {"$gt": c >= literal, "$gte": c >= literal, "$lt": c < literal, "$lte": c < literal}[op]
    if near < value:
        return {"$gt": c > literal, "$gte": c > literal, "$lt": c <= literal, "$lte": c <= literal}[op]
    return {"$gt": c > literal, "$gte": c >= literal, "$lt": c < literal, "$lte": c <= literal}[op]


#: A record's own fields, which are no metadata keys.
FIELDS = frozenset({"rowid", "id", "embedding", "document", "uri", "seq", "collection_id", "written_at"})


class ColumnBinding:
    """Metadata keys as ordinary columns of a DataFrame, by default all but a record's own fields; null is a missing key."""

    def __init__(self, df, keys: Mapping[str, str] | None = None, id: str = "id", document: str = "document"):  # noqa: A002
        self.types = {f.name: f.dataType for f in df.schema.fields}
        reserved = FIELDS | {id, document}
        self.keys = dict(keys) if keys is not None else {n: n for n in self.types if n not in reserved}
        self.id, self.document = F.col(id), F.col(document)

    def _column(self, key: str):
        name = self.keys.get(key)
        return (None, None) if name is None else (F.col(f"`{name}`"), self.types[name])

    def scalar(self, key: str, op: str, value: Scalar) -> Column:
        c, kind = self._column(key)
        if isinstance(value, bool):
            return c == F.lit(value) if isinstance(kind, T.BooleanType) else F.lit(False)
        if isinstance(value, str):
            return c == F.lit(value) if isinstance(kind, T.StringType) else F.lit(False)
        if isinstance(kind, T.IntegralType):
            return long_test(c, op, value)
        return double_test(c, op, value) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(False)

    def among(self, key: str, values: tuple) -> Column:
        c, kind = self._column(key)
        if isinstance(values[0], (str, bool)):
            same = isinstance(kind, T.StringType if isinstance(values[0], str) else T.BooleanType)
            return c.isin(*values) if same else F.lit(False)
        return reduce(lambda a, b: a | b, (self.scalar(key, "$eq", v) for v in values))

    def member(self, key: str, value: Scalar) -> Column:
        c, kind = self._column(key)
        if not isinstance(kind, T.ArrayType):
            return F.lit(False)
        inner = kind.elementType
        if isinstance(value, bool) or isinstance(value, str):
            wanted = T.BooleanType if isinstance(value, bool) else T.StringType
            return F.array_contains(c, value) if isinstance(inner, wanted) else F.lit(False)
        if isinstance(inner, T.IntegralType):
            if value != math.floor(value) or not LONG_MIN <= value <= LONG_MAX:
                return F.lit(False)
            return F.array_contains(c, F.lit(int(value)).cast(inner))
        exact = isinstance(inner, (T.DoubleType, T.FloatType)) and float(value) == value
        return F.array_contains(c, F.lit(float(value)).cast(inner)) if exact else F.lit(False)

    def missing(self, key: str) -> Column:
        c, _ = self._column(key)
        return F.lit(True) if c is None else c.isNull()


class MapBinding:
    """Metadata as MAP<STRING, STRUCT<kind, b, i, f, s, ba, ia, fa, sa, ...>>; see functions.values."""

    def __init__(self, metadata: str = "metadata", id: str = "id", document: str = "document"):  # noqa: A002
        self.metadata, self.id, self.document = F.col(metadata), F.col(id), F.col(document)

    def _value(self, key: str) -> Column:
        return F.try_element_at(self.metadata, F.lit(key))

    def scalar(self, key: str, op: str, value: Scalar) -> Column:
        v = self._value(key)
        if isinstance(value, bool):
            return F.coalesce((v["kind"] == 1) & (v["b"] == value), F.lit(False))
        if isinstance(value, str):
            return F.coalesce((v["kind"] == 4) & (v["s"] == value), F.lit(False))
        test = F.when(v["kind"] == 2, long_test(v["i"], op, value)).when(v["kind"] == 3, double_test(v["f"], op, value))
        return F.coalesce(test, F.lit(False))

    def among(self, key: str, values: tuple) -> Column:
        return reduce(lambda a, b: a | b, (self.scalar(key, "$eq", v) for v in values))

    def member(self, key: str, value: Scalar) -> Column:
        v = self._value(key)
        if isinstance(value, (str, bool)):
            kind, field = (9, "sa") if isinstance(value, str) else (6, "ba")
            return F.coalesce((v["kind"] == kind) & F.array_contains(v[field], value), F.lit(False))
        whole = value == math.floor(value) and LONG_MIN <= value <= LONG_MAX
        in_longs = F.array_contains(v["ia"], F.lit(int(value)).cast("long")) if whole else F.lit(False)
        in_doubles = F.array_contains(v["fa"], float(value)) if float(value) == value else F.lit(False)
        return F.coalesce(F.when(v["kind"] == 7, in_longs).when(v["kind"] == 8, in_doubles), F.lit(False))

    def missing(self, key: str) -> Column:
        return F.lit(False)  # tests above are never null


def _negate(test: Column, missing: Column) -> Column:
    return missing | ~test


def compile_filter(expr: Expr | None, binding: ColumnBinding | MapBinding) -> Column:
    """The Column that keeps what the clause keeps. Wrap it in coalesce(..., false) to project it."""
    if expr is None:
        return F.lit(True)
    if isinstance(expr, All):
        return reduce(lambda a, b: a & b, (compile_filter(c, binding) for c in expr.children), F.lit(True))
    if isinstance(expr, Any):
        return reduce(lambda a, b: a | b, (compile_filter(c, binding) for c in expr.children), F.lit(False))
    if isinstance(expr, Text):
        found = binding.document.rlike(java_pattern(expr.pattern)) if expr.regex else F.contains(binding.document, F.lit(expr.pattern))
        return _negate(found, binding.document.isNull()) if expr.negated else found
    if isinstance(expr, Member):
        special = expr.key in ("#id", "#document")
        found = F.lit(False) if special else binding.member(expr.key, expr.value)
        return _negate(found, F.lit(False) if special else binding.missing(expr.key)) if expr.negated else found
    if expr.key == "#id":
        return _on_id(expr, binding)
    negated = expr.negated if isinstance(expr, Among) else expr.op == "$ne"
    if expr.key == "#document":
        return F.lit(negated)
    found = binding.among(expr.key, expr.values) if isinstance(expr, Among) else binding.scalar(expr.key, "$eq" if negated else expr.op, expr.value)
    return _negate(found, binding.missing(expr.key)) if negated else found


def _on_id(expr: Compare | Among, binding) -> Column:
    if isinstance(expr, Among):
        if not isinstance(expr.values[0], str):
            return F.lit(expr.negated)
        found = binding.id.isin(*expr.values)
        return ~found if expr.negated else found
    if not isinstance(expr.value, str):
        return F.lit(expr.op == "$ne")
    return binding.id == F.lit(expr.value) if expr.op == "$eq" else binding.id != F.lit(expr.value)


def where(df, clause=None, document=None, binding=None):
    """df with the rows that both clauses keep."""
    expr = parse(clause, document)
    return df if expr is None else df.filter(compile_filter(expr, binding or ColumnBinding(df)))
