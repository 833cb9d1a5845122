"""Rank expressions: arithmetic over partial score functions.

A node evaluates to a score column, a column that says whether the record has a score, and a default
for records without one. Leaves are joined once on rowid; the rest is one projection.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.errors import InvalidArgument, Unprocessable

LISTS, PAIRS, SINGLES = ("$sum", "$mul", "$max", "$min"), ("$sub", "$div"), ("$abs", "$exp", "$log")
MAX_FLOAT = float(np.finfo(np.float32).max)
LEAF_LIMIT = 16


@dataclass(frozen=True)
class Leaf:
    """A nearest-neighbour leaf: a dense query on #embedding or a sparse one {index: weight} on a metadata key."""

    query: tuple = ()
    sparse: tuple | None = None
    key: str = "#embedding"
    limit: int = LEAF_LIMIT
    default: float | None = None
    return_rank: bool = False


@dataclass(frozen=True)
class Node:
    op: str
    children: tuple = ()
    value: float = 0.0
    leaf: Leaf | None = field(default=None)


def _number(value, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise Unprocessable(f"{what}: expected a number")
    return float(np.float32(value))


def sparse_query(raw: Mapping) -> tuple:
    """((index, weight), ...) of {"indices", "values"}: equal lengths, indices strictly ascending."""
    if not set(raw) <= {"#type", "indices", "values", "tokens"} or raw.get("#type", "sparse_vector") != "sparse_vector":
        raise Unprocessable("$knn.query: invalid sparse vector")
    indices, values = raw.get("indices"), raw.get("values")
    if not isinstance(indices, list) or not isinstance(values, list) or len(indices) != len(values):
        raise InvalidArgument("Validation error: rank: Invalid sparse vector in KNN query: lengths differ")
    if any(a >= b for a, b in zip(indices, indices[1:], strict=False)):
        raise InvalidArgument("Validation error: rank: Invalid sparse vector in KNN query: indices must be strictly ascending")
    return tuple((int(i), float(np.float32(v))) for i, v in zip(indices, values, strict=True))


def parse_leaf(raw) -> Leaf:
    if not isinstance(raw, Mapping):
        raise Unprocessable("$knn: expected an object")
    query = raw.get("query")
    made = {"key": raw.get("key", "#embedding"), "limit": raw.get("limit", LEAF_LIMIT), "return_rank": bool(raw.get("return_rank", False))}
    made["default"] = None if raw.get("default") is None else _number(raw["default"], "$knn.default")
    if isinstance(query, str):
        raise Unprocessable("$knn.query: string queries must be embedded by the client before sending")
    if isinstance(query, Mapping):
        return Leaf(sparse=sparse_query(query), **made)
    if isinstance(query, Sequence):
        return Leaf(query=tuple(_number(x, "$knn.query") for x in query), **made)
    raise Unprocessable("$knn.query: expected a dense or sparse vector")


def parse_rank(raw) -> Node:
    """The tree of a rank expression, JSON text or decoded; every node has exactly one operator."""
    raw = json.loads(raw) if isinstance(raw, str) else raw
    if not isinstance(raw, Mapping) or len(raw) != 1:
        raise Unprocessable("rank expression must have exactly one operator")
    op, body = next(iter(raw.items()))
    if op == "$val":
        return Node(op, value=_number(body, "$val"))
    if op == "$knn":
        return Node(op, leaf=parse_leaf(body))
    if op in SINGLES:
        return Node(op, (parse_rank(body),))
    if op in PAIRS:
        if not isinstance(body, Mapping) or body.get("left") is None or body.get("right") is None:
            raise Unprocessable(f"{op} requires left and right")
        return Node(op, (parse_rank(body["left"]), parse_rank(body["right"])))
    if op in LISTS:
        if not isinstance(body, list):
            raise Unprocessable(f"{op} expects a list")
        return Node(op, tuple(map(parse_rank, body)))
    raise Unprocessable(f"unknown rank operator `{op}`")


# Builders, the same shapes as decoded JSON.


def dense(query: Sequence[float], limit: int = LEAF_LIMIT, default: float | None = None, return_rank: bool = False) -> dict:
    return {"$knn": {"query": [float(x) for x in query], "limit": limit, "default": default, "return_rank": return_rank}}


def sparse(query: Mapping, key: str, limit: int = LEAF_LIMIT, default: float | None = None, return_rank: bool = False) -> dict:
    return {"$knn": {"query": dict(query), "key": key, "limit": limit, "default": default, "return_rank": return_rank}}


def val(x: float) -> dict:
    return {"$val": x}


def combine(op: str, *parts: dict) -> dict:
    if op in PAIRS:
        return {op: {"left": parts[0], "right": parts[1]}}
    return {op: parts[0]} if op in SINGLES else {op: list(parts)}


def rrf(parts: Sequence[dict], k: float = 60, weights: Sequence[float] | None = None) -> dict:
    """Reciprocal rank fusion of leaves made with return_rank: minus the weighted sum of 1 / (k + rank)."""
    weights = weights or [1.0] * len(parts)
    shares = [combine("$div", val(w), combine("$sum", val(k), p)) for w, p in zip(weights, parts, strict=True)]
    return combine("$mul", val(-1.0), combine("$sum", *shares))


def leaves(node: Node) -> list[Leaf]:
    """Depth first, left to right."""
    return [node.leaf] if node.leaf else [x for c in node.children for x in leaves(c)]


def leaf_scores(scored: DataFrame, leaf: Leaf, cut: str = "raw") -> DataFrame:
    """(rowid, v FLOAT) of a leaf from (rowid, raw): its `limit` best, as scores or as places from 0."""
    best = scored.orderBy(cut, "rowid").limit(leaf.limit).select("rowid", F.col("raw").cast("float").alias("v"))
    if not leaf.return_rank:
        return best
    # at most `limit` rows: one window over them all is bounded
    return best.select("rowid", (F.row_number().over(Window.orderBy("v", "rowid")) - 1).cast("float").alias("v"))


def _float(c: Column) -> Column:
    return c.cast("float")


def _divide(a: Column, b: Column) -> Column:
    """IEEE division of floats, which ANSI mode would refuse for a zero divisor."""
    infinite = F.when(F.isnan(a) | F.isnan(b) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(math.inf)).otherwise(F.lit(-math.inf))
    safe = F.when(b == 0, F.lit(1.0)).otherwise(b.cast("double"))
    return _float(F.when(b == 0, infinite).otherwise(a.cast("double") / safe))


def _log(a: Column) -> Column:
    return _float(F.when(F.isnan(a), a.cast("double")).when(a == 0, F.lit(-math.inf)).when(a < 0, F.lit(float("nan"))).otherwise(F.log(F.when(a > 0, a.cast("double")).otherwise(F.lit(1.0)))))


def _least(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan")).cast("float")).otherwise(F.least(a, b))


def _on_columns(op: str, a: Column, b: Column | None) -> Column:
    if op in ("$sum", "$sub"):
        return a + b if op == "$sum" else a - b
    if op == "$mul":
        return a * b
    if op == "$div":
        return _divide(a, b)
    if op == "$max":
        return F.greatest(a, b)  # NaN is greatest in Spark
    if op == "$min":
        return _least(a, b)
    if op == "$abs":
        return F.abs(a)
    return _float(F.exp(a.cast("double"))) if op == "$exp" else _log(a)


def _on_numbers(op: str, a: float, b: float | None) -> float:
    x, y = np.float32(a), None if b is None else np.float32(b)
    with np.errstate(all="ignore"):
        made = {
            "$sum": lambda: x + y, "$sub": lambda: x - y, "$mul": lambda: x * y, "$div": lambda: x / y, "$max": lambda: np.maximum(x, y),
            "$min": lambda: np.minimum(x, y), "$abs": lambda: abs(x), "$exp": lambda: np.exp(np.float64(x)), "$log": lambda: np.log(np.float64(x)),
        }[op]()
        return float(np.float32(made))


@dataclass
class Domain:
    value: Column
    present: Column
    default: float | None


def _constant(x: float) -> Domain:
    return Domain(F.lit(x).cast("float"), F.lit(False), float(np.float32(x)))


def _merge(op: str, a: Domain, b: Domain) -> Domain:
    if a.default is not None and b.default is not None:
        present, default = a.present | b.present, _on_numbers(op, a.default, b.default)
    elif a.default is not None or b.default is not None:
        present, default = (b.present if a.default is not None else a.present), None
    else:
        present, default = a.present & b.present, None

    def filled(d: Domain) -> Column:
        return d.value if d.default is None else F.when(d.present, d.value).otherwise(F.lit(d.default).cast("float"))

    return Domain(_on_columns(op, filled(a), filled(b)), present, default)


def evaluate(node: Node, domains: list[Domain]) -> Domain:
    """The node's domain; `domains` are those of leaves(node), used up from the front."""
    if node.leaf:
        return domains.pop(0)
    if node.op == "$val":
        return _constant(node.value)
    parts = [evaluate(c, domains) for c in node.children]
    if node.op in SINGLES:
        d = parts[0]
        return Domain(_on_columns(node.op, d.value, None), d.present, None if d.default is None else _on_numbers(node.op, d.default, None))
    if node.op in PAIRS:
        return _merge(node.op, *parts)
    start = {"$sum": 0.0, "$mul": 1.0, "$max": -MAX_FLOAT, "$min": MAX_FLOAT}[node.op]
    return reduce(lambda a, b: _merge(node.op, a, b), parts, _constant(start))


def score(node: Node, found: list[DataFrame]) -> DataFrame:
    """(rowid, score FLOAT) of the records that the expression ranks; found are the leaves' (rowid, v)."""
    every, domains = None, []
    for i, (leaf, df) in enumerate(zip(leaves(node), found, strict=True)):
        named = df.select("rowid", F.col("v").alias(f"v{i}"), F.lit(True).alias(f"p{i}"))
        every = named if every is None else every.join(named, "rowid", "full")
        domains.append(Domain(F.col(f"v{i}"), F.coalesce(F.col(f"p{i}"), F.lit(False)), leaf.default))
    if every is None:
        raise Unprocessable("rank expression has no $knn")
    out = evaluate(node, domains)
    return every.filter(out.present).select("rowid", out.value.cast("float").alias("score"))


def ordered(scores: DataFrame) -> DataFrame:
    """Ascending score, NaN last, ties by rowid."""
    return scores.orderBy(F.isnan("score"), "score", "rowid")
