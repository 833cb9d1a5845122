"""The best k of each group of ranked records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.errors import Unprocessable, Validation

SPECIAL = ("#document", "#embedding", "#metadata", "#score")


@dataclass(frozen=True)
class GroupBy:
    keys: tuple
    op: str
    aggregate: tuple
    k: int


def parse_group_by(raw: Mapping | None, ranked: bool = True) -> GroupBy | None:
    """Checked in the order a caller meets the errors; None where neither keys nor an aggregate are given."""
    if not raw or not raw.get("keys") and not raw.get("aggregate"):
        return None
    keys, aggregate = raw.get("keys") or [], raw.get("aggregate")
    op, body = None, {}
    if aggregate:
        if len(aggregate) != 1:
            raise Unprocessable("expected exactly one aggregate operator")
        op, body = next(iter(aggregate.items()))
        if op not in ("$min_k", "$max_k"):
            raise Unprocessable(f"unknown variant `{op}`, expected `$min_k` or `$max_k`")
        if body.get("k") is None:
            raise Unprocessable("missing field `k`")
    if not keys:
        raise Validation("group_by", "group_by keys must not be empty when aggregate is specified")
    if not aggregate:
        raise Validation("group_by", "group_by aggregate must be specified when keys are provided")
    for key in keys:
        if key in SPECIAL:
            raise Validation("group_by", f"group_by keys must be metadata fields, got {key}")
    if not body.get("keys"):
        raise Validation("group_by", "aggregate keys must not be empty")
    if body["k"] <= 0:
        raise Validation("group_by", "aggregate k must be greater than 0")
    if not ranked:
        raise Validation("group_by", "group_by requires rank expression to be specified")
    return GroupBy(tuple(keys), op, tuple(body["keys"]), int(body["k"]))


def sort_value(value: Column) -> Column:
    """How typed metadata orders: missing, booleans, numbers of both kinds by value, strings, others alike."""
    kind = value["kind"]
    bucket = F.when(kind.isNull(), 0).when(kind == 1, 1).when(kind.isin(2, 3), 2).when(kind == 4, 4).otherwise(kind)
    return F.struct(bucket.alias("bucket"), value["b"].alias("b"), F.coalesce(value["f"], value["i"].cast("double")).alias("n"), value["s"].alias("s"))


def group_value(value: Column) -> Column:
    """What tells groups apart: the kind too, so 1 and 1.0 are two groups; a missing key is a group."""
    return F.struct(*(value[f].alias(f) for f in ("kind", "b", "i", "f", "s")))


def best_of_groups(ranked: DataFrame, group: GroupBy, columns: Mapping[str, Column] | None = None) -> DataFrame:
    """The k first rows of each group of ranked (rowid, score, ...), in rank order.

    $min_k sorts the aggregate keys ascending with missing ones first, $max_k descending with them last;
    then by score (NaN last) and rowid. columns maps keys to Columns (default: the column so named);
    struct-typed metadata is ordered by sort_value and grouped by group_value.
    """
    types = {f.name: f.dataType for f in ranked.schema.fields}

    def get(key: str) -> Column:
        if key == "#score":
            return F.col("score")
        return columns[key] if columns and key in columns else F.col(f"`{key}`")

    def typed(key: str) -> bool:
        return isinstance(types.get(key), T.StructType)

    partition = [group_value(get(k)) if typed(k) else get(k) for k in group.keys]
    down = group.op == "$max_k"
    order = [sort_value(get(k)) if typed(k) else get(k) for k in group.aggregate]
    order = [c.desc_nulls_last() if down else c.asc_nulls_first() for c in order]
    window = Window.partitionBy(*partition).orderBy(*order, F.isnan("score"), "score", "rowid")
    kept = ranked.withColumn("__k", F.row_number().over(window)).filter(F.col("__k") <= group.k).drop("__k")
    return kept.orderBy(F.isnan("score"), "score", "rowid")
