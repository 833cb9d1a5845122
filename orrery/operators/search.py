"""A search: filter, leaves, rank expression, grouping, page, projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.errors import InvalidArgument, Unprocessable
from orrery.functions.vectors import distance_to
from orrery.operators.filters import ColumnBinding, MapBinding, compile_filter, parse_where
from orrery.operators.grouping import SPECIAL, GroupBy, best_of_groups, parse_group_by
from orrery.operators.knn import check_query
from orrery.operators.rank import Leaf, Node, leaf_scores, leaves, ordered, parse_rank, score
from orrery.operators.sparse import TextIndex, sparse_scores


@dataclass
class Payload:
    filter: object = None
    rank: Node | None = None
    group_by: GroupBy | None = None
    limit: int | None = None
    offset: int = 0
    select: tuple = ()


def sort_keys(keys: Sequence[str]) -> tuple:
    """Distinct keys, the special ones first in their fixed order, then fields by name."""
    return tuple(sorted(dict.fromkeys(keys), key=lambda k: (SPECIAL.index(k) if k in SPECIAL else len(SPECIAL), k)))


def parse_payload(raw: Mapping) -> Payload:
    known = {"filter", "rank", "group_by", "limit", "select"}
    if not isinstance(raw, Mapping):
        raise Unprocessable("searches: expected an object")
    parts = {k: raw.get(k) for k in known}
    rank = None if parts["rank"] is None else parse_rank(parts["rank"])
    page = parts["limit"] or {}
    for name in ("limit", "offset"):
        if page.get(name) is not None and (not isinstance(page[name], int) or page[name] < 0):
            raise Unprocessable(f"limit: invalid {name}")
    return Payload(
        parse_where(parts["filter"]) if parts["filter"] else None, rank, parse_group_by(parts["group_by"], rank is not None),
        page.get("limit"), page.get("offset") or 0, sort_keys((parts["select"] or {}).get("keys") or ()),
    )


def shows_metadata(select: Sequence[str]) -> bool:
    """Whether a response has a metadata column: it does for #metadata, or if the last of the sorted keys is a field (#id counts as one)."""
    keys = sort_keys(select)
    return "#metadata" in keys or bool(keys) and keys[-1] not in SPECIAL


def project_metadata(metadata: Column, keys: Sequence[str]) -> Column:
    """The listed keys of a metadata map; null if none is left."""
    kept = F.map_filter(metadata, lambda k, v: k.isin(*keys))
    return F.when(F.size(kept) > 0, kept)


class Collection:
    """Records with what a search needs to know of them.

    records(rowid, id, embedding, document, metadata columns...); postings: for each sparse key its
    (rowid, dim, value), or a TextIndex over a column of the records; bm25: the sparse keys whose queries are scaled by inverse document frequency.
    """

    def __init__(self, records: DataFrame, space: str = "l2", dimension: int | None = None, postings: Mapping[str, DataFrame | TextIndex] | None = None, bm25: Sequence[str] = (), binding=None):
        self.records, self.space, self.dimension = records, space, dimension
        self.postings, self.bm25 = dict(postings or {}), set(bm25)
        self.binding = binding or ColumnBinding(records)
        self._total: int | None = None

    def field(self, key: str) -> Column:
        """A metadata key's value, of an ordinary column or of the typed map; null where it is neither."""
        if isinstance(self.binding, MapBinding):
            return F.try_element_at(self.binding.metadata, F.lit(key))
        name = self.binding.keys.get(key, key)
        return F.col(f"`{name}`") if name in self.records.columns else F.lit(None).cast("string")

    def total(self) -> int:
        if self._total is None:
            self._total = self.records.count()
        return self._total

    def leaf(self, leaf: Leaf, kept: DataFrame, filtered: bool) -> DataFrame:
        """(rowid, v) of one leaf over the records that the filter keeps."""
        if leaf.sparse is None:
            if leaf.key != "#embedding":
                raise InvalidArgument(f"dense query on sparse key {leaf.key}")
            check_query(leaf.query, self.dimension)
            sized = kept.filter(F.col("embedding").isNotNull() & (F.size("embedding") == len(leaf.query)))
            scored = sized.select("rowid", distance_to(F.col("embedding"), leaf.query, self.space).alias("raw"))
        else:
            if leaf.key not in self.postings:
                raise InvalidArgument(f"sparse query on key {leaf.key} without sparse vectors")
            total = self.total() if leaf.key in self.bm25 else None
            index = self.postings[leaf.key]
            if isinstance(index, TextIndex):
                scored = index.scores(self.records, leaf.sparse, kept if filtered else None, total)
            else:
                scored = sparse_scores(index, leaf.sparse, kept if filtered else None, total)
        return leaf_scores(scored, leaf)

    def ranked(self, payload: Payload) -> DataFrame:
        """(rowid, score) in order, after grouping and paging; unranked searches come in insertion order with null scores."""
        kept = self.records if payload.filter is None else self.records.filter(compile_filter(payload.filter, self.binding))
        if payload.rank is None:
            out = kept.select("rowid", F.lit(None).cast("float").alias("score")).orderBy("rowid")
        else:
            found = [self.leaf(x, kept, payload.filter is not None) for x in leaves(payload.rank)]
            # an expression of constants ranks nothing
            out = score(payload.rank, found) if found else self.records.limit(0).select("rowid", F.lit(0.0).cast("float").alias("score"))
            if payload.group_by:
                wanted = [k for k in dict.fromkeys((*payload.group_by.keys, *payload.group_by.aggregate)) if k != "#score"]
                out = out.join(self.records.select("rowid", *(self.field(k).alias(k) for k in wanted)), "rowid")
                out = best_of_groups(out, payload.group_by).select("rowid", "score")
            else:
                out = ordered(out)
        if payload.offset:
            out = out.offset(payload.offset)
        return out if payload.limit is None else out.limit(payload.limit)

    def search(self, raw: Mapping | Payload) -> DataFrame:
        """id and the selected keys, in order: fields are fetched for the ranked records only."""
        payload = raw if isinstance(raw, Payload) else parse_payload(raw)
        out = self.ranked(payload)
        special = {"#document": F.col("document"), "#embedding": F.col("embedding")}
        typed = isinstance(self.binding, MapBinding)
        names = [(k, special[k] if k in special else self.field(k)) for k in payload.select if k not in ("#score", "#metadata")]
        if "#metadata" in payload.select:
            names += [("#metadata", self.binding.metadata)] if typed else [(k, F.col(f"`{c}`")) for k, c in self.binding.keys.items() if k not in payload.select]
        fields = [c.alias(k) for k, c in names]
        out = out.withColumnRenamed("rowid", "__rowid")
        joined = out.join(self.records.select(F.col("rowid").alias("__rowid"), "id", *fields), "__rowid")
        columns = ["id", *(k for k, _ in names), *(["score"] if "#score" in payload.select else [])]
        return joined.orderBy(F.col("score").isNull(), F.isnan("score"), "score", "__rowid").select(*(F.col(f"`{c}`") for c in columns))

    def respond(self, payloads: Sequence[Mapping | Payload]) -> DataFrame:
        """One row a search: (search, ids, documents, metadatas, embeddings, scores), arrays in rank order.

        A column is null for a search that did not select it; metadata is JSON text without the keys that a
        record lacks. A search's rows are at most its limit.
        """
        out = None
        for number, raw in enumerate(payloads):
            payload = raw if isinstance(raw, Payload) else parse_payload(raw)
            keys = set(payload.select)
            fields = [k for k in keys if k not in SPECIAL]
            found = self.search(replace(payload, select=sort_keys([*keys, "#score"])))
            shown = [F.col(f"`{k}`").alias(k) for k in found.columns if k not in ("id", "score", "#document", "#embedding", "#metadata")]
            meta = F.to_json(F.col("`#metadata`")) if "#metadata" in found.columns else F.to_json(F.struct(*shown)) if shown and (fields or "#metadata" in keys) else F.lit(None).cast("string")
            part = {
                "id": F.col("id"), "score": F.col("score"), "metadata": meta if shows_metadata(payload.select) else F.lit(None).cast("string"),
                "document": F.col("`#document`") if "#document" in keys else F.lit(None).cast("string"),
                "embedding": F.col("`#embedding`") if "#embedding" in keys else F.lit(None).cast("array<float>"),
            }
            rows = found.select(*(c.alias(n) for n, c in part.items()))
            order = F.struct(F.col("score").isNull().alias("a"), F.isnan("score").alias("b"), F.col("score").alias("c"), F.monotonically_increasing_id().alias("d"))
            listed = rows.select(F.struct(order.alias("o"), *part).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("r"))
            off = {"document": "#document" in keys, "embedding": "#embedding" in keys, "metadata": shows_metadata(payload.select), "score": "#score" in keys}
            pick = lambda n, on=True: F.col(f"r.{n}") if on else F.lit(None).cast(f"array<{rows.schema[n].dataType.simpleString()}>")  # noqa: E731, B023
            one = listed.select(F.lit(number).alias("search"), pick("id").alias("ids"), *(pick(n, off[n]).alias(n + "s") for n in ("document", "metadata", "embedding", "score")))
            out = one if out is None else out.unionByName(one)
        return out
