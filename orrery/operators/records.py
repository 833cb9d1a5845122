"""The record log: add, upsert, update and delete on immutable tables.

A state is a DataFrame (rowid, id, embedding, document, uri, metadata MAP<STRING, V>, seq); a batch is
(ord, id, embedding, document, uri, metadata), applied in the order of ord. In a batch's metadata a key
with a null value deletes the key. Empty metadata is null. Every operation returns a new lazy state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.errors import InvalidArgument, Unprocessable, Validation
from orrery.runtime import BROADCAST_ROWS, cut_lineage

#: Ids up to which a list of them is a predicate, which reaches the scan.
FEW_IDS = 200
FIELDS = ("embedding", "document", "uri")


def number_rows(df: DataFrame, order: str, name: str, start: int = 1) -> DataFrame:
    """Consecutive numbers in the given order, without gathering the rows: range partitions are numbered apart."""
    ranged = cut_lineage(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()))
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # one row a partition
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy("__p").orderBy(order)
    numbered = ranged.join(F.broadcast(sizes), "__p").withColumn(name, (F.row_number().over(inside) + F.col("__before") + F.lit(start - 1)).cast("long"))
    return numbered.drop("__p", "__before")


# Messages of refused batches.
LENGTHS = "Inconsistent number of IDs, embeddings, documents, URIs and metadatas"
EMPTY_ID = "Empty ID, ID must have at least one character"
BAD_METADATA = "Invalid metadata at index {}"


def check_lengths(ids: Sequence, *others: Sequence | None) -> None:
    """The lists of a request must be as long as its ids; absent ones are None."""
    if any(o is not None and len(o) != len(ids) for o in others):
        raise InvalidArgument(LENGTHS)


def _bad_sparse(value: Column) -> Column:
    """Whether a typed value is a sparse vector whose indices do not ascend or whose lists differ in length."""
    v = value["sv"]
    n = F.size(v["indices"])
    falls = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(v["indices"], i) <= F.get(v["indices"], i - 1))
    uneven = (n != F.size(v["values"])) | (v["tokens"].isNotNull() & (n != F.size(v["tokens"])))
    return (value["kind"] == 5) & (uneven | F.coalesce(falls, F.lit(False)))


def validate(batch: DataFrame, dimension: int | None, op: str, most: int | None = None) -> int | None:
    """Checks one batch in one aggregation and returns the dimension it fixes or keeps.

    Refused: null or empty ids, missing embeddings (but in an update), other dimensions than the collection's,
    keys that are empty or begin with # or $, sparse vectors that are none, null metadata values in an
    add, more than `most` rows.
    """
    size = F.size("embedding")
    bad = F.exists(F.map_keys("metadata"), lambda k: (k == "") | k.startswith("#") | k.startswith("$"))
    if "kind" in getattr(batch.schema["metadata"].dataType.valueType, "names", ()):
        bad = bad | F.exists(F.map_values("metadata"), lambda v: F.coalesce(_bad_sparse(v), F.lit(False)))
    row = batch.agg(
        F.count(F.when(F.col("id").isNull() | (F.col("id") == ""), 1)).alias("ids"), F.count(F.when(F.col("embedding").isNull(), 1)).alias("nulls"),
        F.min(F.when(F.col("embedding").isNotNull(), size)).alias("low"), F.max(F.when(F.col("embedding").isNotNull(), size)).alias("high"),
        F.min(F.when(bad, F.col("ord"))).alias("bad"), F.count(F.lit(1)).alias("rows"),
        F.count(F.when(F.exists(F.map_values("metadata"), lambda v: v.isNull()), 1)).alias("null_values"),
    ).first()
    if most is not None and row.rows > most:
        raise InvalidArgument(f"batch of {row.rows} records exceeds the maximum of {most}")
    if row.null_values and op == "add":
        raise Unprocessable("metadatas: null values are not allowed")
    if row.ids:
        raise InvalidArgument(EMPTY_ID)
    if row.bad is not None:
        raise Validation("metadatas", BAD_METADATA.format(row.bad))
    if op != "update" and row.nulls:
        raise InvalidArgument("embeddings are required")
    wanted = dimension if dimension is not None else row.low
    if row.low is not None and (row.low != wanted or row.high != wanted or wanted < 1):
        raise InvalidArgument(f"Collection expecting embedding with dimension of {wanted}, got {row.high if row.high != wanted else row.low}")
    return wanted


def _fold(batch: DataFrame) -> DataFrame:
    """One row an id: the first place, the last value given of each field, and of each key the last entry (__meta, null values kept)."""
    latest = [F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("ord"))).alias(f) for f in FIELDS]
    rows = batch.groupBy("id").agg(F.min("ord").alias("ord"), *latest)
    entries = batch.select("id", "ord", F.explode("metadata").alias("key", "value"))
    last = entries.groupBy("id", "key").agg(F.max_by(F.struct(F.col("value").alias("v")), "ord").alias("entry"))
    meta = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "entry"))).alias("__meta"))
    return rows.join(meta, "id", "left")


def _plain(meta: Column) -> Column:
    """Entries to plain metadata: deleted keys go, nothing left is null."""
    kept = F.transform_values(F.map_filter(meta, lambda k, e: e["v"].isNotNull()), lambda k, e: e["v"])
    return F.when(F.size(kept) > 0, kept)


def _merged(old: Column, new: Column) -> Column:
    wrapped = F.transform_values(old, lambda k, v: F.struct(v.alias("v")))
    both = F.map_zip_with(wrapped, new, lambda k, a, b: F.coalesce(b, a))
    return F.when(new.isNull(), F.when(F.size(old) > 0, old)).when(old.isNull(), _plain(new)).otherwise(_plain(both))


def _insert(state: DataFrame, rows: DataFrame, seq: int | None, next_rowid: int | None) -> DataFrame:
    start = next_rowid if next_rowid is not None else (state.agg(F.max("rowid")).first()[0] or 0) + 1
    numbered = number_rows(rows, "ord", "rowid", start)
    return numbered.select("rowid", "id", *FIELDS, "metadata", F.lit(seq).cast("long").alias("seq"))


def _new(state: DataFrame, batch: DataFrame) -> DataFrame:
    first = Window.partitionBy("id").orderBy("ord")
    new = batch.join(state.select("id"), "id", "left_anti").withColumn("__r", F.row_number().over(first)).filter("__r = 1")
    return new.withColumn("metadata", F.when(F.size("metadata") > 0, F.map_filter("metadata", lambda k, v: v.isNotNull())))


def _fresh(state: DataFrame, folded: DataFrame) -> DataFrame:
    return folded.join(state.select("id"), "id", "left_anti").withColumn("metadata", _plain(F.col("__meta"))).drop("__meta")


def add(state: DataFrame, batch: DataFrame, seq: int = 0, next_rowid: int | None = None) -> DataFrame:
    """New ids only: existing ones are ignored, and of repeated ids in the batch the first counts.

    Null metadata values are for validate() to refuse; here they are left out.
    """
    return state.unionByName(_insert(state, _new(state, batch), seq, next_rowid))


def update(state: DataFrame, batch: DataFrame, seq: int = 0) -> DataFrame:
    """Existing ids only: null fields keep the old value, metadata is merged key by key."""
    return _touch(state, _fold(batch), seq)


def _touch(state: DataFrame, folded: DataFrame, seq: int | None, how: str = "left") -> DataFrame:
    new = folded.select("id", F.col("ord").alias("__ord"), "__meta", *(F.col(f).alias(f"__{f}") for f in FIELDS))
    joined = state.join(new, "id", how)
    fields = [F.coalesce(f"__{f}", f).alias(f) for f in FIELDS]
    meta = F.when(F.col("__ord").isNull(), F.col("metadata")).otherwise(_merged(F.col("metadata"), F.col("__meta")))
    stamp = F.when(F.col("__ord").isNotNull(), F.lit(seq).cast("long")).otherwise(F.col("seq"))
    return joined.select("rowid", "id", *fields, meta.alias("metadata"), stamp.alias("seq"))


def upsert(state: DataFrame, batch: DataFrame, seq: int = 0, next_rowid: int | None = None) -> DataFrame:
    """Updates existing ids and inserts the others, in the batch's order."""
    folded = _fold(batch)
    return _touch(state, folded, seq).unionByName(_insert(state, _fresh(state, folded), seq, next_rowid))


def changes(state: DataFrame, batch: DataFrame, op: str, next_rowid: int) -> DataFrame:
    """The rows that add, update or upsert inserts or changes, and no others, with a null seq: a delta to lay over the state."""
    if op == "add":
        return _insert(state, _new(state, batch), None, next_rowid)
    folded = cut_lineage(_fold(batch))
    touched = _touch(state, folded, None, "inner")
    return touched if op == "update" else touched.unionByName(_insert(state, _fresh(state, folded), None, next_rowid))


def doomed(state: DataFrame, ids: Sequence[str] | None, keep: Column | None, limit: int | None = None) -> DataFrame:
    """The rows that a delete removes: those of the ids, if any, that `keep` keeps; the first `limit` of them where there is a filter."""
    found = state if ids is None else with_ids(state, ids)
    if keep is not None:
        found = found.filter(F.coalesce(keep, F.lit(False)))
        found = found if limit is None else found.orderBy("rowid").limit(limit)
    return found


def delete(state: DataFrame, ids: Sequence[str] | None = None, keep: Column | None = None, limit: int | None = None) -> tuple[DataFrame, int]:
    """(new state, number): neither ids nor a filter delete nothing; ids alone report the number asked for.

    keep is the filter's Column (what it keeps is deleted); limit applies in insertion order and only with a filter.
    """
    if ids is None and keep is None:
        return state, 0
    gone = cut_lineage(doomed(state, ids, keep, limit).select("rowid"))
    return state.join(gone, "rowid", "left_anti").select(*state.columns), len(ids) if keep is None else gone.count()


def with_ids(records: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The records with the given ids; a long list is joined instead of written into the plan."""
    if len(ids) <= FEW_IDS:
        return records.filter(F.col("id").isin(*ids)) if ids else records.limit(0)
    named = records.sparkSession.createDataFrame([(i,) for i in set(ids)], "id string")
    return records.join(F.broadcast(named) if len(ids) <= BROADCAST_ROWS else named, "id", "left_semi")


def counts(rows: DataFrame, by: str | None = None) -> DataFrame:
    """(by, n): how many rows there are, of each value of a column or altogether."""
    return (rows.groupBy(by) if by else rows).agg(F.count(F.lit(1)).alias("n"))


def last_writes(rows: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(*keys, *columns) of the last row of each key by the order columns; combined before the shuffle."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("m"))
    return last.select(*keys, *(f"m.{c}" for c in columns))


def key_growth(state: DataFrame, kind: str = "kind") -> DataFrame:
    """(key, kind): the metadata keys and value kinds that occur."""
    return state.select(F.explode("metadata").alias("key", "value")).select("key", F.col(f"value.{kind}").alias("kind")).distinct()
