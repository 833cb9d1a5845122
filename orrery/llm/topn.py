"""Top N rows of every group by sorted runs and a loser-tree merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.runtime import at_most, cut_lineage, parallelism

#: Rows of one sorted run, on average; a bucket with more rows is dealt into several runs, whatever the data's size.
RUN_ROWS = 8_192
#: Buckets of several runs whose numbers of runs (two numbers each) may be broadcast; beyond that they are joined with salts.
RUN_BUCKETS = 1_000_000


class LoserTree:
    """k-way merge of sorted sequences: each pop costs log2(k) comparisons along one leaf-to-root path.

    heads are the current keys of the k runs, None for an exhausted run.
    """

    def __init__(self, heads: list):
        self.heads = heads
        self.k = max(1, len(heads))
        self.loser = [-1] * self.k
        self.winner = self._play(1) if heads else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        left, right = self._play(2 * node), self._play(2 * node + 1)
        first, second = (left, right) if self._beats(left, right) else (right, left)
        self.loser[node] = second
        return first

    def replace(self, head) -> None:
        """The winner's run moves on to its next key."""
        at = self.winner
        self.heads[at] = head
        node = (at + self.k) // 2
        while node >= 1:
            other = self.loser[node]
            if self._beats(other, at):
                self.loser[node], at = at, other
            node //= 2
        self.winner = at


def merge_runs(runs: list[list[tuple]], n: int) -> list[tuple[int, int]]:
    """The first n of the merged runs as (run, position)."""
    out: list[tuple[int, int]] = []
    at = [0] * len(runs)
    tree = LoserTree([run[0] if run else None for run in runs])
    while len(out) < n and tree.winner >= 0 and tree.heads[tree.winner] is not None:
        won = tree.winner
        out.append((won, at[won]))
        at[won] += 1
        tree.replace(runs[won][at[won]] if at[won] < len(runs[won]) else None)
    return out


def _starts(batch: pa.Table, keys: list[str]) -> np.ndarray:
    """Where, in sorted rows, another combination of keys begins. Null equals null."""
    size = batch.num_rows
    new = np.zeros(size, dtype=bool)
    new[:1] = True
    for key in keys:
        column = batch.column(key).combine_chunks()
        a, b = column.slice(0, size - 1), column.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        nulls = pc.is_null(column).to_numpy(zero_copy_only=False)
        new[1:] |= differ.astype(bool) | (nulls[1:] != nulls[:-1])
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the starts of the groups, from a stream sorted by the keys.

    A group that spans batches is held until it ends; callers bound the rows of a group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch])
        starts = _starts(table, keys)
        if len(starts) == 1:
            held = table.to_batches()
            continue
        yield table.slice(0, starts[-1]), starts[:-1]
        held = table.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, _starts(table, keys)


def _merge(keys: list[str], n: str, order: list[str], columns: list[str]):
    """Merge the sorted runs of each group, n rows deep, then seek the next group by its offset.

    A group of one run gives its first n rows by position; several runs go through a loser tree.
    """

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches, keys):
            ends = np.append(starts[1:], table.num_rows)
            depth = table.column(n).to_numpy()[starts]
            run = table.column("run").to_numpy()
            single = run[starts] == run[ends - 1]
            many = np.minimum(ends - starts, depth)[single]
            first = np.repeat(starts[single], many)
            rank = np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
            take, place = (first + rank).tolist(), (rank + 1).tolist()
            for a, b, deep in zip(starts[~single].tolist(), ends[~single].tolist(), depth[~single].tolist(), strict=True):
                heads = list(zip(*(table.column(c).slice(a, b - a).to_pylist() for c in order), strict=True))
                edges = [0, *(1 + np.flatnonzero(np.diff(run[a:b]))).tolist(), b - a]
                found = merge_runs([heads[x:y] for x, y in zip(edges, edges[1:], strict=False)], deep)
                take.extend(a + edges[r] + at for r, at in found)
                place.extend(range(1, len(found) + 1))
            out = table.select(columns).take(pa.array(take, pa.int64()))
            yield from out.append_column("rank", pa.array(place, pa.int32())).combine_chunks().to_batches()

    return merged


def run_counts(rows: DataFrame, bucket: str, run_rows: int = RUN_ROWS) -> DataFrame:
    """(bucket, runs) of the buckets with more rows than one run has; a count of one column, written out."""
    counted = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > run_rows)
    return cut_lineage(counted.select(bucket, F.ceil(F.col("n") / run_rows).cast("int").alias("runs")))


def with_run(rows: DataFrame, runs: DataFrame, bucket: str, tie: str, most: int = RUN_BUCKETS) -> DataFrame:
    """rows with `run`: 0, or in a bucket of several runs the one that the hash of `tie` names. A null bucket is a bucket."""
    named = runs.select(F.col(bucket).alias("__bucket"), F.col("runs").alias("__runs"))
    if at_most(named, most):
        joined = rows.join(F.broadcast(named), F.col(bucket).eqNullSafe(F.col("__bucket")), "left")
    else:
        salts = parallelism(rows.sparkSession)
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(tie), F.lit(salts)).cast("int"))
        copies = named.withColumn("__own", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted.join(copies, F.col(bucket).eqNullSafe(F.col("__bucket")) & (F.col("__salt") == F.col("__own")), "left").drop("__salt", "__own")
    run = F.coalesce(F.pmod(F.xxhash64(tie), F.col("__runs")), F.lit(0)).cast("int")
    return joined.withColumn("run", run).drop("__bucket", "__runs")


def top_n_per_group(
    rows: DataFrame, keys: list[str], order: list[Column], tie: str, n: Column, bucket: str | None = None,
    prepare=None, runs: DataFrame | None = None, run_rows: int = RUN_ROWS, columns: list[str] | None = None,
) -> DataFrame:
    """The n first rows of every group, with their rank from 1, in one reproducible order.

    keys: the group columns; null equals null and differs from the empty string.
    order: ascending sort expressions of type number, string or timestamp, none of them null or NaN
      in rows that count (rows where one is null are no candidates and are left out); equal rows go
      by `tie`, a column that is unique within a group.
    n: rows to keep of a group, constant in it. None or less than 1 keeps nothing.
    bucket: one of the keys whose hash spreads the groups (default the first). A bucket with more
      than `run_rows` rows is split by `tie` into several runs, so no run grows with the data.
    prepare: f(rows with column run) -> rows, done where all rows of one (bucket, run) are together,
      e.g. to keep the newest version or to attach attributes of the bucket; it must keep `run`.
    runs: the result of run_counts(rows, bucket), where the caller has it already.
    columns: what to carry beside the keys and `tie` (default all).

    A run holds the rows of one (bucket, run), sorted by group and order and no deeper than n. The runs
    of each group meet in one task, and every group comes out of their merge, which stops after n rows
    and seeks the next group. A group has at most runs * n rows there. Empty input gives an empty
    result. Extra columns are carried along; the names run, rank and those beginning with __ are
    the operator's own.
    """
    bucket = bucket or keys[0]
    marked = with_run(rows, run_counts(rows, bucket, run_rows) if runs is None else runs, bucket, tie)
    names = [f"__o{i}" for i in range(len(order))]
    part = prepare(marked) if prepare else marked.repartition(bucket, "run")
    part = part.withColumns(dict(zip(names, order, strict=True)) | {"__n": n.cast("int")})
    good = F.col("__n") > 0
    for name in names:
        good &= F.col(name).isNotNull()
    run = Window.partitionBy(bucket, "run", *(k for k in keys if k != bucket)).orderBy(*names, tie)
    part = part.filter(good).withColumn("__at", F.row_number().over(run)).filter("__at <= __n").drop("__at")
    if columns is not None:
        part = part.select(*dict.fromkeys([*keys, tie, *columns]), "run", "__n", *names)
    part = part.repartition(*keys).sortWithinPartitions(*keys, "run", *names, tie)
    out = [c for c in part.columns if c not in ("run", "__n", *names)]
    schema = T.StructType([*part.select(*out).schema.fields, T.StructField("rank", T.IntegerType())])
    return part.mapInArrow(_merge(keys, "__n", [*names, tie], out), schema)


def top_hits(hits: DataFrame, searches: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """For every grouped search, the agg_k best hits of each group: (search_id, category, lang, year, rowid, score, rank).

    hits(search_id, rowid, category, lang, year, score, scored_at); searches(search_id, group_keys,
    agg_op, agg_k). Of several hits with one search and record the newest counts; between equal
    scored_at the higher score. A newest score that is null or NaN makes the record no candidate.
    Group columns that a search does not group by come out null. A search without group_keys, with
    agg_k null or below 1, or with an unknown agg_op has no rows; of repeated searches with one id the
    least definition counts. Hits with a null search_id or rowid are left out.
    """
    keys = ["category", "lang", "year"]
    hits = hits.select("search_id", "rowid", *keys, "score", "scored_at").filter("search_id is not null and rowid is not null")
    grouped = searches.filter("search_id is not null and size(group_keys) > 0 and agg_k > 0 and agg_op in ('$min_k', '$max_k')")
    plans = grouped.groupBy("search_id").agg(F.min(F.struct("group_keys", "agg_op", "agg_k")).alias("p")).select("search_id", "p.*")
    runs = run_counts(hits, "search_id", run_rows)
    plans = plans.join(F.broadcast(runs) if at_most(runs, RUN_BUCKETS) else runs, "search_id", "left")
    plans = plans.withColumn("run", F.explode(F.sequence(F.lit(0), F.coalesce("runs", F.lit(1)) - 1))).drop("runs")

    def prepare(part: DataFrame) -> DataFrame:
        newest = Window.partitionBy("search_id", "run", "rowid").orderBy(F.col("scored_at").desc_nulls_last(), F.col("score").desc_nulls_last())
        part = part.join(plans.hint("shuffle_merge"), ["search_id", "run"])
        part = part.withColumn("__v", F.row_number().over(newest)).filter("__v = 1").drop("__v")
        for key in keys:
            part = part.withColumn(key, F.when(F.array_contains("group_keys", key), F.col(key)))
        return part.drop("group_keys")

    score = F.when(~F.isnan("score"), F.col("score"))
    score = F.when(F.col("agg_op") == "$max_k", F.lit(0.0).cast("float") - score).otherwise(score + F.lit(0.0).cast("float"))
    top = top_n_per_group(hits, ["search_id", *keys], [score], "rowid", F.col("agg_k"), prepare=prepare, runs=runs, columns=["score"])
    return top.select("search_id", *keys, "rowid", "score", "rank")
