"""Nearest records of stated queries: exact, batched, two-stage, and by an inverted-file index."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.errors import EngineError, InvalidArgument
from orrery.functions.vectors import UNROLL, Best, block_distances, check_space, distance_to
from orrery.operators.records import with_ids
from orrery.runtime import cut_lineage, parallelism, shared_folder

DEFAULT_RESULTS = 10
#: Queries that one pass over the records answers; more are taken in further passes.
QUERY_BLOCK = 512


def check_query(query: Sequence[float], dimension: int | None) -> None:
    if dimension is not None and len(query) != dimension:
        raise InvalidArgument(f"Collection expecting embedding with dimension of {dimension}, got {len(query)}")


def restrict_ids(records: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The records with the given ids; an unknown id fails the whole query."""
    found = with_ids(records, list(ids))
    if found.select("id").distinct().count() != len(set(ids)):
        raise EngineError("Error executing plan: Internal error: Error finding id")
    return found


def ef_search(configured: int, n: int) -> int:
    return min(max(configured, n, 1), 1000)


def knn(records: DataFrame, query: Sequence[float], n: int = DEFAULT_RESULTS, space: str = "l2", dimension: int | None = None) -> DataFrame:
    """records with a `distance` FLOAT, the n nearest in order; cut on the double distance, then ordered by (float, rowid).

    Null embeddings, and embeddings of another length than the query's, are left out. n = 0 is empty. Up to
    UNROLL dimensions the distance is generated code; above, blocks of vectors are ranked in NumPy, which
    reads rowid and embedding only, and the n rows found are fetched by their rowids.
    """
    check_query(query, dimension)
    if len(query) > UNROLL:
        found = knn_batch(records, [(0, query)], n, space).select("rowid", "distance")  # n rows
        return records.filter(F.size("embedding") == len(query)).join(F.broadcast(found), "rowid").select(*records.columns, "distance").orderBy("distance", "rowid")
    raw = distance_to(F.col("embedding"), query, space)
    sized = records.filter(F.col("embedding").isNotNull() & (F.size("embedding") == len(query)))
    cut = sized.withColumn("__raw", raw).orderBy("__raw", "rowid").limit(n)
    return cut.withColumn("distance", F.col("__raw").cast("float")).drop("__raw").orderBy("distance", "rowid")


def _best(queries: list[tuple[int, np.ndarray]], n: int, space: str, coarse: bool):
    """The n best of a partition for each query, kept as the partition streams by."""
    ids = np.array([q for q, _ in queries], dtype=np.int64)
    matrix = np.stack([v for _, v in queries]) if queries else np.empty((0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(matrix, n, space)
        for batch in batches:
            if not batch.num_rows or not n:
                continue
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, matrix.shape[1])
            if coarse:
                vectors = vectors.astype(np.float16).astype(np.float32)
            best.see(batch.column(0).to_numpy(), vectors)
        q, rowid, distance = best.rows()
        yield pa.RecordBatch.from_pydict({"qid": pa.array(ids[q]), "rowid": pa.array(rowid), "raw": pa.array(distance)})

    return run


def _placed(found: DataFrame, n: int) -> DataFrame:
    """(qid, rowid, distance, place) of the n best of (qid, rowid, raw)."""
    cut = Window.partitionBy("qid").orderBy("raw", "rowid")
    found = found.withColumn("__r", F.row_number().over(cut)).filter(F.col("__r") <= n)
    found = found.withColumn("distance", F.col("raw").cast("float"))
    shown = Window.partitionBy("qid").orderBy("distance", "rowid")
    return found.select("qid", "rowid", "distance", (F.row_number().over(shown) - 1).alias("place"))


def knn_batch(records: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], n: int = DEFAULT_RESULTS, space: str = "l2", coarse: bool = False) -> DataFrame:
    """(qid, rowid, distance, place): the n nearest records of each stated query, places from 0.

    Queries are taken in blocks of QUERY_BLOCK; for a block each task scores its records as they
    stream by and passes n rows a query on, so nothing but those is shuffled.
    """
    check_space(space)
    records = records.select("rowid", "embedding").filter("embedding is not null")
    found = None
    for at in range(0, max(1, len(queries)), QUERY_BLOCK):
        block = [(int(q), np.asarray(v, dtype=np.float32)) for q, v in queries[at : at + QUERY_BLOCK]]
        width = len(block[0][1]) if block else 0
        if any(len(v) != width for _, v in block):
            raise InvalidArgument("queries differ in dimension")
        part = records.filter(F.size("embedding") == width).mapInArrow(_best(block, n, space, coarse), "qid long, rowid long, raw double")
        found = part if found is None else found.unionByName(part)
    return _placed(found, n)


def _blocks(space: str, n: int):
    def run(table: pa.Table) -> pa.Table:
        asks = table.column("role").to_numpy() == 1
        ids = table.column("rowid").to_numpy()
        width = table.column("width")[0].as_py()
        vectors = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        best = Best(vectors[asks], n, space)
        best.see(ids[~asks], vectors[~asks])
        q, rowid, distance = best.rows()
        return pa.table({"qid": pa.array(ids[asks][q]), "rowid": pa.array(rowid), "raw": pa.array(distance)})

    return run


def knn_join(
    records: DataFrame, queries: DataFrame, n: int = DEFAULT_RESULTS, space: str = "l2", query_block: int = 4_096, record_block: int = 65_536,
) -> DataFrame:
    """(qid, rowid, distance, place) as of knn_batch, for queries(qid, embedding) that are a table of any size.

    Both sides are dealt into blocks by hash, counted first, and each pair of blocks is one group of
    bounded size: a record is copied once for each block of queries, and the n best of the blocks are
    merged. Queries and records of different dimensions do not meet; null embeddings take no part; n best
    of repeated qids are those of one of them.
    """
    check_space(space)
    records = records.select("rowid", "embedding").filter("size(embedding) > 0 and rowid is not null")
    queries = queries.select(F.col("qid").alias("rowid"), "embedding").filter("size(embedding) > 0 and qid is not null").dropDuplicates(["rowid"])
    across, down = max(1, -(-records.count() // record_block)), max(1, -(-queries.count() // query_block))
    own = lambda k, seed: F.pmod(F.xxhash64(F.lit(seed), "rowid"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = queries.select("rowid", "embedding", own(down, 1).alias("i"), every(across).alias("j"), F.lit(1).alias("role"))
    held = records.select("rowid", "embedding", every(down).alias("i"), own(across, 2).alias("j"), F.lit(0).alias("role"))
    both = asked.unionByName(held).withColumn("width", F.size("embedding"))
    found = both.repartition(parallelism(records.sparkSession), "width", "i", "j").groupBy("width", "i", "j").applyInArrow(_blocks(space, n), "qid long, rowid long, raw double")
    return _placed(found, n)


def knn_two_stage(records: DataFrame, query: Sequence[float], n: int = DEFAULT_RESULTS, space: str = "l2") -> DataFrame:
    """Candidates by 16-bit vectors, max(4n, n + 40) of them, ranked anew in full precision; exact if those fall short."""
    coarse = knn_batch(records, [(0, query)], max(4 * n, n + 40), space, coarse=True)
    candidates = [r.rowid for r in coarse.select("rowid").collect()]  # at most max(4n, n + 40)
    if len(candidates) < n:
        return knn(records, query, n, space)
    return knn(records.filter(F.col("rowid").isin(*candidates)), query, n, space)


def _probed(queries: list[tuple[int, np.ndarray]], lists: list[set[int]], n: int, space: str):
    """The n best of each list of a partition for each query that asks for it: (qid, rowid, raw)."""
    asked: dict[int, list[int]] = {}
    for i, own in enumerate(lists):
        for c in own:
            asked.setdefault(c, []).append(i)
    ids = np.array([q for q, _ in queries], dtype=np.int64)
    matrix = np.stack([v for _, v in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}  # by list, over all queries that ask for it
        for batch in batches:
            if not batch.num_rows or not n:
                continue
            rowid, at = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for c in np.unique(at).tolist():
                if c in asked:
                    own = np.flatnonzero(at == c)
                    if c not in best:
                        best[c] = Best(matrix[asked[c]], n, space)
                    best[c].see(rowid[own], vectors[own])
        for c, found in best.items():
            q, rowid, distance = found.rows()
            yield pa.RecordBatch.from_pydict({"qid": pa.array(ids[np.array(asked[c])[q]]), "rowid": pa.array(rowid), "raw": pa.array(distance)})

    return run


def nearest_centre(centres: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    x, c = vectors.astype(np.float64), centres.astype(np.float64)
    with np.errstate(all="ignore"):
        return ((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)


@dataclass
class Ivf:
    """Inverted-file index: rows by their nearest centre, stored as a table that is partitioned by list.

    A search reads the nearest lists and, unless it is told not to, those that may hold nearer rows.
    Centres are fitted on at most `sample` rows (a documented bound); every row is indexed. radius and
    angle are, for each list, the largest distance and angle of its rows from the centre (-1 if it is empty): no row
    of a list is nearer to a query than the centre less that, so an exact search only leaves a list out when
    it cannot hold one of the n nearest. `probes` is the least number of lists that found 0.95 of the
    ten nearest of sample rows among the sample: what a search without further lists reads.
    """

    centres: np.ndarray
    path: str
    radius: np.ndarray
    angle: np.ndarray
    probes: int
    spark: SparkSession

    @property
    def indexed(self) -> DataFrame:
        return self.spark.read.schema("rowid long, embedding array<float>, list int").parquet(self.path)

    @classmethod
    def build(cls, records: DataFrame, lists: int = 64, sample: int = 20_000, rounds: int = 8, seed: int = 7, path: str | None = None) -> Ivf:
        """Fit and store the index: one job that fits, one that assigns and writes (to the shared folder where no path is given)."""
        spark = records.sparkSession
        rows = records.select("rowid", "embedding").filter("embedding is not null and rowid is not null and not exists(embedding, x -> isnan(x) or x is null)")
        taken = rows.orderBy(F.xxhash64(F.lit(seed), "rowid")).limit(sample).select("embedding").collect()
        data = np.array([r.embedding for r in taken], dtype=np.float32)
        lists = max(1, min(lists, len(data)))
        centres = data[:lists].copy() if len(data) else np.zeros((1, 1), np.float32)
        for _ in range(rounds if len(data) else 0):
            nearest = nearest_centre(centres, data)
            for c in range(lists):
                if (nearest == c).any():
                    centres[c] = data[nearest == c].mean(axis=0)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                found = nearest_centre(centres, vectors)
                x, c = vectors.astype(np.float64), centres[found].astype(np.float64)
                with np.errstate(all="ignore"):
                    gap = np.sqrt(((x - c) ** 2).sum(axis=1))
                    turn = np.arccos(np.clip((x * c).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (c * c).sum(axis=1)), -1, 1))
                turn = np.where(np.isnan(turn), np.pi, turn)  # a zero vector has no angle
                yield pa.RecordBatch.from_pydict({"rowid": batch.column(0), "embedding": batch.column(1), "list": pa.array(found.astype(np.int32)), "gap": pa.array(gap), "turn": pa.array(turn)})

        path = path or shared_folder(spark, "ivf")
        rows.mapInArrow(assign, "rowid long, embedding array<float>, list int, gap double, turn double").write.partitionBy("list").parquet(path)
        radius, angle = np.full(lists, -1.0), np.full(lists, -1.0)
        held = spark.read.schema("gap double, turn double, list int").parquet(path)
        for r in held.groupBy("list").agg(F.max("gap").alias("gap"), F.max("turn").alias("turn")).collect():  # one row a list
            radius[r.list], angle[r.list] = r.gap, r.turn
        return cls(centres, path, radius, angle, cls._fit_probes(centres, data), spark)

    @staticmethod
    def _fit_probes(centres: np.ndarray, data: np.ndarray, recall: float = 0.95, asked: int = 200, n: int = 10) -> int:
        """How many lists, nearest centre first, hold `recall` of the n nearest of sample rows among the sample."""
        if len(data) < 2:
            return 1
        best = Best(data[:asked], min(n + 1, len(data)), "l2")
        best.see(np.arange(len(data)), data)
        own = nearest_centre(centres, data)
        turn = np.argsort(np.argsort(block_distances(centres, data[:asked], "l2"), axis=1, kind="stable"), axis=1)
        q, row, _ = best.rows()
        needed = np.sort(turn[q, own[row]][q != row])
        return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1 if len(needed) else 1

    def bounds(self, query: np.ndarray, space: str) -> np.ndarray:
        """For each list, a distance below which none of its rows can be; infinite for an empty list."""
        q, c = query.astype(np.float64), self.centres.astype(np.float64)
        if space == "l2":
            least = np.maximum(0, np.sqrt(((c - q) ** 2).sum(axis=1)) - self.radius) ** 2
        elif space == "ip":
            least = 1 - (c @ q + np.sqrt(q @ q) * self.radius)
        else:
            with np.errstate(divide="ignore", invalid="ignore"):
                turn = np.arccos(np.clip(c @ q / np.sqrt((c * c).sum(axis=1) * (q @ q)), -1, 1)) - self.angle
            least = 1 - np.cos(np.maximum(0, np.where(np.isnan(turn), 0, turn) - 1e-6))
        return np.where(self.radius < 0, np.inf, least - 1e-9 * (1 + np.abs(least)))

    def search_batch(self, queries: Sequence[tuple[int, Sequence[float]]], n: int = DEFAULT_RESULTS, space: str = "l2", probes: int | None = None, exact: bool = True) -> DataFrame:
        """(qid, rowid, distance, place) as of knn_batch: `probes` lists of each query, and if exact then every list that may hold a nearer row."""
        check_space(space)
        probes = self.probes if probes is None else probes
        found = None
        for at in range(0, len(queries), QUERY_BLOCK):
            block = [(int(q), np.asarray(v, dtype=np.float32)) for q, v in queries[at : at + QUERY_BLOCK]]
            for _, v in block:
                check_query(v, self.centres.shape[1])
            distance = block_distances(self.centres, np.stack([v for _, v in block]), "l2")
            near = [set(d[:probes]) for d in np.argsort(distance, axis=1, kind="stable").tolist()]
            part = self._read(block, near, n, space)
            if exact and probes < len(self.centres):
                part = cut_lineage(part)
                worst = {r.qid: r.worst for r in part.groupBy("qid").agg(F.max("raw").alias("worst"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= n).collect()}  # at most QUERY_BLOCK
                # a NaN distance comes last: as an n-th one it leaves no list out
                far = [
                    {c for c, least in enumerate(self.bounds(v, space).tolist()) if c not in own and self.radius[c] >= 0 and not least > worst.get(q, np.inf)}
                    for (q, v), own in zip(block, near, strict=True)
                ]
                part = part.unionByName(self._read(block, far, n, space)) if any(far) else part
            found = part if found is None else found.unionByName(part)
        if found is None:
            found = self.spark.createDataFrame([], "qid long, rowid long, raw double")
        return _placed(found, n)

    def _read(self, block: list[tuple[int, np.ndarray]], lists: list[set[int]], n: int, space: str) -> DataFrame:
        wanted = sorted(set().union(*lists))
        part = self.indexed.filter(F.col("list").isin(*wanted)) if wanted else self.indexed.limit(0)  # prunes the folders
        found = part.mapInArrow(_probed(block, lists, n, space), "qid long, rowid long, raw double")
        cut = Window.partitionBy("qid").orderBy("raw", "rowid")
        return found.withColumn("__r", F.row_number().over(cut)).filter(F.col("__r") <= n).drop("__r")

    def search(self, query: Sequence[float], n: int = DEFAULT_RESULTS, space: str = "l2", probes: int | None = None, exact: bool = True) -> DataFrame:
        """(rowid, distance) of one query, in order; see search_batch()."""
        return self.search_batch([(0, query)], n, space, probes, exact).select("rowid", "distance").orderBy("distance", "rowid")
