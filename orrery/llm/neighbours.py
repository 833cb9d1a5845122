"""The k nearest vectors of every vector, by a block matrix join with int8 product tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.runtime import join_small, parallelism

#: Vectors of one collection that a strip holds as rows and as columns; both bound a task's memory.
ROW_BLOCK, COLUMN_BLOCK = 32_768, 131_072
#: Rows and columns of one product tile (the columns grow up to this).
TILE_ROWS, TILE_COLUMNS = 2_048, 4_096
SCHEMA = "rowid long, neighbour long, distance double"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes q and scales s with x ~ s * q, and the exact length of each x - s * q."""
    top = np.abs(x).max(axis=1, initial=0)
    scale = np.where(top > 0, top / 127, 1.0)
    codes = np.rint(x / scale[:, None])
    rest = x - codes * scale[:, None]
    return codes.astype(np.int8), scale, np.sqrt((rest * rest).sum(axis=1))


def exact(space: str, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Distances of the paired rows of a and b in double precision; na, nb are their squared lengths."""
    if space == "l2":
        d = a - b
        return (d * d).sum(axis=1)
    dot = (a * b).sum(axis=1)
    return 1 - dot if space == "ip" else 1 - dot / (np.sqrt(na) * np.sqrt(nb))


class Side:
    """Vectors of one side of a strip: doubles for exact distances, int8 codes for the tiles."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, space: str):
        self.ids, self.raw = ids, vectors
        x = vectors.astype(np.float64)
        with np.errstate(over="ignore"):
            self.squared = (x * x).sum(axis=1)
        if space == "cosine":
            x /= np.sqrt(self.squared)[:, None]
        self.codes, self.scale, self.rest = quantise(x)
        self.length = np.sqrt((x * x).sum(axis=1))

    def tile(self, at: slice) -> np.ndarray:
        """The codes as floats, for matrix products of which every partial sum is a whole number."""
        return self.codes[at].astype(np.float32)

    def ask(self, space: str, at: slice, worst: np.ndarray) -> np.ndarray:
        """Factors whose product with offer() bounds a product of codes from below, for pairs that may be among a row's k best.

        Rows, of codes q, scale s, rest e and length n, ask with the k-th distance w so far. Since
        |x.y - sx sy qx.qy| <= (nx + ex) ey + ex ny, a pair is only near if qx.qy is at least
        (nx^2 + ny^2 - w) / (2 sx sy) - ((nx + ex) ey + ex ny) / (sx sy) for l2, and
        (1 - w) / (sx sy) - the same for the others. Lengths are taken a little too small (l2), errors too large.
        """
        n, e, s = self.length[at], self.rest[at], self.scale[at]
        less, more = 1 - 1e-10, 1 + 1e-10
        if space == "l2":
            own, other = (n * n * less - worst) / (2 * s), 1 / (2 * s)
        else:
            own, other = (1 - worst - 1e-10 * (1 + n)) / s, np.zeros(len(n))
        return np.column_stack([own, other, -(n + e) * more / s, -(e + 1e-12 * n) * more / s])

    def offer(self, at: slice) -> np.ndarray:
        n, e, s = self.length[at], self.rest[at], self.scale[at]
        return np.column_stack([1 / s, n * n * (1 - 1e-10) / s, e / s, n / s])


def least(ask: np.ndarray, offer: np.ndarray) -> np.ndarray:
    """ask @ offer.T, not above it: in single precision where nothing overflows, less what its roundings may add."""
    with np.errstate(over="ignore", invalid="ignore"):
        bounded = np.abs(np.where(np.isfinite(ask), ask, 0)).max(initial=0) * np.abs(offer).max(initial=0) < 1e37 and np.isfinite(offer).all()
        if not bounded:
            return (ask - 1e-12 * np.abs(ask)) @ offer.T
        # four products and three sums of numbers rounded once: less than 16 roundings of 2^-24
        return (ask - 16 * 2.0**-24 * np.abs(ask)).astype(np.float32) @ offer.astype(np.float32).T


def products(left: np.ndarray, right: np.ndarray, span: int = 1024) -> tuple[np.ndarray, float]:
    """(left @ right.T, slack): sums of products of codes, and how much they may be too small.

    Up to `span` dimensions every partial sum is a whole number below 2^24, hence exact. Sums of several
    such parts are rounded once a part, by at most 2^-24 of the largest sum that the dimensions allow.
    """
    d = left.shape[1]
    total = left[:, :span] @ right[:, :span].T
    for at in range(span, d, span):
        total += left[:, at : at + span] @ right[:, at : at + span].T
    return total, max(0, -(-d // span) - 1) * 2.0**-24 * 127 * 127 * d


class Heaps:
    """The k best (distance, id) of each row so far."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.distance = np.full((rows, k), np.inf)
        self.id = np.full((rows, k), np.iinfo(np.int64).max)

    def worst(self) -> np.ndarray:
        return self.distance[:, -1]

    def push(self, row: np.ndarray, distance: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        touched = np.unique(row)
        rows = np.concatenate([row, np.repeat(touched, self.k)])
        distances = np.concatenate([distance, self.distance[touched].ravel()])
        names = np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((names, distances, rows))
        rows, distances, names = rows[order], distances[order], names[order]
        start = np.searchsorted(rows, touched)
        at = (start[:, None] + np.arange(self.k)).ravel()
        self.distance[touched] = distances[at].reshape(-1, self.k)
        self.id[touched] = names[at].reshape(-1, self.k)


def few(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a mask with few marks, looking at eight places at a time."""
    flat = mask.ravel()
    whole = len(flat) - len(flat) % 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    at = np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])
    return at // mask.shape[1], at % mask.shape[1]


def strip(space: str, k: int, rows: Side, columns: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, neighbour id, distance) of the k nearest columns of each row, a row not being its own neighbour.

    A tile is the product of int8 codes, held in floats and not scaled, so that it is exact up to 1,024
    dimensions and has a proven slack beyond (see products()). A pair is dropped if its product is below
    the least that one of the row's k best could have (see Side.ask()); the others are recomputed from the
    stored floats in double precision and go into the row's heap. Comparisons are made so that NaN and
    overflow survive.
    """
    many = len(rows.ids)
    best = [Heaps(min(TILE_ROWS, many - a), k) for a in range(0, many, TILE_ROWS)]
    at, width = 0, 128
    while at < len(columns.ids):
        span = slice(at, at + width)
        with np.errstate(over="ignore", invalid="ignore"):
            right, offer = columns.tile(span), columns.offer(span)
        for t, heaps in enumerate(best):
            own = slice(t * TILE_ROWS, t * TILE_ROWS + len(heaps.distance))
            with np.errstate(over="ignore", invalid="ignore"):
                tile, slack = products(rows.tile(own), right)
                i, j = few(~(tile < least(rows.ask(space, own, heaps.worst()), offer) - np.float32(slack)))
            keep = rows.ids[own.start + i] != columns.ids[at + j]
            i, j = i[keep], j[keep]
            for part in range(0, len(i), 200_000):
                a, b = i[part : part + 200_000] + own.start, j[part : part + 200_000] + at
                with np.errstate(over="ignore", invalid="ignore"):
                    d = exact(space, rows.raw[a].astype(np.float64), columns.raw[b].astype(np.float64), rows.squared[a], columns.squared[b])
                better = d <= heaps.worst()[a - own.start]
                heaps.push(a[better] - own.start, d[better], columns.ids[b[better]])
        at, width = at + width, min(2 * width, TILE_COLUMNS)
    distance = np.concatenate([h.distance for h in best]) if best else np.empty((0, k))
    name = np.concatenate([h.id for h in best]) if best else np.empty((0, k), np.int64)
    row, place = np.nonzero(name != np.iinfo(np.int64).max)
    return row, name[row, place], distance[row, place]


def usable(table: pa.Table, dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, roles and vectors of the rows that are all finite and not all zero, one of each id and role; lengths are checked before."""
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    vectors = np.asarray(flat, dtype=np.float32).reshape(-1, dimension)
    good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
    ids, role, vectors = table.column("rowid").to_numpy()[good], table.column("role").to_numpy()[good], vectors[good]
    if len(np.unique(ids * 3 + role)) < len(ids):
        # least vector first, so that of repeated ids the same row counts in every strip
        order = np.lexsort((*vectors.T[::-1], role, ids))
        ids, role, vectors = ids[order], role[order], vectors[order]
        first = np.concatenate([[True], (ids[1:] != ids[:-1]) | (role[1:] != role[:-1])])
        ids, role, vectors = ids[first], role[first], vectors[first]
    return ids, role, vectors


def _strip_of(k: int):
    def run(table: pa.Table) -> pa.Table:
        space, dimension = table.column("space")[0].as_py(), table.column("dimension")[0].as_py()
        ids, role, vectors = usable(table, dimension)
        rows, columns = role != 2, role != 1
        row, name, distance = strip(space, k, Side(ids[rows], vectors[rows], space), Side(ids[columns], vectors[columns], space))
        return pa.table({"rowid": ids[rows][row], "neighbour": name, "distance": distance})

    return run


def nearest(
    records: DataFrame, collections: DataFrame, k: int = 5, row_block: int = ROW_BLOCK, column_block: int = COLUMN_BLOCK,
) -> DataFrame:
    """(rowid, neighbour, distance): the k nearest records of every record, within its collection.

    records(rowid, collection_id, embedding), rowid unique; collections(collection_id, dimension,
    space). Only embeddings that are not null, exactly `dimension` long, finite and not all zero take
    part; a record is not its own neighbour; equal distances go by the lower rowid; with k or fewer
    others, all are neighbours. Records without a collection, or of one with an unknown space or a
    dimension below 1, are left out; of repeated rows with one rowid one counts. Empty tables give an
    empty result. The result is exact: the quantisation only decides which pairs are computed in full.

    Rows of a collection are dealt into row blocks and column blocks by hash; each pair of blocks (a
    strip) is one group of bounded size, so a collection holding a third of all rows is many tasks.
    Small collections are one strip and are shipped once. The heaps of the strips of one row block,
    k entries a row, are merged by a window.
    """
    spark = records.sparkSession
    counts = records.filter("embedding is not null").groupBy("collection_id").agg(F.count(F.lit(1)).alias("n"))
    plan = (
        collections.select("collection_id", "dimension", "space")
        .filter("dimension > 0 and space in ('l2', 'ip', 'cosine')")
        .dropDuplicates(["collection_id"])
        .join(counts, "collection_id")
        .withColumns({"nr": F.ceil(F.col("n") / row_block).cast("int"), "nc": F.ceil(F.col("n") / column_block).cast("int")})
        .drop("n")
    )
    rows = join_small(records.select("rowid", "collection_id", "embedding").filter("embedding is not null and rowid is not null"), plan, ["collection_id"], ["rowid"])
    rows = rows.filter(F.size("embedding") == F.col("dimension"))
    own_row, own_column = F.pmod(F.xxhash64("rowid"), "nr").cast("int"), F.pmod(F.xxhash64(F.lit(7), "rowid"), "nc").cast("int")
    # role 0: row and column of the only strip; 1: row; 2: column
    as_row = F.transform(F.sequence(F.lit(0), F.col("nc") - 1), lambda c: F.struct(own_row.alias("i"), c.alias("c"), F.lit(1).alias("role")))
    as_column = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda i: F.struct(i.alias("i"), own_column.alias("c"), F.lit(2).alias("role")))
    both = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("c"), F.lit(0).alias("role")))
    place = F.explode(F.when((F.col("nr") == 1) & (F.col("nc") == 1), both).otherwise(F.concat(as_row, as_column)))
    rows = rows.select("rowid", "embedding", "collection_id", "dimension", "space", "nc", place.alias("at")).select("*", "at.*").drop("at")
    # several tasks a core, since strips differ in size
    rows = rows.repartition(max(parallelism(spark), 3 * spark.sparkContext.defaultParallelism), "collection_id", "i", "c")
    found = rows.groupBy("collection_id", "i", "c").applyInArrow(_strip_of(k), SCHEMA)
    if spark_max(plan, "nc") > 1:
        order = Window.partitionBy("rowid").orderBy("distance", "neighbour")
        found = found.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).drop("__r")
    return found


def spark_max(df: DataFrame, column: str) -> int:
    return df.agg(F.max(column)).first()[0] or 0


def similar_pairs(records: DataFrame, collections: DataFrame, k: int = 5, **blocks) -> DataFrame:
    """(rowid_a, rowid_b), a < b: pairs of which at least one is among the k nearest of the other. See nearest()."""
    found = nearest(records, collections, k, **blocks)
    return found.select(F.least("rowid", "neighbour").alias("rowid_a"), F.greatest("rowid", "neighbour").alias("rowid_b")).distinct()
