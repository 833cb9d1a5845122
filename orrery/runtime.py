"""Session helpers shared by all operators: tables, lineage cuts, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the narrow side of a join may be broadcast. The bound is proven by a count.
BROADCAST_ROWS = 50_000


def session(app: str = "orrery", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, use the one given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a session; needed where they cannot import it by themselves."""
    context = spark.sparkContext
    if getattr(context, "_orrery_shipped", False):
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="orrery-")) / "orrery.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._orrery_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in spark.checkpoint.dir; make one only where none is named."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="orrery-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder, for a written table or a catalog."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than it must to know."""
    return df.limit(rows + 1).count() <= rows


def parallelism(spark: SparkSession) -> int:
    """Tasks to make of CPU-heavy work on little data, which size-based coalescing would put into a few."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def join_small(
    left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner",
    max_rows: int = BROADCAST_ROWS, salts: int | None = None,
) -> DataFrame:
    """Join a large, skewed left side with a narrow right side whose keys are unique.

    Up to max_rows (counted, not estimated) the right side is broadcast. Beyond that both sides
    are shuffled on the key and a salt drawn from the spread columns, so that a key holding a
    third of the left side is shared by `salts` tasks: by default half as many as the shuffle has, a number
    that is set with the data's size; adaptive execution splits what is still too large on the left side.
    Null keys match nothing. how: inner or left.
    """
    salts = salts or max(16, parallelism(left.sparkSession) // 2)
    if at_most(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    salt = "__salt"
    salted = left.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*on, salt], how).drop(salt)
