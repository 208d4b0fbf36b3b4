"""Scratch tables in the shared folder, connected components, small helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
"""Bytes of a batch that goes to a Python worker."""
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SMALL_ROWS = 1 << 16
"""Rows of ids (16 bytes each) up to which a table is worked on in one task."""
_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``.

    Where a local session names no such folder, as in tests, a temporary one is set, as
    the driver and the executors are then one machine; a cluster has to name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(remove, None, base)
    if base not in _made:
        _made[base] = f"{base.rstrip('/')}/barloom-{uuid.uuid4().hex}"
    return _made[base]


def scratch(spark: SparkSession, name: str) -> str:
    """A path that nothing has used yet, in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Have Spark delete the shuffles of each query that runs within as the query ends, not when the driver happens to collect its plan."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, and the shuffles behind it are deleted."""
    path = scratch(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._barloom_path = path
    return kept


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of ``BATCH_BYTES`` or so (a longer row is one), so that memory doesn't follow the length of texts.

    The limit is the session's; one that it has set itself stays.
    """
    spark = df.sparkSession
    if spark.conf.get(_BATCH_LIMIT, None) is None:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))

    def bounded(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(bounded, schema)


def release() -> None:
    """Give what a task has freed back to the system, as its worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def gathered(kept: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A table of :func:`keep` as one partition, if it has at most ``rows`` rows: later steps on it then need no shuffle. Larger ones stay as they are."""
    return kept.coalesce(1) if kept.count() <= rows else kept


def discard(spark: SparkSession, *kept: DataFrame) -> None:
    """Delete tables of :func:`keep` that no later step reads, and ask for a collection.

    Shuffles of counts and other actions go only once the driver has collected their plans; those behind :func:`keep` are gone already.
    """
    for df in kept:
        remove(spark, df._barloom_path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession | None, path: str) -> None:
    """Delete a folder through Hadoop's file system, or a local one without a session."""
    if spark is None:
        import shutil

        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a folder, and the folder's path there."""
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def attempt() -> str:
    """A name of this task attempt's own: a retried, speculative or lost attempt never touches another's files."""
    return f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns(df: DataFrame, **casts: str) -> DataFrame:
    """The named columns and no others, cast, so that extra columns can't clash."""
    return df.select(*[F.col(f"`{k}`").cast(v).alias(k) for k, v in casts.items()])


def components(edges: DataFrame) -> DataFrame:
    """Smallest id reachable over ``edges`` (a, b: long) for every id in them.

    Rows ``(id, component)``; self-loops alone give no row.  Each round keeps
    one parent per child (its smallest), links the other parents to that one,
    and replaces each parent by its own parent; so depths halve.  The smallest
    parent is an aggregate, combined before its shuffle, and hubs are only ever
    join keys, where Spark can split them.  The rounds go on until nothing moves.
    Few edges, by a count, are worked on in one task without shuffles.
    """
    tree = keep(edges.select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("p")).where("c != p").distinct().withColumn("moved", F.lit(False)), "edges")
    tree = gathered(tree)
    while True:
        ranked = tree.join(tree.groupBy("c").agg(F.min("p").alias("top")), "c")
        linked = ranked.select(
            F.inline(
                F.when(
                    F.col("p") == F.col("top"),
                    F.array(F.struct("c", "p", F.lit(True).alias("tree"), "moved")),
                ).otherwise(F.array(F.struct(F.col("p").alias("c"), F.col("top").alias("p"), F.lit(False).alias("tree"), F.lit(True).alias("moved"))))
            )
        )
        kept = keep(linked, "components")
        if not kept.where("moved").limit(1).count() and not _deep(kept):
            return kept.select(F.col("c").alias("id"), F.col("p").alias("component")).unionByName(
                kept.select(F.col("p").alias("id"), F.col("p").alias("component")).distinct()
            )
        up = kept.where("tree").select(F.col("c").alias("p"), F.col("p").alias("above"))
        tree = kept.join(up, "p", "left").select("c", F.coalesce("above", "p").alias("p"), F.col("above").isNotNull().alias("moved"))
        tree = tree.groupBy("c", "p").agg(F.max("moved").alias("moved"))


def _deep(kept: DataFrame) -> bool:
    """Whether some parent has a parent."""
    return bool(kept.join(kept.select(F.col("c").alias("p")), "p", "left_semi").limit(1).count())
