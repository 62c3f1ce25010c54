"""Shared plumbing: work folder, stable row ids, size-checked joins, distributed prefix sums."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of two longs that may be broadcast; beyond this a shuffled join is used.
BROADCAST_ROWS = 300_000
#: Rows and bytes of an Arrow batch sent to Python: bound a worker's memory for long texts.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
UID = "_row_uid"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Made where a local session names no shared folder.
_local: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only where the session names none (local tests) is one made."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="meridion-")
        place = _local[app]
    return place.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows as Parquet in the shared folder and read them again."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/meridion/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.work_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a work table once all that was made of it is written."""
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
    path = hadoop.Path(df.work_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python a few at a time: a batch ends at so many rows or bytes, whichever comes first."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: What Python workers keep from one task for the next of the same operator.
_worker_caches: list[dict] = []


def worker_cache(cache: dict) -> dict:
    _worker_caches.append(cache)
    return cache


def release() -> None:
    """At the start of a task: drops what another operator left in this worker, and gives the memory back.

    Workers serve all operators of a session in turn, and their memory counts beside the executor's.
    """
    if any(_worker_caches):
        _trim()


def _trim() -> None:
    for cache in _worker_caches:
        cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries keep it
        ctypes.CDLL(None).malloc_trim(0)


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _trim()
    yield from batches


def give_back(spark: SparkSession) -> None:
    """Between two stages of a session: executors return to the system what the last one left in heaps and workers.

    A heap stays as large as a stage made it, and the Python workers of the next stage count beside it.  A full collection
    shrinks it to what is in use.  There is a task for each core, so that every executor with a free core takes part.
    """
    n = spark.sparkContext.defaultParallelism
    collected = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(collected.alias("collected")).mapInArrow(_trimmed, "collected string").collect()


#: Nodes that leave the rows of a file scan where they are.
_SCANS = {"LogicalRelation", "Project", "Filter", "SubqueryAlias"}


def stable(df: DataFrame) -> DataFrame:
    """A DataFrame whose rows come in the same order in the same partitions each time they are computed.

    Row ids count rows, so joining on them is sound only then.  Scans of files are so; anything else (a shuffle may
    deliver its rows in another order after an executor is lost) is written once.
    """
    plan = df._jdf.queryExecution().analyzed()
    todo, scan = [plan], bool(plan.deterministic())
    while todo:
        node = todo.pop()
        scan = scan and node.nodeName() in _SCANS
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return df if scan else materialise(plain(df), "input").toDF(*df.columns)


def plain(df: DataFrame) -> DataFrame:
    """Columns by position (c0, c1, ...), so that no name of the input can clash with an operator's own."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def numbered(df: DataFrame) -> DataFrame:
    """The columns by position, and a row id; `df` must be stable."""
    return plain(df).withColumn(UID, F.monotonically_increasing_id())


def fields(df: DataFrame, **types: str) -> DataFrame:
    """The row id and the named columns alone, cast; of columns whose names differ in case the exact name counts."""
    at = {n: df.columns.index(n) for n in types}
    return numbered(df).select(UID, *[F.col(f"c{at[n]}").cast(t).alias(n) for n, t in types.items()])


def whole_rows(rows: DataFrame, df: DataFrame) -> DataFrame:
    """Rows by position in the columns of `df` again."""
    return rows.select(*[F.col(f"c{i}") for i in range(len(df.columns))]).toDF(*df.columns)


def rows_without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a stable `df`, in its own columns, whose id isn't in `gone`."""
    return whole_rows(join_small(numbered(df), gone, UID, "left_anti"), df)


def doc_order(col: str = "doc_id") -> Column:
    """doc_id as an order without nulls: a null id comes after every other id."""
    return F.coalesce(F.col(col).cast("long"), F.lit((1 << 63) - 1))


def join_small(left: DataFrame, right: DataFrame, on, how: str, rows: int | None = None) -> DataFrame:
    """Join; the right side (a few narrow columns) is broadcast only if its counted rows are within bounds."""
    n = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if n <= BROADCAST_ROWS else right, on, how)


def hash_buckets(rows: int) -> int:
    """A power of two of key ranges that grows with the square root of the rows, 1024 at least."""
    return 1 << max(10, math.ceil(math.log2(max(1.0, math.sqrt(rows)))) + 2)


def prefix_sums(df: DataFrame, group: list[str], key: str, value: str, rows: int, out: str = "before") -> DataFrame:
    """Adds the sum of `value` over the rows of the same group with a smaller `key`.

    `key` is 16 hex digits or more, evenly spread (a digest) and unique.  Its leading digits are the
    range of a row, so ranges are even without sampling and a group never meets in one task: each range
    is summed alone, and only the totals of ranges are summed along a group.
    """
    n = hash_buckets(rows)
    bits = int(math.log2(n))
    bucket = F.shiftright(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), 32 - bits)
    df = df.withColumn("_range", bucket)
    by = [F.col(g) for g in group]
    totals = df.groupBy(*by, "_range").agg(F.sum(value).alias("_t"))
    w = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*by, "_range", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    part = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    a, b = part.alias("a"), base.alias("b")
    same = F.col("a._range") == F.col("b._range")
    for g in group:
        same = same & F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    return a.join(b, same).select(
        *[F.col(f"a.{c}") for c in df.columns if c != "_range"], (F.col("a._in") + F.col("b._base")).alias(out)
    )


def clear(spark: SparkSession) -> None:
    """Deletes the work tables of finished queries; to be called once their results are written."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{work_folder(spark)}/meridion")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
