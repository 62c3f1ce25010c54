"""Streams of ticks and bars: windowed bars, late corrections, sessions, ring buffers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files: int | None = 1) -> DataFrame:
    """`files` in a micro-batch, or all that are there."""
    schema = "event_id long, user_id long, ts timestamp, event_type string, value double, props string"
    reader = spark.readStream.schema(schema)
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    folder, _, name = path.rpartition("/")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)


def tumbling_bars(events: DataFrame, width: str = "7 days", offset: str | None = None, late: str = "2 days") -> DataFrame:
    """Open, high, low, close and volume of each window; a window is final once the watermark passes it."""
    at = F.struct("ts", "event_id")
    span = F.window("ts", width, width, offset) if offset else F.window("ts", width)
    bars = events.withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").alias("volume"))
    return bars.select(F.col("event_type").alias("symbol"), F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def sliding_counts(events: DataFrame, width: str = "3 days", step: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")


def active_spans(events: DataFrame, gap: str = "12 hours", late: str = "2 days") -> DataFrame:
    """Runs of a user's events with no gap longer than `gap`."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def moving_average(events: DataFrame, path: str, checkpoint: str, k: int = 5) -> DataFrame:
    """Mean of each series' last k values, null where one of them is missing.

    A micro-batch is put in the order of (ts, event_id) as a whole, and starts from the last k - 1 rows of each series,
    which the batch before it left in `path`.  A batch that is run again replaces what it wrote.
    """
    spark = events.sparkSession

    def update(batch: DataFrame, number: int) -> None:
        rows = batch.select("event_type", "event_id", "ts", "value", F.lit(0).alias("seen"))
        if number:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/held/{number - 1}"))
        _ring(rows, f"{path}/ranges/{number}", f"{path}/means/{number}", f"{path}/held/{number}", k)

    q = events.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = "event_type string, event_id long, ts timestamp, mean double"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/means")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/means")


def _ring(rows: DataFrame, ranges: str, means: str, held: str, k: int) -> None:
    """Writes the means of new rows (`seen` is 0), and the last k - 1 rows of each series (`seen` counts back from -1).

    Rows are dealt to ranges of a series' order, so many tasks share a long series; a range starts from the k - 1 rows of
    its series before it, which are found among the last rows of all ranges.
    """
    order = [F.col("seen"), F.asc_nulls_last("ts"), F.asc_nulls_last("event_id")]
    back = [F.desc("seen"), F.desc_nulls_first("ts"), F.desc_nulls_first("event_id")]
    # Written, as the ranges must not change from one reading to the next.
    rows.repartitionByRange("event_type", *order).withColumn("range", F.spark_partition_id()).write.mode("overwrite").parquet(ranges)
    dealt = rows.sparkSession.read.parquet(ranges).withColumn("lead", F.lit(False))
    inside = Window.partitionBy("event_type", "range")
    lasts = dealt.withColumn("nth", F.row_number().over(inside.orderBy(*back))).filter(F.col("nth") < k)
    along = Window.partitionBy("event_type").orderBy("range", F.desc("nth"))
    row = F.struct("event_id", "ts", "value", "seen")
    first = lasts.withColumn("top", F.max("nth").over(inside)).withColumn("before", F.array(*[F.lag(row, i).over(along) for i in range(1, max(2, k))])).filter("nth = top")
    leads = first.select("event_type", "range", F.explode(F.filter("before", lambda x: x.isNotNull())).alias("r")).select("event_type", "range", "r.*", F.lit(True).alias("lead"))
    count = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("range"), "nth"))
    lasts.withColumn("count", count).filter(F.col("count") < k).select("event_type", "event_id", "ts", "value", (-F.col("count")).alias("seen")).write.mode("overwrite").parquet(held)
    ring = inside.orderBy(F.desc("lead"), *order).rowsBetween(1 - k, 0)
    mean = F.when(F.count("value").over(ring) == k, F.avg("value").over(ring))
    dealt.unionByName(leads).withColumn("mean", mean).filter("NOT lead AND seen = 0").select("event_type", "event_id", "ts", "mean").write.mode("overwrite").parquet(means)


def upsert(batch: DataFrame, path: str) -> None:
    """foreachBatch sink: the newest version of each symbol and session replaces what is stored.

    Each batch writes a new version beside the old one, named by the batch, so a failed batch leaves the
    old version whole; `latest` reads the last one finished.
    """
    from meridion.operators.ingest import merge

    spark = batch.sparkSession
    number, old = latest(spark, path)
    new = batch if old is None else merge(old, batch)
    new.write.mode("overwrite").parquet(f"{path}/v={number + 1}")


def latest(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """(number, table) of the last finished version."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [int(s.getPath().getName()[2:]) for s in (fs.listStatus(place) if fs.exists(place) else []) if s.getPath().getName().startswith("v=") and fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))]
    return (max(done), spark.read.parquet(f"{path}/v={max(done)}")) if done else (0, None)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns its rows."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
