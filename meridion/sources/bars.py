"""Bar series: the engine's input table (symbol, session_date, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridion.work import kept

BARS = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("session_date", T.DateType()),
    *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")],
])
PRICES = ("open", "high", "low", "close")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number(x: Column) -> Column:
    """Double, with unreadable, NaN and infinite values as null."""
    x = x.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities become null at the scan, so that no aggregate has to know of them."""
    return df.select(*[number(F.col(c)).alias(c) if c in (*PRICES, "volume") else F.col(c) for c in df.columns])


def bars_of(rows: DataFrame, symbol: Column, day: Column, price: Column, volume: Column, order: list) -> DataFrame:
    """Open, high, low, close and volume of each symbol and session; `order` must be total."""
    at = F.struct(*order)
    return (
        rows.select(symbol.cast("string").alias("symbol"), day.cast("date").alias("session_date"), price.alias("p"), volume.cast("double").alias("v"), at.alias("at"))
        .groupBy("symbol", "session_date")
        .agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.sum("v").alias("volume"))
    )


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def _stored(spark: SparkSession, name: str, rows: DataFrame, *bars: object) -> DataFrame:
    """Bars of a big table are a small one: a session writes them once, and its queries start from there."""
    return kept(spark, name, [rows], lambda: bars_of(rows, *bars).repartition("symbol").sortWithinPartitions("symbol", "session_date"))


def brand_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of a part's brand; the part table is a dimension and joins on its key."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return _stored(spark, "brand_weeks", rows, F.col("p_brand"), F.date_trunc("week", "l_shipdate"), F.col("l_extendedprice"), F.col("l_quantity"), [F.col(c) for c in LINE_ORDER])


def nation_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of a supplier's nation: long series with missing sessions."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return _stored(spark, "nation_days", rows, F.col("s_nationkey"), F.to_date("l_shipdate"), F.col("l_extendedprice"), F.col("l_quantity"), [F.col(c) for c in LINE_ORDER])


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of an event type."""
    e = table(spark, sf_dir, "events")
    return _stored(spark, "event_days", e, F.col("event_type"), F.to_date("ts"), F.col("value"), F.lit(1.0), [F.col("ts"), F.col("event_id")])


def read_bars(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Bars from Parquet with column pruning; columns that the files lack come back as null."""
    df = spark.read.parquet(path)
    wanted = columns or ["symbol", "session_date", *PRICES, "volume"]
    got = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in wanted])
    return clean(got)


def normalise(df: DataFrame, order: str = "ingested_at") -> DataFrame:
    """One row a symbol and session: the one ingested last."""
    rest = [c for c in df.columns if c not in ("symbol", "session_date")]
    last = df.groupBy("symbol", "session_date").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return last.select("symbol", "session_date", *[F.col(f"r.{c}").alias(c) for c in rest])


def write_bars(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by year, so that a rebuild of recent sessions rewrites recent files only."""
    year = F.year("session_date")
    out = df.withColumn("year", year).repartition("year", "symbol").sortWithinPartitions("symbol", "session_date")
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
