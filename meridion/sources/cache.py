"""A cache of bars kept up to date from a vendor: resolve, fetch what is missing, merge, check, report.

Bars and metadata are written beside the ones in use and take their place by a pointer, so that a broken run leaves the
old ones; readers follow the pointer.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.operators import ingest, quality
from meridion.sources import files
from meridion.sources.bars import BARS
from meridion.sources.settings import Series, Settings

SCHEMA_VERSION = "1"
META = "symbol string, series_kind string, exchange string, tradingsymbol string, session_end string, lag_sessions int, has_volume boolean, continuous boolean, rows long, first date, last date, schema_version string, corporate_action_suspects array<struct<session_date:date,prev_close:double,close:double,ratio:double,nearest_split:double,move_pct:double,volume_consistent:boolean,confidence:string>>"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _current(spark: SparkSession, root: str, name: str) -> str | None:
    p, fs = _fs(spark, f"{root}/{name}.current")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return stream.readLine()
    finally:
        stream.close()


def _publish(spark: SparkSession, df: DataFrame, root: str, name: str, compression: str) -> DataFrame:
    """Writes a version and points at it; the version before the last one goes."""
    old = _current(spark, root, name)
    folder = f"{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(f"{root}/{folder}")
    p, fs = _fs(spark, f"{root}/{name}.current")
    stream = fs.create(p, True)
    stream.writeBytes(folder)
    stream.close()
    if old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{old}"), True)
    return spark.read.schema(df.schema).parquet(f"{root}/{folder}")


def stored_bars(spark: SparkSession, root: str) -> DataFrame:
    folder = _current(spark, root, "bars")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in BARS)}, d_roll tinyint"
    return spark.createDataFrame([], schema) if folder is None else spark.read.schema(schema).parquet(f"{root}/{folder}")


def stored_meta(spark: SparkSession, root: str) -> DataFrame:
    folder = _current(spark, root, "meta")
    return spark.createDataFrame([], META) if folder is None else spark.read.schema(META).parquet(f"{root}/{folder}")


def update(spark: SparkSession, settings: Settings, symbols: list[str], outside: list[Series], master: files.InstrumentMaster, fetcher: str, start: datetime.date, end: datetime.date, now: str, overrides: DataFrame | None = None, strict: bool = True, force: bool = False, only_stale: bool = False, rolls: DataFrame | None = None, progress: Callable[[str], None] = lambda m: None, **options) -> DataFrame:
    """Brings the cache up to `end` and returns the coverage report, a row a series.

    Outside series come first: a contract that can't be resolved stops the run (`strict`), as a panel without it is
    another panel.  Symbols that the master doesn't know are logged with close names and left out.  No series is fetched
    beyond its last completed session at `now`.  A series whose merged bars show an unadjusted split is fetched whole
    again.  `force` fetches all series whole; `only_stale` passes over those that have reached the end.
    """
    from meridion.functions.scalars import checked_range

    root = settings.root
    start, end, notes = checked_range(start, end, datetime.date.fromisoformat(now[:10]))
    for n in notes:
        progress(n)
    start = min(start, settings.history_anchor) if settings.history_anchor else start
    work = list(_resolved(outside, master, now, strict, progress))
    wanted = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    listed = master.exchanges("NSE", "BSE")
    found = ingest.resolve_symbols(wanted, listed, overrides)
    gone = ingest.unresolved(found, listed).withColumn("at", F.lit(now))
    if lost := [r.symbol for r in gone.collect()]:
        files.append_log(gone, f"{root}/unresolved")
        progress(f"unresolved: {', '.join(sorted(lost))}")
    work += [Series(r.symbol, tradingsymbol=r.symbol) for r in found.filter("instrument_token IS NOT NULL").collect()]
    series = spark.createDataFrame([(s.name, s.kind, s.exchange, s.tradingsymbol or s.name, s.session_end, s.lag_sessions, s.has_volume, s.continuous) for s in work], "symbol string, series_kind string, exchange string, tradingsymbol string, session_end string, lag_sessions int, has_volume boolean, continuous boolean")
    bars = stored_bars(spark, root)
    spans = bars.groupBy("symbol").agg(F.min("session_date").alias("first"), F.max("session_date").alias("last"))
    ends = {e: _closed(spark, now, e, settings) for e in {s.session_end for s in work}}
    last = F.create_map(*[x for e, d in ends.items() for x in (F.lit(e), F.lit(min(d, end)))])[F.col("session_end")] if ends else F.lit(end)
    plan = series.join(spans, "symbol", "left").withColumn("end", last)
    plan = plan.withColumns({c: F.lit(None).cast("date") for c in ("first", "last")}) if force else plan
    ranges = ingest.fetch_plan(plan, start, end, settings.refetch_tail_days, only_stale)
    told = dict(rate=settings.calls_per_second, tasks=settings.tasks, without_volume=",".join(s.name for s in work if not s.has_volume), **options)
    get = lambda rows: files.fetch_ranges(spark, [(r.symbol, r.fetch_from.isoformat(), r.fetch_to.isoformat()) for r in rows], fetcher, **told)
    asked = ranges.collect()
    if asked:
        new = _kept(get(asked), root, spark).join(series.select("symbol", F.col("series_kind").alias("kind")), "symbol")
        old = bars.drop("d_roll")
        merged, actions = ingest.refresh(old, new)
        doubtful = {r.symbol for r in actions.filter("action = 'refetch'").collect()} - {r.symbol for r in asked if r.why == "all"}
        if doubtful:
            progress(f"fetched whole again: {', '.join(sorted(doubtful))}")
            again = plan.filter(F.col("symbol").isin(sorted(doubtful))).withColumns({c: F.lit(None).cast("date") for c in ("first", "last")})
            whole = _kept(get(ingest.fetch_plan(again, start, end).collect()), root, spark)
            merged = merged.filter(~F.col("symbol").isin(sorted(doubtful))).unionByName(whole)
        fresh = doubtful | {r.symbol for r in asked if r.why == "all"}
        trimmed = ingest.trim_orphans(merged.filter(F.col("symbol").isin(sorted(fresh))), settings.orphan_gap_days)
        merged = merged.filter(~F.col("symbol").isin(sorted(fresh))).unionByName(trimmed)
        marks = rolls if rolls is not None else spark.createDataFrame([], "series string, expiry date")
        futures = series.filter("continuous").select("symbol")
        marked = ingest.roll_marks(merged.join(futures, "symbol", "left_semi"), marks)
        merged = merged.join(futures, "symbol", "left_anti").withColumn("d_roll", F.lit(None).cast("tinyint")).unionByName(marked)
        bars = _publish(spark, merged, root, "bars", settings.compression)
    meta = _metadata(bars, series)
    meta = _publish(spark, meta, root, "meta", settings.compression)
    progress(f"{len(asked)} ranges fetched")
    return report(spark, root, bars, meta, series.select("symbol"))


def _resolved(outside: list[Series], master: files.InstrumentMaster, now: str, strict: bool, progress: Callable) -> list[Series]:
    from dataclasses import replace

    out = []
    for s in outside:
        try:
            if s.continuous:
                contract = ingest.front_month(master.exchange(s.exchange), datetime.date.fromisoformat(now[:10]), [s.tradingsymbol]).first()
                s = replace(s, tradingsymbol=contract.tradingsymbol)
            elif not master.exchange(s.exchange).filter(F.upper("tradingsymbol") == s.tradingsymbol.upper()).limit(1).count():
                raise LookupError(f"{s.exchange} has no {s.tradingsymbol}")
            out.append(s)
        except LookupError as e:
            if strict:
                raise
            progress(f"left out: {s.name}: {e}")
    return out


def _closed(spark: SparkSession, now: str, session_end: str, settings: Settings) -> datetime.date:
    return spark.range(1).select(ingest.completed_session(now, session_end, settings.session_grace_minutes)).first()[0]


def _kept(new: DataFrame, root: str, spark: SparkSession) -> DataFrame:
    """Fetched bars are written at once: what a vendor was asked for isn't asked again when a later step is repeated."""
    folder = f"{root}/fetched"
    new.write.mode("overwrite").parquet(f"{folder}-{(name := uuid.uuid4().hex)}")
    return spark.read.schema(new.schema).parquet(f"{folder}-{name}")


def _metadata(bars: DataFrame, series: DataFrame) -> DataFrame:
    spans = bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("session_date").alias("first"), F.max("session_date").alias("last"))
    equities = bars.join(series.filter("series_kind = 'equity'").select("symbol"), "symbol", "left_semi")
    hits = ingest.split_suspects(equities)
    fields = ["session_date", "prev_close", "close", "ratio", "nearest_split", "move_pct", "volume_consistent", "confidence"]
    hits = hits.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("corporate_action_suspects"))
    names = [c.split()[0] for c in META.split(", ")]
    out = series.join(spans, "symbol").join(hits, "symbol", "left").withColumn("schema_version", F.lit(SCHEMA_VERSION))
    return out.withColumn("corporate_action_suspects", F.coalesce("corporate_action_suspects", F.array().cast(out.schema["corporate_action_suspects"].dataType))).select(*names)


def report(spark: SparkSession, root: str, bars: DataFrame, meta: DataFrame, asked: DataFrame) -> DataFrame:
    """The coverage of every series asked for, also kept as JSON beside the cache."""
    kinds = meta.select("symbol", F.col("series_kind").alias("kind"))
    home = bars.join(kinds.filter("kind <> 'futures'").select("symbol"), "symbol", "left_semi")
    sessions = quality.consensus_sessions(home)
    hits = meta.select("symbol", F.explode("corporate_action_suspects"))
    out = ingest.coverage(bars, kinds, asked, sessions, hits)
    rows = [r.asDict() for r in out.collect()]
    summary = {"series": len(rows), "stale": sum(r["stale"] for r in rows), "empty": sorted(r["symbol"] for r in rows if not r["rows"]), "with_gaps": sum(bool(r["missing_sessions"]) for r in rows), "rows": rows}
    files.write_report(spark, json.loads(json.dumps(summary, default=str)), f"{root}/coverage")
    return out
