"""Sets, duplicates, scalars, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridion.functions import scalars
from meridion.operators import leaks
from meridion.plans import sql
from meridion.plans.catalog import query, rounded
from meridion.sources.bars import brand_weeks, nation_days, normalise, number, table
from meridion.streaming import bars as streams
from meridion.work import new_folder

_A = f"(SELECT DISTINCT session_date FROM ({sql.BARS_NATION}) WHERE symbol = '1')"
_B = f"(SELECT DISTINCT session_date FROM ({sql.BARS_NATION}) WHERE symbol = '2')"


def _days(spark, sf_dir, symbol):
    return nation_days(spark, sf_dir).filter(F.col("symbol") == symbol).select("session_date").distinct()


for _name, _word, _how in (("set_union", "UNION", lambda a, b: a.union(b).distinct()), ("set_intersect", "INTERSECT", lambda a, b: a.intersect(b)), ("set_except", "EXCEPT", lambda a, b: a.subtract(b))):

    @query(_name, f"SELECT * FROM {_A} {_word} SELECT * FROM {_B}")
    def _sets(spark, sf_dir, how=_how):
        return how(_days(spark, sf_dir, "1"), _days(spark, sf_dir, "2"))


@query("union_all", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier", dates=())
def _union(spark, sf_dir):
    """Every customer and every supplier."""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit(None).cast("string").alias("segment"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("dedupe_keep_last", "SELECT user_id::VARCHAR AS symbol, ts::DATE AS session_date, arg_max(value, row(ts, event_id)) AS close FROM events GROUP BY 1, 2")
def _dedupe(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("session_date"), F.col("value").alias("close"), F.struct("ts", "event_id").alias("ingested_at"))
    return normalise(e).select("symbol", "session_date", "close")


@query("dedupe_keep_first", "SELECT event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1", dates=())
def _first(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("r", r).filter("r = 1").select("event_type", "value", "event_id")


_RAW = "CASE WHEN p_partkey % 50 = 0 THEN ' Scrip ' WHEN p_partkey % 50 = 1 THEN 'a/b*' || p_name WHEN p_partkey % 50 = 2 THEN '' ELSE '  ' || p_name || (['', '-EQ', '-BE', '-BZ', '-BL', '-SM', '-GS', '-GB', '-EQ-GB', '.NS'])[p_partkey % 10 + 1] END"


def strip_sql(x: str) -> str:
    """The endings -EQ, -BE, -BZ, -BL, -SM, -GS, -GB dropped in that order, then letters and digits only."""
    return f"regexp_replace(regexp_replace(upper(trim({x})), '(-GB)?(-GS)?(-SM)?(-BL)?(-BZ)?(-BE)?(-EQ)?$', ''), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query("symbols_normalised", f"""WITH r AS (SELECT p_partkey, {_RAW} AS raw FROM part), c AS (SELECT *, regexp_replace(trim(regexp_replace(raw, '\\s+', ' ', 'g')), '[<>:"/?*]', '', 'g') AS s FROM r)
SELECT p_partkey, CASE WHEN s <> '' AND lower(s) NOT IN ('symbol', 'symbols', 'ticker', 'tickers', 'scrip', 'scrips', 'name') THEN s END AS sanitized, {strip_sql('raw')} AS normalised FROM c""", dates=())
def _symbols(spark, sf_dir):
    raw = F.expr(_RAW.replace("([", "element_at(array(").replace("])[p_partkey % 10 + 1]", "), cast(p_partkey % 10 + 1 AS int))"))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.sanitize_symbol(raw).alias("sanitized"), scalars.normalise_symbol(raw).alias("normalised"))


@query("dates_parsed", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders", dates=("day",))
def _dates(spark, sf_dir):
    """Each of the five formats; month first only where the day can't be a month."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    text = lambda f: F.date_format("o_orderdate", f)
    late = F.dayofmonth("o_orderdate") > 12
    raw = F.when(k == 0, text("yyyy-MM-dd")).when(k == 1, text("dd-MM-yyyy")).when(k == 2, text("d/M/yyyy")).when((k == 3) & late, text("MM/dd/yyyy")).otherwise(text("dd.MM.yyyy"))
    return o.select("o_orderkey", scalars.parse_date(F.concat(F.lit(" "), raw)).alias("day"))


@query("lag_rule", "SELECT n_name, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 1 END AS lag_sessions FROM nation", dates=())
def _lags(spark, sf_dir):
    """A session end after 15:30 lags a series."""
    end = F.element_at(F.array(F.lit("15:30"), F.lit("17:00"), F.lit("23:30")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_name", scalars.lag_sessions(end).alias("lag_sessions"))


@query("seeded_sample", None)
def _sample(spark, sf_dir):
    """Ten series in an order that the seed alone decides (another database has other hashes)."""
    from meridion.operators.ingest import sample_symbols

    return sample_symbols(nation_days(spark, sf_dir), 10, 7)


@query("true_false_columns", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS flag, CASE WHEN event_id % 3 = 0 THEN 'true' ELSE event_type END AS text FROM events", dates=())
def _flags(spark, sf_dir):
    """A column of true, FALSE and blanks becomes numbers; one with other texts stays."""
    k = F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, " True ").when(k == 1, "false").otherwise("").alias("flag"), F.when(k == 0, "true").otherwise(F.col("event_type")).alias("text"))
    return scalars.true_false_columns(e, ["flag", "text"])


@query("numbers_coerced", "SELECT event_id, round(try_cast(props AS DOUBLE), 6) AS from_text, round(try_cast(value::VARCHAR AS DOUBLE), 6) AS from_value FROM events", dates=())
def _numbers(spark, sf_dir):
    return rounded(table(spark, sf_dir, "events").select("event_id", number(F.col("props")).alias("from_text"), number(F.col("value").cast("string")).alias("from_value")))


@query("closest_names")
def _closest(spark, sf_dir):
    """Nearest known names of misspelt ones, by the share of matching blocks."""
    names = sorted(r.n_name for r in table(spark, sf_dir, "nation").select("n_name").collect())
    n = table(spark, sf_dir, "nation").select(F.concat(F.col("n_name"), F.lit("X")).alias("name"))
    return scalars.close_matches(n, "name", names, "closest")


def _stream(spark, sf_dir, files=1):
    folder = "/".join(sf_dir.split("/")) + "/events.parquet"
    return streams.read_events(spark, folder, files)


def _drained(spark, stream, mode="append"):
    name = f"stream_{uuid.uuid4().hex}"
    return streams.drain(stream, name, new_folder(spark, "stream"), mode)


@query("stream_tumbling_bars", "SELECT event_type AS symbol, epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2", dates=())
def _tumbling(spark, sf_dir):
    out = _drained(spark, streams.tumbling_bars(_stream(spark, sf_dir), "1 day"), "complete")
    return out.withColumn("start", F.col("start").cast("long"))


@query("stream_sliding_counts", "SELECT event_type, epoch(s)::BIGINT AS start, count(*) AS n FROM events, (SELECT unnest([0, 1, 2]) AS k), LATERAL (SELECT time_bucket(INTERVAL 1 DAY, ts) - to_days(k) AS s) GROUP BY 1, 2", dates=())
def _sliding(spark, sf_dir):
    out = _drained(spark, streams.sliding_counts(_stream(spark, sf_dir)), "complete")
    return out.withColumn("start", F.col("start").cast("long"))


@query("stream_active_spans", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts)))::BIGINT + 43200 AS end, count(*) AS n FROM r GROUP BY user_id, run", dates=())
def _spans(spark, sf_dir):
    out = _drained(spark, streams.active_spans(_stream(spark, sf_dir)), "complete")
    return out.select("user_id", F.unix_seconds("start").alias("start"), F.unix_seconds("end").alias("end"), "n")


@query("stream_moving_average", "SELECT event_type, event_id, round(CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END, 6) + 0.0 AS mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", dates=())
def _moving(spark, sf_dir):
    """All that is there is one micro-batch: files need not follow each other in time."""
    out = streams.moving_average(_stream(spark, sf_dir, None), new_folder(spark, "means"), new_folder(spark, "stream"))
    return rounded(out.select("event_type", "event_id", "mean"))


@query("lookahead_lint")
def _lint(spark, sf_dir):
    """Columns of a labelled frame that the plan check finds to look ahead: exactly the labels."""
    from meridion.operators.features import FEATURES
    from meridion.operators.labels import base_labels

    x = base_labels(FEATURES.with_columns(brand_weeks(spark, sf_dir), ["D_sma20", "D_rsi14"]))
    return spark.createDataFrame([(c,) for c in leaks.forward_windows(x)], "column string")


@query("source_leaks")
def _source(spark, sf_dir):
    """Findings of the source check in the features' own module: none."""
    import inspect

    from meridion.operators import features

    return spark.createDataFrame(leaks.source_findings(inspect.getsource(features)), "function string, line int, what string")
