"""Calendars, absences, gates, ingest checks, reconciliation, liquidity."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from meridion.operators import ingest, quality
from meridion.plans import sql
from meridion.plans.catalog import query, rounded
from meridion.plans.general import strip_sql
from meridion.sources.bars import brand_weeks, nation_days, table

_V = "PARTITION BY symbol ORDER BY session_date"
_LIVE = f"""WITH b AS ({sql.BARS_NATION}), sp AS (SELECT symbol, min(session_date) AS f, max(session_date) AS l FROM b GROUP BY 1), d AS (SELECT session_date, count(DISTINCT symbol) AS present FROM b GROUP BY 1),
lp AS (SELECT d.session_date, any_value(present) AS present, count(*) AS live FROM d JOIN sp ON d.session_date BETWEEN f AND l GROUP BY 1),
s AS (SELECT *, row_number() OVER (ORDER BY session_date) - 1 AS pos FROM lp WHERE (SELECT count(*) FROM sp) >= 10 AND present / live >= 0.6)"""
_GONE = f"""{_LIVE}, gone AS (SELECT sp.symbol, s.session_date, s.pos FROM sp JOIN s ON s.session_date BETWEEN sp.f AND sp.l ANTI JOIN b ON b.symbol = sp.symbol AND b.session_date = s.session_date),
wide AS (SELECT g.session_date, count(*) / any_value(lp.live) >= 0.5 AS wide FROM gone g JOIN lp USING (session_date) GROUP BY 1),
i AS (SELECT symbol, session_date, pos, wide, pos - row_number() OVER (PARTITION BY symbol, wide ORDER BY pos) AS run FROM gone JOIN wide USING (session_date)),
k AS (SELECT symbol, session_date, pos, CASE WHEN wide THEN 'market_wide' WHEN count(*) OVER (PARTITION BY symbol, wide, run) >= 5 THEN 'suspension' ELSE 'isolated' END AS kind FROM i)"""


@query("consensus_calendar", f"{_LIVE} SELECT session_date, present, live, pos AS session_pos FROM s")
def _consensus(spark, sf_dir):
    return quality.consensus_sessions(nation_days(spark, sf_dir)).withColumn("session_pos", F.col("session_pos").cast("long"))


def _with_sessions(spark, sf_dir):
    b = nation_days(spark, sf_dir)
    return b, quality.consensus_sessions(b)


@query("absence_classes", f"{_GONE} SELECT symbol, session_date, kind FROM k")
def _absences(spark, sf_dir):
    b, s = _with_sessions(spark, sf_dir)
    return quality.classify_absences(b, s).select("symbol", "session_date", "kind")


@query("session_gaps", f"{_GONE}, n AS (SELECT symbol, session_date, CASE WHEN session_date - lag(session_date) OVER ({_V}) <= 4 THEN 0 ELSE 1 END AS new FROM gone), r AS (SELECT symbol, session_date, sum(new) OVER ({_V}) AS run FROM n) SELECT symbol, min(session_date) AS first, max(session_date) AS last, count(*) AS missing FROM r GROUP BY symbol, run", dates=('first', 'last'))
def _gaps(spark, sf_dir):
    b, s = _with_sessions(spark, sf_dir)
    return quality.gap_runs(quality.absences(b, s))


def _pair(a: str, b: str, x: str, y: str) -> str:
    inside = f"d BETWEEN greatest((SELECT min(d) FROM {x}), (SELECT min(d) FROM {y})) AND least((SELECT max(d) FROM {x}), (SELECT max(d) FROM {y}))"
    return f"SELECT d AS session_date, '{a}' AS has, '{b}' AS lacks FROM {x} WHERE {inside} AND d NOT IN (SELECT d FROM {y}) UNION ALL SELECT d, '{b}', '{a}' FROM {y} WHERE {inside} AND d NOT IN (SELECT d FROM {x})"


def _calendar(spark, sf_dir):
    published = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("session_date"))
    return quality.build_calendar(nation_days(spark, sf_dir), "3", published)


@query("calendar_disagreements", f"{_LIVE}, c AS (SELECT session_date AS d FROM s), a AS (SELECT DISTINCT o_orderdate::DATE AS d FROM orders), r AS (SELECT DISTINCT session_date AS d FROM b WHERE symbol = '3') SELECT * FROM ({_pair('authoritative', 'consensus', 'a', 'c')} UNION ALL {_pair('authoritative', 'reference', 'a', 'r')} UNION ALL {_pair('consensus', 'reference', 'c', 'r')})")
def _disagree(spark, sf_dir):
    """Dates that one of three sources has and another lacks."""
    return _calendar(spark, sf_dir).disagreements


@query("calendar_trust", f"{_LIVE} SELECT CASE WHEN (SELECT count(*) FROM s) > 0 THEN 'consensus' ELSE 'authoritative' END AS source, (SELECT count(*) FROM s) > 0 AS trusted, (SELECT count(*) FROM s) AS consensus, (SELECT count(DISTINCT o_orderdate::DATE) FROM orders) AS authoritative, (SELECT count(*) FROM b WHERE symbol = '3') AS reference", dates=())
def _trust(spark, sf_dir):
    c = _calendar(spark, sf_dir)
    return spark.createDataFrame([(c.source, c.trusted, c.counts["consensus"], c.counts["authoritative"], c.counts["reference"])], "source string, trusted boolean, consensus long, authoritative long, reference long")


@query("reference_calendar", "SELECT d::DATE AS session_date FROM range(DATE '1999-01-01', DATE '2000-01-01', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6 AND d::DATE NOT IN (SELECT o_orderdate::DATE FROM orders WHERE o_orderpriority = '1-URGENT')")
def _reference(spark, sf_dir):
    holidays = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.to_date("o_orderdate").alias("session_date"))
    return quality.reference_sessions(spark, "1999-01-01", "1999-12-31", holidays)


_VIOLATIONS = "count(*) AS rows, min(session_date) AS first, max(session_date) AS last, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS null_prices, count(*) FILTER (close <= 0) AS nonpositive, count(*) FILTER (high < low OR close > high + 1e-9 OR close < low - 1e-9 OR open > high + 1e-9 OR open < low - 1e-9) AS ohlc_violations, count(*) FILTER (volume IS NULL) AS null_volume, count(*) FILTER (volume < 0) AS negative_volume, count(*) FILTER (volume = 0) AS zero_volume, count(*) - count(DISTINCT session_date) AS repeated"
_BROKEN = f"(SELECT symbol, session_date, open, CASE WHEN day(session_date) = 1 THEN low - 1 ELSE high END AS high, low, CASE WHEN day(session_date) = 2 THEN NULL ELSE close END AS close, CASE WHEN day(session_date) = 3 THEN -volume ELSE volume END AS volume FROM ({sql.BARS_NATION}))"


def _broken(spark, sf_dir):
    day = F.dayofmonth("session_date")
    return nation_days(spark, sf_dir).withColumns({"high": F.when(day == 1, F.col("low") - 1).otherwise(F.col("high")), "close": F.when(day != 2, F.col("close")), "volume": F.when(day == 3, -F.col("volume")).otherwise(F.col("volume"))})


@query("bar_violations", f"SELECT symbol, {_VIOLATIONS} FROM {_BROKEN} GROUP BY 1", dates=('first', 'last'))
def _violations(spark, sf_dir):
    return quality.violations(_broken(spark, sf_dir))


_SPLIT = f"""sl AS (SELECT *, lag(close) OVER ({_V}) AS prev_close, lag(volume) OVER ({_V}) AS pv, median(close) OVER ({_V} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS level FROM b0),
sr AS (SELECT *, prev_close / nullif(close, 0) AS ratio, abs(close / nullif(prev_close, 0) - 1) AS move FROM sl), sn AS (SELECT *, list_filter([2.0::DOUBLE, 2.5::DOUBLE, 3.0::DOUBLE, 4.0::DOUBLE, 5.0::DOUBLE, 10.0::DOUBLE, 20.0::DOUBLE, 100.0::DOUBLE, 1.5::DOUBLE, 1.25::DOUBLE, 1.2::DOUBLE, 4.0::DOUBLE / 3.0::DOUBLE, 5.0::DOUBLE / 3.0::DOUBLE, 5.0::DOUBLE / 2.0::DOUBLE, 7.0::DOUBLE / 5.0::DOUBLE, 3.0::DOUBLE / 2.0::DOUBLE],
  lambda t: abs((CASE WHEN ratio >= 1 THEN ratio ELSE 1 / ratio END) - t) / t <= 0.04)[1] AS nearest_split FROM sr WHERE ratio > 0),
splits AS (SELECT symbol, session_date, ratio, nearest_split, move, CASE WHEN pv > 0 AND volume IS NOT NULL THEN CASE WHEN close < prev_close THEN volume / pv > 1.3 ELSE volume / pv < 0.77 END ELSE true END AS consistent FROM sn
  WHERE move >= 0.3 AND nearest_split IS NOT NULL AND NOT coalesce((high - low) / nullif(close, 0) > 0.5 * move, false) AND NOT coalesce(abs(level / close - 1) > 0.5 * move, false))"""
#: A universe in which every part of the gate fails some series: futures (every fourth nation), an index (23), wrong counts
#: (7), another schema (9), no metadata (11), metadata changed late (13), and a series without bars.
_META = """m AS (SELECT n_nationkey::VARCHAR AS symbol, CASE WHEN n_nationkey % 4 = 0 THEN 'futures' WHEN n_nationkey = 23 THEN 'index' ELSE 'equity' END AS kind, n_regionkey::VARCHAR AS exchange FROM nation)"""
_GATE = f"""WITH b0 AS ({sql.BARS_NATION}), {_META}, {_SPLIT},
b AS (SELECT b0.* FROM b0 JOIN m USING (symbol) WHERE kind <> 'futures'), sp AS (SELECT symbol, min(session_date) AS f, max(session_date) AS l FROM b GROUP BY 1), d AS (SELECT session_date, count(DISTINCT symbol) AS present FROM b GROUP BY 1),
lp AS (SELECT d.session_date, any_value(present) AS present, count(*) AS live FROM d JOIN sp ON d.session_date BETWEEN f AND l GROUP BY 1),
s AS (SELECT *, row_number() OVER (ORDER BY session_date) - 1 AS pos FROM lp WHERE (SELECT count(*) FROM sp) >= 10 AND present / live >= 0.6),
gone AS (SELECT sp.symbol, s.session_date, s.pos FROM sp JOIN s ON s.session_date BETWEEN sp.f AND sp.l ANTI JOIN b ON b.symbol = sp.symbol AND b.session_date = s.session_date),
wide AS (SELECT g.session_date, count(*) / any_value(lp.live) >= 0.5 AS wide FROM gone g JOIN lp USING (session_date) GROUP BY 1),
i AS (SELECT symbol, session_date, pos, wide, pos - row_number() OVER (PARTITION BY symbol, wide ORDER BY pos) AS run FROM gone JOIN wide USING (session_date)),
k AS (SELECT symbol, CASE WHEN wide THEN 'market_wide' WHEN count(*) OVER (PARTITION BY symbol, wide, run) >= 5 THEN 'suspension' ELSE 'isolated' END AS kind FROM i),
iso AS (SELECT symbol, count(*) FILTER (kind = 'isolated') AS isolated, count(*) AS missing FROM k GROUP BY 1),
v AS (SELECT symbol, {_VIOLATIONS} FROM b0 GROUP BY 1), beh AS (SELECT symbol, (SELECT count(*) FROM s WHERE s.session_date > v.last) AS stale FROM v),
f AS (SELECT exchange, symbol, session_date FROM b0 JOIN m USING (symbol) WHERE kind = 'futures'), e AS (SELECT exchange FROM f GROUP BY 1 HAVING count(DISTINCT symbol) >= 2), ps AS (SELECT DISTINCT exchange, session_date FROM f JOIN e USING (exchange)),
fm AS (SELECT q.symbol, count(*) AS peer_missing FROM (SELECT exchange, symbol, min(session_date) AS a, max(session_date) AS z FROM f GROUP BY 1, 2) q JOIN ps ON ps.exchange = q.exchange AND ps.session_date BETWEEN a AND z ANTI JOIN f ON f.symbol = q.symbol AND f.session_date = ps.session_date GROUP BY 1),
fz AS (SELECT symbol, coalesce(peer_missing, 0) AS peer_missing FROM (SELECT DISTINCT symbol FROM f JOIN e USING (exchange)) LEFT JOIN fm USING (symbol)),
ss AS (SELECT symbol, count(*) AS split_suspects FROM splits GROUP BY 1),
mm AS (SELECT symbol, kind, exchange FROM m WHERE symbol <> '11' UNION ALL SELECT 'NOBODY', 'equity', '0'),
j AS (SELECT coalesce(v.symbol, mm.symbol) AS symbol, coalesce(mm.kind, 'equity') AS kind, mm.symbol IS NOT NULL AS has_meta, v.* EXCLUDE (symbol) FROM v FULL JOIN mm ON v.symbol = mm.symbol),
t AS (SELECT j.*, coalesce(isolated, 0) AS isolated, coalesce(missing, 0) AS missing_sessions, stale AS stale_sessions, peer_missing, coalesce(split_suspects, 0) AS split_suspects FROM j LEFT JOIN iso USING (symbol) LEFT JOIN beh USING (symbol) LEFT JOIN fz USING (symbol) LEFT JOIN ss USING (symbol)),
c AS (SELECT *, (SELECT count(*) FROM s) > 0 AS trusted FROM t),
r AS (SELECT symbol, kind, CASE WHEN trusted THEN stale_sessions END AS stale_sessions, CASE WHEN trusted THEN isolated END AS isolated, CASE WHEN trusted THEN peer_missing END AS peer_missing, split_suspects,
  rows IS NOT NULL AND trusted AND NOT coalesce(stale_sessions > 1, false) AND CASE WHEN kind = 'futures' THEN coalesce(peer_missing <= 3, false) ELSE isolated <= 3 END AS complete,
  coalesce(null_prices = 0 AND nonpositive = 0 AND ohlc_violations = 0 AND (kind = 'index' OR (null_volume < rows AND negative_volume = 0)), true) AS valid,
  coalesce(repeated = 0, true) AND split_suspects = 0 AS consistent, has_meta AND symbol <> '9' AND NOT (rows IS NOT NULL AND symbol IN ('7', '13')) AS verified FROM c)
SELECT *, CASE WHEN complete AND valid AND consistent AND verified THEN 'PASS' ELSE 'QUARANTINE' END AS status FROM r"""


def _gated(spark, sf_dir):
    b = nation_days(spark, sf_dir)
    n = table(spark, sf_dir, "nation")
    key, at = F.col("n_nationkey"), datetime.datetime(2024, 1, 1)
    kind = F.when(key % 4 == 0, "futures").when(key == 23, "index").otherwise("equity")
    m = n.select(key.cast("string").alias("symbol"), kind.alias("series_kind"), F.col("n_regionkey").cast("string").alias("exchange"), F.when(key == 9, "0").otherwise("1").alias("schema_version"), F.lit(at).alias("built_at"), F.when(key == 13, F.lit(at + datetime.timedelta(minutes=1))).otherwise(F.lit(at)).alias("changed_at"))
    counts = b.groupBy("symbol").agg(F.count("*").alias("rows"))
    m = m.join(counts, "symbol", "left").withColumn("rows", F.when(F.col("symbol") == "7", F.col("rows") + 1).otherwise(F.col("rows"))).filter("symbol <> '11'")
    m = m.unionByName(spark.createDataFrame([("NOBODY", "equity", "0", "1", at, at, 5)], m.schema))
    published = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("session_date"))
    calendar = quality.build_calendar(b, None, published, m.select("symbol", F.col("series_kind").alias("kind")))
    return quality.gate(b, calendar, m, "1", ingest.split_suspects(b))


@query("gate", _GATE, dates=())
def _gate(spark, sf_dir):
    return _gated(spark, sf_dir).select("symbol", "kind", "stale_sessions", "isolated", "peer_missing", F.col("split_suspects").cast("long").alias("split_suspects"), "complete", "valid", "consistent", "verified", "status")


@query("gate_report", f"SELECT count(*) AS requested, count(*) FILTER (status <> 'QUARANTINE') AS allowed, 0::BIGINT AS unverified, count(*) FILTER (status = 'QUARANTINE') AS quarantined FROM ({_GATE})", dates=())
def _gate_report(spark, sf_dir):
    return quality.gate_report(_gated(spark, sf_dir)).drop("quarantine")


@query("gate_without_calendar", f"SELECT DISTINCT symbol, 'QUARANTINE' AS status FROM ({sql.BARS_NATION})", dates=())
def _gate_closed(spark, sf_dir):
    return quality.gate(nation_days(spark, sf_dir), None).select("symbol", "status")


@query("peer_sessions", f"WITH b AS ({sql.BARS_NATION}), m AS (SELECT n_nationkey::VARCHAR AS symbol, n_regionkey::VARCHAR AS exchange FROM nation), f AS (SELECT exchange, symbol, session_date FROM b JOIN m USING (symbol)), e AS (SELECT exchange FROM f GROUP BY 1 HAVING count(DISTINCT symbol) >= 2) SELECT DISTINCT exchange, session_date FROM f JOIN e USING (exchange)")
def _peers(spark, sf_dir):
    meta = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("symbol"), F.col("n_regionkey").cast("string").alias("exchange"), F.lit("futures").alias("series_kind"))
    return quality.peer_sessions(nation_days(spark, sf_dir), meta)


_SPARSE = f"(SELECT * FROM ({sql.BARS_NATION}) WHERE session_date < DATE '1997-01-01' OR session_date >= DATE '1999-01-01')"


@query("orphan_trim", f"""WITH b AS {_SPARSE}, n AS (SELECT *, row_number() OVER ({_V}) AS rn, count(*) OVER (PARTITION BY symbol) AS total, session_date - lag(session_date) OVER ({_V}) AS gap FROM b),
t AS (SELECT *, coalesce(max(CASE WHEN gap >= 365 AND total - rn + 1 >= 252 THEN rn END) OVER (PARTITION BY symbol), 1) AS start FROM n) SELECT symbol, session_date, close FROM t WHERE rn >= start""")
def _orphans(spark, sf_dir):
    b = nation_days(spark, sf_dir).filter("session_date < date'1997-01-01' OR session_date >= date'1999-01-01'")
    return ingest.trim_orphans(b).select("symbol", "session_date", "close")


@query("split_suspects", f"""WITH b0 AS ({sql.BARS_NATION}), {_SPLIT} SELECT symbol, session_date, round(ratio, 6) AS ratio, round(nearest_split, 6) AS nearest_split, round(move * 100, 5) AS move_pct, consistent AS volume_consistent, CASE WHEN consistent THEN 'high' ELSE 'medium' END AS confidence FROM splits""")
def _splits(spark, sf_dir):
    x = ingest.split_suspects(nation_days(spark, sf_dir)).select("symbol", "session_date", "ratio", "nearest_split", "move_pct", "volume_consistent", "confidence")
    return x.withColumns({"ratio": F.round("ratio", 6), "nearest_split": F.round("nearest_split", 6), "move_pct": F.round("move_pct", 5)})


_EXPIRIES = "(SELECT DISTINCT s_nationkey::VARCHAR AS symbol, (date_trunc('month', o_orderdate) + INTERVAL 20 DAY)::DATE AS expiry FROM orders JOIN supplier ON s_suppkey = o_orderkey % 100 WHERE month(o_orderdate) % 3 = 0)"


def _expiry_table(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter(F.month("o_orderdate") % 3 == 0).select((F.col("o_orderkey") % 100).alias("s_suppkey"), F.date_add(F.trunc("o_orderdate", "MM"), 20).alias("expiry"))
    return o.join(table(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_nationkey").cast("string").alias("series"), "expiry").distinct()


@query("roll_marks", f"""WITH b AS ({sql.BARS_NATION}), e AS {_EXPIRIES}, m AS (SELECT e.symbol, min(b.session_date) AS session_date FROM e JOIN b ON b.symbol = e.symbol AND b.session_date > e.expiry GROUP BY e.symbol, e.expiry), t AS (SELECT symbol, min(expiry) AS known FROM e WHERE symbol <> '3' GROUP BY 1)
SELECT b.symbol, b.session_date, CASE WHEN b.symbol <> '3' AND EXISTS (SELECT 1 FROM m WHERE m.symbol = b.symbol AND m.session_date = b.session_date) THEN 1 WHEN b.session_date >= t.known THEN 0 END AS d_roll FROM b LEFT JOIN t ON b.symbol = t.symbol""")
def _rolls(spark, sf_dir):
    return ingest.roll_marks(nation_days(spark, sf_dir), _expiry_table(spark, sf_dir).filter("series <> '3'")).select("symbol", "session_date", F.col("d_roll").cast("int").alias("d_roll"))


@query("roll_calendar", "SELECT o_orderpriority AS series, o_orderdate::DATE AS expiry, arg_min(o_orderstatus, row(o_orderkey, o_orderstatus)) AS tradingsymbol, min(o_orderkey) AS observed_on FROM orders GROUP BY 1, 2", dates=('expiry',))
def _roll_calendar(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("expiry"), F.col("o_orderstatus").alias("tradingsymbol"), F.col("o_orderkey").alias("observed_on"))
    return ingest.roll_calendar(o)


@query("front_month", "SELECT upper(o_orderpriority) AS name, arg_min(o_orderkey::VARCHAR, row(o_orderdate::DATE, o_orderkey::VARCHAR)) AS tradingsymbol, min(o_orderdate::DATE) AS expiry FROM orders WHERE o_orderdate::DATE >= DATE '1998-01-15' GROUP BY 1", dates=('expiry',))
def _front(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("tradingsymbol"), F.to_date("o_orderdate").alias("expiry"), F.lit("FUT").alias("instrument_type"))
    return ingest.front_month(o, datetime.date(1998, 1, 15))


@query("merge_bars", f"""WITH b AS ({sql.BARS_BRAND}), n AS (SELECT symbol, session_date, open, high, low, close * 1.5 AS close, volume FROM b WHERE session_date >= DATE '2001-01-01'), u AS (SELECT *, 0 AS p FROM b WHERE session_date < DATE '2001-06-01' UNION ALL SELECT *, 1 FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY symbol, session_date ORDER BY p DESC) AS k FROM u) SELECT symbol, session_date, round(close, 4) AS close FROM r WHERE k = 1""")
def _merge(spark, sf_dir):
    """The new batch holds each bar twice; of those the larger stays."""
    b = brand_weeks(spark, sf_dir)
    new = b.filter("session_date >= date'2001-01-01'")
    twice = new.withColumn("close", F.col("close") * 1.25).unionByName(new.withColumn("close", F.col("close") * 1.5))
    return rounded(ingest.merge(b.filter("session_date < date'2001-06-01'"), twice).select("symbol", "session_date", "close"), 4)


@query("fetch_plan", f"""WITH b AS ({sql.BARS_NATION}), sp AS (SELECT n_nationkey::VARCHAR AS symbol, CASE WHEN n_nationkey <> 5 THEN f END AS first, CASE WHEN n_nationkey <> 5 THEN l END AS last, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END AS lag FROM nation LEFT JOIN (SELECT symbol, min(session_date) AS f, max(session_date) AS l FROM b GROUP BY 1) ON symbol = n_nationkey::VARCHAR),
u AS (SELECT symbol, 'all' AS why, DATE '1995-01-10' AS fetch_from, DATE '2001-10-31' AS fetch_to FROM sp WHERE last IS NULL UNION ALL SELECT symbol, 'beginning', DATE '1995-01-10', first - 1 FROM sp WHERE first > DATE '1995-01-10'
UNION ALL SELECT symbol, 'tail', greatest(last - 7, DATE '1995-01-10'), DATE '2001-10-31' FROM sp WHERE lag > 0 OR last < DATE '2001-10-31') SELECT * FROM u WHERE fetch_from <= fetch_to""", dates=("fetch_from", "fetch_to"))
def _plan(spark, sf_dir):
    """What an incremental run fetches: a series without bars whole, late beginnings, and tails."""
    b = nation_days(spark, sf_dir)
    spans = b.groupBy("symbol").agg(F.min("session_date").alias("first"), F.max("session_date").alias("last"))
    key = F.col("n_nationkey")
    s = table(spark, sf_dir, "nation").select(key.cast("string").alias("symbol"), F.when(key % 3 == 0, 1).otherwise(0).alias("lag_sessions")).join(spans, "symbol", "left")
    s = s.withColumns({c: F.when(F.col("symbol") != "5", F.col(c)) for c in ("first", "last")})
    return ingest.fetch_plan(s, datetime.date(1995, 1, 10), datetime.date(2001, 10, 31))


#: Two vendors: another level everywhere; one severe print a year (3), constant small errors (5), sessions that we lack
#: (7), no data (9), hardly any (11), and a name that isn't stored.
_OURS = f"(SELECT * FROM ({sql.BARS_NATION}) WHERE NOT (symbol = '7' AND day(session_date) = 13))"
_THEIRS = f"(SELECT symbol, session_date, CASE WHEN symbol = '3' AND strftime(session_date, '%m-%d') BETWEEN '06-10' AND '06-11' THEN close * 8 WHEN symbol = '5' AND day(session_date) = 11 THEN close * 4 * 1.0078125 ELSE close * 4 END AS close, volume * 2 AS volume FROM ({sql.BARS_NATION}) WHERE symbol <> '9' AND (symbol <> '11' OR day(session_date) = 1))"
_RECONCILED = f"""WITH a0 AS {_OURS}, t0 AS {_THEIRS}, sp AS (SELECT symbol, max(session_date) AS z, greatest(min(session_date), max(session_date) - 750) AS st FROM a0 GROUP BY 1),
a AS (SELECT a0.* FROM a0 JOIN sp USING (symbol) WHERE session_date BETWEEN st AND z), t AS (SELECT t0.* FROM t0 JOIN sp USING (symbol) WHERE session_date BETWEEN st AND z),
j AS (SELECT coalesce(a.symbol, t.symbol) AS symbol, coalesce(a.session_date, t.session_date) AS session_date, a.symbol IS NOT NULL AS ia, t.symbol IS NOT NULL AS it, a.close AS ca, t.close AS ct, a.volume AS va, t.volume AS vt FROM a FULL JOIN t ON a.symbol = t.symbol AND a.session_date = t.session_date),
p AS (SELECT *, abs((ca / nullif(lag(ca) OVER ({_V}), 0) - 1) - (ct / nullif(lag(ct) OVER ({_V}), 0) - 1)) AS diff FROM j WHERE ia AND it),
s AS (SELECT symbol, count(*) AS overlap_days, count(diff) AS n, count(*) FILTER (diff > 0.005) AS bad, max(diff) AS worst, count(*) FILTER (diff > 0.15) AS actions, median(va / nullif(vt, 0)) AS vr FROM p GROUP BY 1),
m AS (SELECT symbol, count(*) FILTER (ia) AS ours, count(*) FILTER (it) AS theirs, count(*) FILTER (NOT ia) AS missing_from_ours, count(*) FILTER (NOT it) AS missing_from_theirs FROM j GROUP BY 1),
w AS (SELECT n_nationkey::VARCHAR AS symbol FROM nation UNION ALL SELECT 'NOBODY'),
r AS (SELECT symbol, coalesce(ours, 0) AS ours, theirs, missing_from_ours, missing_from_theirs, coalesce(overlap_days, 0) AS overlap_days, coalesce(n, 0) AS compared_returns, coalesce(bad, 0) AS mismatches, bad / nullif(n, 0) AS rate, worst, actions, vr FROM w LEFT JOIN m USING (symbol) LEFT JOIN s USING (symbol))
SELECT symbol, missing_from_ours, missing_from_theirs, overlap_days, compared_returns, mismatches, round(rate, 5) AS mismatch_rate, round(vr, 6) AS median_volume_ratio, coalesce(actions, 0) > 0 AS suspected,
CASE WHEN ours = 0 THEN 'NOT_CACHED' WHEN theirs = 0 THEN 'NO_REFERENCE_DATA' WHEN overlap_days < 30 THEN 'TOO_LITTLE_OVERLAP' WHEN compared_returns > 0 AND NOT coalesce(rate > 0.01, false) AND NOT coalesce(worst > 0.05, false) AND missing_from_ours <= 3 THEN 'OK'
  WHEN missing_from_ours > 3 THEN 'MISSING_SESSIONS' WHEN actions > 0 AND worst > 0.05 AND rate <= 0.01 THEN 'CORPORATE_ACTION' ELSE 'MISMATCH' END AS status FROM r"""


def _reconciled(spark, sf_dir):
    b = nation_days(spark, sf_dir)
    day = F.dayofmonth("session_date")
    june = F.date_format("session_date", "MM-dd").between("06-10", "06-11")
    factor = F.when((F.col("symbol") == "3") & june, 8.0).when((F.col("symbol") == "5") & (day == 11), 4 * 1.0078125).otherwise(4.0)
    theirs = b.filter((F.col("symbol") != "9") & ((F.col("symbol") != "11") | (day == 1))).withColumns({"close": F.col("close") * factor, "volume": F.col("volume") * 2})
    ours = b.filter(~((F.col("symbol") == "7") & (day == 13)))
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("symbol")).union(spark.createDataFrame([("NOBODY",)], "symbol string"))
    return ingest.reconcile(ours, theirs, asked)


@query("reconcile", _RECONCILED, dates=())
def _reconcile(spark, sf_dir):
    x = _reconciled(spark, sf_dir).withColumn("suspected", F.coalesce(F.size("corporate_action_suspects"), F.lit(0)) > 0)
    return rounded(x.select("symbol", "missing_from_ours", "missing_from_theirs", "overlap_days", "compared_returns", "mismatches", "mismatch_rate", "median_volume_ratio", "suspected", "status"))


@query("reconcile_summary", f"WITH q AS ({_RECONCILED}) SELECT count(*) AS symbols_checked, round(median(mismatch_rate) FILTER (status IN ('OK', 'MISMATCH', 'MISSING_SESSIONS')), 5) AS median_mismatch_rate, count(*) FILTER (suspected) AS suspects, count(*) FILTER (status = 'OK') AS ok FROM q", dates=())
def _reconcile_summary(spark, sf_dir):
    x = ingest.reconcile_summary(_reconciled(spark, sf_dir))
    return x.select("symbols_checked", "median_mismatch_rate", F.size("symbols_with_suspects").cast("long").alias("suspects"), F.coalesce(F.col("by_status")["OK"], F.lit(0)).alias("ok"))


_TURNOVER = f"""t AS (SELECT symbol, median(close * volume) AS m, any_value(sessions) AS sessions, max(session_date) AS last FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS r, count(*) OVER (PARTITION BY symbol) AS sessions FROM ({sql.BARS_BRAND}) {{where}}) WHERE r <= 60 AND sessions >= 30 GROUP BY 1)"""


@query("turnover", f"WITH {_TURNOVER.format(where='')} SELECT symbol, round(m, 3) AS median_turnover, sessions, last FROM t", dates=("last",))
def _turnover(spark, sf_dir):
    return rounded(ingest.turnover(brand_weeks(spark, sf_dir)), 3)


_AS_OF = datetime.date(1999, 6, 28)
_TURNOVER_THEN = _TURNOVER.format(where=f"WHERE session_date <= DATE '{_AS_OF}'")


@query("turnover_as_of", f"WITH {_TURNOVER_THEN} SELECT symbol, round(m, 3) AS median_turnover, sessions, last FROM t", dates=("last",))
def _turnover_as_of(spark, sf_dir):
    """Liquidity as it was known on a day."""
    return rounded(ingest.turnover(brand_weeks(spark, sf_dir), as_of=_AS_OF), 3)


@query("turnover_floors", f"WITH {_TURNOVER.format(where='')}, f AS (SELECT unnest([0.0, 100000.0, 500000.0, 1000000.0, 2500000.0, 5000000.0, 10000000.0, 25000000.0, 50000000.0, 100000000.0]::DOUBLE[]) AS floor) SELECT floor, (SELECT count(*) FROM t WHERE m >= floor) AS series, round((SELECT count(*) FROM t WHERE m >= floor) / (SELECT count(*) FROM t), 6) AS share FROM f", dates=())
def _floors(spark, sf_dir):
    return rounded(ingest.floor_table(brand_weeks(spark, sf_dir)))


@query("turnover_quantiles", f"WITH {_TURNOVER.format(where='')}, q AS (SELECT quantile_cont(m, [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]) AS q FROM t) SELECT unnest([0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]::DOUBLE[]) AS quantile, round(unnest(q), 2) AS median_turnover FROM q", dates=())
def _turnover_quantiles(spark, sf_dir):
    return rounded(ingest.turnover_quantiles(ingest.turnover(brand_weeks(spark, sf_dir))), 2)


@query("thinnest", f"WITH {_TURNOVER.format(where='')} SELECT symbol, round(m, 3) AS median_turnover FROM t ORDER BY m, symbol LIMIT 10", dates=())
def _thinnest(spark, sf_dir):
    """A report of the ten series with the least turnover."""
    return rounded(ingest.thinnest(ingest.turnover(brand_weeks(spark, sf_dir))).select("symbol", "median_turnover"), 3)


@query("coverage", f"""{_GONE}, kd AS (SELECT n_nationkey::VARCHAR AS symbol, CASE WHEN n_nationkey % 6 = 0 THEN 'futures' ELSE 'equity' END AS kind FROM nation UNION ALL SELECT 'NOBODY', 'equity'), r AS (SELECT symbol, count(*) AS rows, max(session_date) AS last FROM b GROUP BY 1),
x AS (SELECT kd.symbol, kind, coalesce(rows, 0) AS rows, last, (SELECT max(last) FROM r JOIN kd USING (symbol) WHERE kind = 'equity') AS expected FROM kd LEFT JOIN r ON r.symbol = kd.symbol),
n AS (SELECT symbol, session_date, CASE WHEN session_date - lag(session_date) OVER ({_V}) <= 4 THEN 0 ELSE 1 END AS new FROM gone), g AS (SELECT symbol, session_date, sum(new) OVER ({_V}) AS run FROM n), h AS (SELECT symbol, run, min(session_date) AS f, max(session_date) AS l, count(*) AS c FROM g GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY f) AS k, count(*) OVER (PARTITION BY symbol) AS runs FROM h),
z AS (SELECT symbol, sum(c)::BIGINT AS missing, string_agg(CASE WHEN f = l THEN f::VARCHAR ELSE f::VARCHAR || '..' || l::VARCHAR END, ', ' ORDER BY f) FILTER (k <= 5) || CASE WHEN any_value(runs) > 5 THEN ', +' || (any_value(runs) - 5) || ' more runs' ELSE '' END AS missing_runs FROM o GROUP BY 1)
SELECT x.symbol, kind, rows, last, (expected - last)::INTEGER AS days_behind, last IS NULL OR last < expected AS stale, CASE WHEN kind = 'equity' THEN coalesce(missing, 0) END AS missing_sessions, CASE WHEN kind = 'equity' THEN missing_runs END AS missing_runs FROM x LEFT JOIN z ON x.symbol = z.symbol""", dates=("last",))
def _coverage(spark, sf_dir):
    """Every series asked for, one of which has no bars."""
    b, s = _with_sessions(spark, sf_dir)
    key = F.col("n_nationkey")
    kinds = table(spark, sf_dir, "nation").select(key.cast("string").alias("symbol"), F.when(key % 6 == 0, "futures").otherwise("equity").alias("kind"))
    asked = kinds.select("symbol").union(spark.createDataFrame([("NOBODY",)], "symbol string"))
    x = ingest.coverage(b, kinds, asked, s)
    return x.select("symbol", "kind", "rows", "last", "days_behind", "stale", "missing_sessions", F.array_join("missing_runs", ", ").alias("missing_runs"))


@query("resolve_symbols", f"""WITH m AS (SELECT upper(p_name) AS name, {strip_sql('p_name')} AS base, p_partkey, CASE WHEN p_type LIKE 'S%' AND p_size < 10 THEN 2 WHEN p_type LIKE 'S%' THEN 1 ELSE 0 END AS s FROM part UNION ALL SELECT 'BOTH-EQ', 'BOTH', 900001, 1 UNION ALL SELECT 'BOTH', 'BOTH', 900002, 0),
e AS (SELECT name, arg_max(p_partkey, row(s, -p_partkey)) AS t FROM m GROUP BY 1), b AS (SELECT base, arg_max(p_partkey, row(s, -p_partkey)) AS t FROM m GROUP BY 1),
w AS (SELECT DISTINCT p_name || '-EQ' AS symbol FROM part UNION SELECT DISTINCT replace(p_name, ' ', '') || '-BE' FROM part UNION SELECT unnest(['NOBODY', 'both', 'BOSS-SM', 'alias'])),
o AS (SELECT symbol, CASE WHEN symbol = 'BOSS-SM' THEN 'BOTH' WHEN symbol = 'alias' THEN 'RED BOX?' END AS want FROM w)
SELECT symbol, coalesce((SELECT t FROM e WHERE name = want), (SELECT t FROM e WHERE name = want || '-EQ'), (SELECT t FROM b WHERE base = {strip_sql('want')}), (SELECT t FROM e WHERE name = upper(symbol)), (SELECT t FROM e WHERE name = upper(symbol) || '-EQ'), (SELECT t FROM b WHERE base = {strip_sql('symbol')})) AS instrument_token FROM o""", dates=())
def _resolve(spark, sf_dir):
    """Exact names, names with -EQ, normalised ones, and two overrides, one of which leads nowhere."""
    p = table(spark, sf_dir, "part")
    home = F.when(F.col("p_type").startswith("S"), "NSE").otherwise("X")
    master = p.select(F.col("p_name").alias("tradingsymbol"), F.col("p_partkey").alias("instrument_token"), home.alias("segment"), F.when(F.col("p_size") < 10, "EQ").otherwise("FUT").alias("instrument_type"))
    master = master.unionByName(spark.createDataFrame([("BOTH-EQ", 900001, "BSE-X", "FUT"), ("BOTH", 900002, "X", "EQ")], master.schema))
    wanted = p.select(F.concat("p_name", F.lit("-EQ")).alias("symbol")).union(p.select(F.concat(F.regexp_replace("p_name", " ", ""), F.lit("-BE")))).union(spark.createDataFrame([("NOBODY",), ("both",), ("BOSS-SM",), ("alias",)], "symbol string"))
    return ingest.resolve_symbols(wanted, master, spark.createDataFrame([("boss", "both"), ("ALIAS", "red box?")], "symbol string, tradingsymbol string"))


@query("unresolved_symbols")
def _unresolved(spark, sf_dir):
    """Names that the master doesn't know, each with its closest ones."""
    p = table(spark, sf_dir, "part")
    master = p.select(F.col("p_name").alias("tradingsymbol"))
    lost = p.select(F.concat("p_name", F.lit(" ltd")).alias("symbol")).distinct().withColumn("instrument_token", F.lit(None).cast("long"))
    return ingest.unresolved(lost, master)


@query("completed_sessions", "SELECT o_orderkey, CASE WHEN t >= date_trunc('day', t) + INTERVAL 15 HOUR + INTERVAL 45 MINUTE THEN t::DATE ELSE t::DATE - 1 END AS day FROM (SELECT o_orderkey, o_orderdate + o_orderkey % 24 * INTERVAL 1 HOUR AS t FROM orders)", dates=("day",))
def _completed_all(spark, sf_dir):
    """Of every order, at an hour by its key, so that both answers occur."""
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ingest.completed_session(at, "15:30").alias("day"))
