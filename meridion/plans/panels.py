"""Labels, cross-sections, joins across series, folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridion.functions import windows as w
from meridion.operators import labels, panel
from meridion.operators.features import FEATURES
from meridion.plans import sql
from meridion.plans.catalog import query, rounded, rounded_sql
from meridion.plans.features import COARSE, digits
from meridion.sources.bars import brand_weeks, event_days, nation_days

_FWD = "(PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
_V = "PARTITION BY symbol ORDER BY session_date"


@query("labels_forward", f"""WITH b AS ({sql.BARS_BRAND}), l AS (SELECT symbol, session_date,
  CASE WHEN count(high) OVER {_FWD} = 5 THEN max(high) OVER {_FWD} / nullif(close, 0) - 1 END AS m, CASE WHEN count(low) OVER {_FWD} = 5 THEN min(low) OVER {_FWD} / nullif(close, 0) - 1 END AS a,
  lead(close, 5) OVER ({_V}) / nullif(close, 0) - 1 AS f FROM b)
SELECT symbol, session_date, round(m, 6) + 0.0 AS label_mfe_5d, round(a, 6) + 0.0 AS label_mae_5d, round(f, 6) + 0.0 AS label_fwd_ret_5d, CASE WHEN m IS NOT NULL THEN CASE WHEN m >= 0.05 THEN 1 ELSE 0 END END AS label_touch FROM l""")
def _labels(spark, sf_dir):
    return rounded(labels.base_labels(brand_weeks(spark, sf_dir)).select("symbol", "session_date", "label_mfe_5d", "label_mae_5d", "label_fwd_ret_5d", "label_touch"))


def _path_sql(v: str, tp: float, sl: float, scaled: bool) -> str:
    up, down = (f"{tp} * latr", f"{sl} * latr") if scaled else (f"{tp}::DOUBLE", f"{sl}::DOUBLE")
    k_tp = "coalesce(" + ", ".join(f"CASE WHEN h{i} / close - 1 >= {up} THEN {i} END" for i in range(1, 6)) + ")"
    k_sl = "coalesce(" + ", ".join(f"CASE WHEN l{i} / close - 1 <= -({down}) THEN {i} END" for i in range(1, 6)) + ")"
    ahead = ", ".join(f"lead(high, {i}) OVER ({_V}) AS h{i}, lead(low, {i}) OVER ({_V}) AS l{i}" for i in range(1, 6))
    return f"""WITH b AS ({sql.BARS_BRAND}), p AS (SELECT *, lag(close) OVER ({_V}) AS pc FROM b),
t AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr, {ahead} FROM p),
a AS (SELECT *, CASE WHEN count(tr) OVER ({_V} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) >= 14 THEN avg(tr) OVER ({_V} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END / nullif(close, 0) AS latr FROM t),
k AS (SELECT *, {k_tp} AS k_tp, {k_sl} AS k_sl, h5 IS NOT NULL AND l5 IS NOT NULL AND ({up}) IS NOT NULL AS known FROM a)
SELECT symbol, session_date, CASE WHEN known THEN CASE WHEN k_sl IS NOT NULL AND (k_tp IS NULL OR k_sl <= k_tp) THEN -1 WHEN k_tp IS NOT NULL THEN 1 ELSE 0 END END AS first_touch,
  CASE WHEN known THEN k_tp END AS days_to_tp, CASE WHEN known THEN k_sl END AS days_to_sl, CASE WHEN known THEN CASE WHEN k_tp = k_sl THEN 1 ELSE 0 END END AS ambiguous FROM k"""


for _v, (_tp, _sl, _scaled) in labels.VARIANTS.items():

    @query(f"labels_path_{_v}", _path_sql(_v, _tp, _sl, _scaled))
    def _paths(spark, sf_dir, v=_v):
        x = labels.path_labels(brand_weeks(spark, sf_dir), variants={v: labels.VARIANTS[v]})
        return x.select("symbol", "session_date", *[F.col(f"label_{a}_{v}").alias(b) for a, b in (("first_touch", "first_touch"), ("days_to_tp", "days_to_tp"), ("days_to_sl", "days_to_sl"), ("same_day_ambiguous", "ambiguous"))])


_X = ["D_range_pct", "D_atr_pct", "D_rsi14", "D_adx14", "D_dist_from_52wh", "D_dist_from_52wl", "D_pos_in_52w_range", "D_drawdown_252", "D_dvol_z20", "D_dvol_z252", "D_realvol_20", "D_realvol_ratio_20_60", "D_amihud_20", "D_gap_pct", "D_intraday_ret_pct", "D_ret_skew_60", "D_downside_dev_60", "D_bb_pctB_20", "D_donch_pos_20", "D_ema20_angle_deg"]


def _xs_sql(c: str) -> str:
    return f"""CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY session_date ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY session_date, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY session_date) END AS X_rank_{c},
  CASE WHEN {c} IS NOT NULL THEN least(greatest(({c} - avg({c}) OVER (PARTITION BY session_date)) / nullif(stddev_samp({c}) OVER (PARTITION BY session_date), 0), -5.0), 5.0) END AS z_{c},
  stddev_samp({c}) OVER (PARTITION BY session_date) AS s_{c}"""


@query("panel_cross_section", f"""{sql.layered(sql.BARS_BRAND, _X)}, r AS (SELECT symbol, session_date, {', '.join(_xs_sql(c) for c in _X)}, count(*) OVER (PARTITION BY session_date) AS X_universe_size FROM x)
SELECT symbol, session_date, {', '.join(f'round(X_rank_{c}, 6) AS X_rank_{c}, CASE WHEN s_{c} > 0 THEN round(z_{c}, 6) + 0.0 END AS X_z_{c}' for c in _X)}, X_universe_size FROM r""")
def _cross(spark, sf_dir):
    """Every feature of the list that exists (a return of one day doesn't)."""
    there = [c for c in panel.CROSS_SECTION if c in FEATURES]
    x = panel.cross_section(FEATURES.with_columns(brand_weeks(spark, sf_dir), there).select("symbol", "session_date", *there))
    return rounded(x.drop(*there))


@query("panel_liquidity_floor", f"""WITH b AS (SELECT *, close * volume AS dv FROM ({sql.BARS_BRAND})), m AS (SELECT *, CASE WHEN count(dv) OVER f >= 40 THEN median(dv) OVER f END AS t FROM b WINDOW f AS ({_V} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT symbol, session_date, round(t, 3) AS X_turnover_med FROM m WHERE t >= 1.0e6""")
def _floor(spark, sf_dir):
    return rounded(panel.liquidity_floor(brand_weeks(spark, sf_dir), 1e6).select("symbol", "session_date", "X_turnover_med"), 3)


_MKT = ["D_realvol_20", "D_rsi14", "D_adx14", "D_dist_from_52wh", "D_drawdown_252"]


@query("panel_market_relative", f"""{sql.layered(sql.BARS_BRAND, _MKT)}, m AS (SELECT session_date, {', '.join(f'{c} AS m_{c}' for c in _MKT)} FROM x WHERE symbol = 'Brand#1')
SELECT x.symbol, x.session_date, {', '.join(f'round(m_{c}, 5) + 0.0 AS MKT_{c}' for c in _MKT)}, round(D_realvol_20 / nullif(m_D_realvol_20, 0), 5) + 0.0 AS X_relvol_20 FROM x LEFT JOIN m USING (session_date)""")
def _market(spark, sf_dir):
    x = FEATURES.with_columns(brand_weeks(spark, sf_dir), _MKT).select("symbol", "session_date", *_MKT)
    return rounded(panel.market_relative(x, x.filter("symbol = 'Brand#1'")).drop(*_MKT), 5)


_ALIGN = f"""WITH b AS ({sql.BARS_NATION}), s AS (SELECT DISTINCT session_date FROM b), f AS (SELECT symbol, min(session_date) AS first FROM b GROUP BY 1),
g AS (SELECT f.symbol, s.session_date, b.close FROM f JOIN s ON s.session_date >= f.first LEFT JOIN b ON b.symbol = f.symbol AND b.session_date = s.session_date),
h AS (SELECT symbol, session_date, last_value(close IGNORE NULLS) OVER v AS close, count(close) OVER v AS grp FROM g WINDOW v AS ({_V} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
a AS (SELECT symbol, session_date, close, row_number() OVER (PARTITION BY symbol, grp ORDER BY session_date) - 1 AS stale FROM h)"""


@query("align_to_sessions", f"{_ALIGN}, l AS (SELECT symbol, session_date, lag(close) OVER ({_V}) AS close, lag(stale) OVER ({_V}) AS stale FROM a) SELECT * FROM l")
def _aligned(spark, sf_dir):
    b = nation_days(spark, sf_dir)
    out = panel.align_to_sessions(b, b.select("session_date").distinct(), lag=1)
    return out.select("symbol", "session_date", "close", F.col("stale").cast("long").alias("stale"))


@query("exogenous_join", f"""{_ALIGN}, r AS (SELECT *, close / nullif(lag(close) OVER ({_V}), 0) - 1 AS ret FROM a), p AS (SELECT DISTINCT session_date FROM b)
SELECT session_date, any_value(close) FILTER (symbol = '1') AS "1_close", any_value(stale) FILTER (symbol = '1') AS "1_stale", round(any_value(ret) FILTER (symbol = '1'), 6) + 0.0 AS "1_ret_1d",
  any_value(close) FILTER (symbol = '2') AS "2_close", any_value(stale) FILTER (symbol = '2') AS "2_stale", round(any_value(ret) FILTER (symbol = '2'), 6) + 0.0 AS "2_ret_1d" FROM r GROUP BY 1""")
def _exogenous(spark, sf_dir):
    b = nation_days(spark, sf_dir)
    out = panel.exogenous(b.select("session_date").distinct(), b, ["1", "2"])
    out = out.withColumns({c: F.col(c).cast("long") for c in ("1_stale", "2_stale")})
    return rounded(out, 6)


_FACTS = "(SELECT symbol, session_date, close AS fact FROM b0 WHERE day(session_date) <= 7)"


@query("asof_attach", f"""WITH b0 AS ({sql.BARS_NATION}), f AS {_FACTS}
SELECT b.symbol, b.session_date, b.close, f.fact FROM b0 b ASOF LEFT JOIN f ON b.symbol = f.symbol AND b.session_date >= f.session_date""")
def _asof(spark, sf_dir):
    b = nation_days(spark, sf_dir)
    facts = b.filter(F.dayofmonth("session_date") <= 7).select("symbol", "session_date", F.col("close").alias("fact"))
    return panel.asof_attach(b.select("symbol", "session_date", "close"), facts, ["fact"])


@query("fold_splits", f"""WITH s AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS pos, ntile(6) OVER (ORDER BY session_date) - 1 AS block FROM (SELECT DISTINCT session_date FROM ({sql.BARS_BRAND}))),
b AS (SELECT block, min(session_date) AS test_start, max(session_date) AS test_end, min(pos) AS first FROM s GROUP BY 1)
SELECT b.block::INTEGER AS fold, (SELECT min(session_date) FROM s) AS train_start, e.session_date AS train_end, test_start, test_end FROM b JOIN s e ON e.pos = b.first - 6 WHERE b.block > 0""", dates=('train_start', 'train_end', 'test_start', 'test_end'))
def _folds(spark, sf_dir):
    return panel.folds(brand_weeks(spark, sf_dir))


@query("fold_roles", f"""WITH s AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS pos, ntile(6) OVER (ORDER BY session_date) - 1 AS block FROM (SELECT DISTINCT session_date FROM ({sql.BARS_BRAND}))),
b AS (SELECT block AS fold, min(pos) AS first, max(pos) AS last FROM s WHERE block > 0 GROUP BY 1), x AS (SELECT fold, session_date, pos, first, last, first - 5 AS n, floor((first - 5) * 0.75) AS cut FROM s JOIN b ON pos <= last)
SELECT * FROM (SELECT fold::INTEGER AS fold, session_date, CASE WHEN pos < n AND pos < cut THEN 'fit' WHEN pos < n AND pos >= cut - 1 + 5 THEN 'cal' WHEN pos >= first THEN 'test' END AS role FROM x) WHERE role IS NOT NULL""")
def _roles(spark, sf_dir):
    b = brand_weeks(spark, sf_dir)
    return panel.fit_calibration(b, panel.folds(b))


_ALL = [n for n in FEATURES if not n.startswith("_") and not n.endswith("_term") and n not in ("D_weekly_vpoc", "D_tmr_cpr_vs_today_code", "D_hh", "D_hl", "D_lh", "D_ll", "D_price_and_obv_rising", "D_golden_regime", "D_day_type", "D_cpr_vs_yday", "D_structure_trend")]


@query("panel_build", f"""{sql.layered(sql.BARS_BRAND, [*_ALL, '_n'])}, c AS (SELECT symbol FROM x GROUP BY 1 HAVING count(*) >= 317), w AS (SELECT x.* FROM x JOIN c USING (symbol) WHERE _n > 312),
r AS (SELECT symbol, session_date, {', '.join(_ALL)}, {', '.join(_xs_sql(c) for c in _X)}, count(*) OVER (PARTITION BY session_date) AS X_universe_size FROM w)
SELECT symbol, session_date, {rounded_sql({c: digits(c) for c in _ALL})}, {', '.join(f'round(X_rank_{c}, 6) AS X_rank_{c}, CASE WHEN s_{c} > 0 THEN round(z_{c}, 5) + 0.0 END AS X_z_{c}' for c in _X)}, X_universe_size FROM r WHERE X_universe_size >= 20""")
def _panel(spark, sf_dir):
    """All features of a panel and its cross-section (labels and period features have queries of their own)."""
    x = panel.build_panel(brand_weeks(spark, sf_dir), _ALL)
    ranks = [f"X_rank_{c}" for c in _X]
    return rounded(x.select("symbol", "session_date", *_ALL, *[f"X_{k}_{c}" for c in _X for k in ("rank", "z")], "X_universe_size"), 5, **COARSE, **dict.fromkeys(ranks, 6))


_PERIODS = ["W_ret_4w", "W_ret_13w", "W_close_pos", "W_vol_vs_4w"]
_OUTSIDE = f"""{sql.layered(sql.BARS_BRAND, [*_MKT, '_n'])}, b AS (SELECT *, {sql.SQL['_week']} AS week FROM ({sql.BARS_BRAND})), q AS (SELECT symbol FROM x WHERE symbol NOT IN ('Brand#23', 'Brand#24') GROUP BY 1 HAVING count(*) >= 317),
wk AS (SELECT symbol, week, arg_max(close, session_date) AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume FROM b GROUP BY 1, 2),
f AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS weeks, (close / lag(close, 4) OVER v - 1) * 100 AS r4, CASE WHEN high > low THEN (close - low) / (high - low) END AS pos, max(high) OVER v AS top, lag(high) OVER v AS ptop FROM wk WINDOW v AS (PARTITION BY symbol ORDER BY week)),
sh AS (SELECT symbol, week, CASE WHEN weeks >= 5 THEN lag(r4) OVER v END AS W_ret_4w, CASE WHEN weeks >= 5 THEN lag(pos) OVER v END AS W_close_pos, ptop FROM f WINDOW v AS (PARTITION BY symbol ORDER BY week)),
tr AS (SELECT symbol, session_date, week, max(high) OVER (PARTITION BY symbol, week ORDER BY session_date) AS run FROM b),
m AS (SELECT session_date, {', '.join(f'{c} AS m_{c}' for c in _MKT)} FROM x WHERE symbol = 'Brand#24' AND _n > 312),
ss AS (SELECT DISTINCT session_date FROM b), g AS (SELECT session_date, (SELECT arg_max(close, session_date) FROM b o WHERE o.symbol = 'Brand#23' AND o.session_date <= ss.session_date) AS c FROM ss WHERE session_date >= (SELECT min(session_date) FROM b WHERE symbol = 'Brand#23')),
o AS (SELECT session_date, lag(c) OVER (ORDER BY session_date) AS close23, lag(c) OVER (ORDER BY session_date) / nullif(lag(c, 2) OVER (ORDER BY session_date), 0) - 1 AS ret23 FROM g),
p AS (SELECT x.symbol, x.session_date, D_realvol_20, count(*) OVER (PARTITION BY x.session_date) AS X_universe_size FROM x JOIN q USING (symbol) WHERE _n > 312)
SELECT p.symbol, p.session_date, round(W_ret_4w, 5) + 0.0 AS W_ret_4w, round(W_close_pos, 5) + 0.0 AS W_close_pos, CASE WHEN run > ptop THEN 1 WHEN run < ptop THEN -1 ELSE 0 END AS D_weekly_trend, {', '.join(f'round(m_{c}, 5) + 0.0 AS MKT_{c}' for c in _MKT)}, round(D_realvol_20 / nullif(m_D_realvol_20, 0), 5) + 0.0 AS X_relvol_20, close23 AS "Brand#23_close", round(ret23, 5) + 0.0 AS "Brand#23_ret_1d", X_universe_size
FROM p JOIN tr ON tr.symbol = p.symbol AND tr.session_date = p.session_date JOIN sh ON sh.symbol = p.symbol AND sh.week = tr.week LEFT JOIN m ON m.session_date = p.session_date LEFT JOIN o ON o.session_date = p.session_date WHERE X_universe_size >= 20"""


@query("panel_outside", _OUTSIDE)
def _outside(spark, sf_dir):
    """Weekly features, the market series and an outside one, lagged by a session."""
    b = brand_weeks(spark, sf_dir)
    kinds = b.select("symbol").distinct().withColumn("kind", F.when(F.col("symbol") == "Brand#24", "index").when(F.col("symbol") == "Brand#23", "futures").otherwise("equity"))
    x = panel.build_panel(b, ["D_realvol_20", "W_ret_4w", "W_close_pos", "D_weekly_trend"], kinds=kinds, market="Brand#24", outside=["Brand#23"], lags={"Brand#23": 1}, sessions=b.select("session_date").distinct())
    return rounded(x.select("symbol", "session_date", "W_ret_4w", "W_close_pos", "D_weekly_trend", *[f"MKT_{c}" for c in _MKT], "X_relvol_20", "Brand#23_close", "Brand#23_ret_1d", "X_universe_size"), 5)


@query("top_n_per_session", f"""WITH b AS ({sql.BARS_EVENT}), r AS (SELECT symbol, session_date, close, row_number() OVER (PARTITION BY session_date ORDER BY close DESC, symbol)::INTEGER AS place FROM b) SELECT symbol, session_date, place FROM r WHERE place <= 3""")
def _top(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("session_date").orderBy(F.desc("close"), "symbol"))
    return event_days(spark, sf_dir).withColumn("place", place).filter("place <= 3").select("symbol", "session_date", "place")


@query("universe_hash", f"SELECT substr(sha256(string_agg(symbol, '|' ORDER BY symbol)), 1, 16) AS hash FROM (SELECT DISTINCT symbol FROM ({sql.BARS_BRAND}))", dates=())
def _hash(spark, sf_dir):
    names = brand_weeks(spark, sf_dir).select("symbol").distinct()
    return names.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list("symbol")), "|").cast("binary"), 256), 1, 16).alias("hash"))


@query("contract")
def _contract(spark, sf_dir):
    """The feature contract: what each column needs, when it is known, why it is there."""
    names = [n for n in FEATURES if not n.startswith("_") and not n.endswith("_term")]
    return spark.createDataFrame(panel.contract(names), "feature string, resolved_at string, usable_from string, lookback int, uses_future boolean, in_x boolean, hypothesis string")


@query("validate_panel", f"WITH p AS (SELECT symbol, session_date, close, CASE WHEN day(session_date) = 1 THEN 2 ELSE 1 END AS y FROM ({sql.BARS_NATION})) SELECT count(*) AS rows, count(*) FILTER (symbol IS NULL) AS null_symbols, count(*) FILTER (session_date IS NULL) AS null_sessions, count(*) FILTER (y NOT IN (0, 1)) AS bad_y, (count(*) - count(DISTINCT (symbol, session_date)))::BIGINT AS repeated_keys FROM p", dates=())
def _validate(spark, sf_dir):
    p = nation_days(spark, sf_dir).withColumn("y", F.when(F.dayofmonth("session_date") == 1, 2).otherwise(1))
    return panel.validate_panel(p, ["close"], ["y"])


@query("strided_sessions", f"WITH b AS ({sql.BARS_NATION}), s AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS pos FROM (SELECT DISTINCT session_date FROM b)) SELECT b.symbol, b.session_date FROM b JOIN s USING (session_date) WHERE pos % greatest(1, (SELECT count(*) FROM b) // 4000) = 0")
def _strided(spark, sf_dir):
    return panel.strided_sessions(nation_days(spark, sf_dir).select("symbol", "session_date"), 4000)


@query("finalised_flags", f"{sql.layered(sql.BARS_BRAND, ['D_vol_surge_20', '_nr'])} SELECT symbol, session_date, D_vol_surge_20, coalesce(CASE WHEN _nr THEN 1 ELSE 0 END, 0) AS narrow FROM x")
def _finalised(spark, sf_dir):
    x = FEATURES.with_columns(brand_weeks(spark, sf_dir), ["D_vol_surge_20", "_nr"]).select("symbol", "session_date", "D_vol_surge_20", F.col("_nr").alias("narrow"))
    out = panel.finalise(x, ["D_vol_surge_20", "narrow"])
    return out.select("symbol", "session_date", F.col("D_vol_surge_20").cast("int").alias("D_vol_surge_20"), F.col("narrow").cast("int").alias("narrow"))
