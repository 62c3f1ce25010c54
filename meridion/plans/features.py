"""Feature families over weekly bars of brands (the daily bars of nations where series must be long)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridion.functions import windows as w
from meridion.operators import features as fx
from meridion.operators.features import FEATURES
from meridion.plans import sql
from meridion.plans.catalog import query, rounded, rounded_sql
from meridion.sources.bars import brand_weeks, event_days, nation_days

INTEGERS = {"D_inside_day", "D_prev_inside_day", "D_tmr_cpr_vs_today_code", "D_hh", "D_hl", "D_lh", "D_ll", "D_daily_trend", "D_structure_trend_code", "D_nr_length", "D_nr_day", "D_nr_expand", "D_rsi7_gt_rsi14", "D_ema_stack_20_50_100", "D_golden_regime", "D_dow", "D_vol_surge_20", "D_vol_surge_50", "D_days_since_boh_20", "D_days_since_bol_20", "D_days_since_5pct_up", *[f"DOW_{k}" for k in range(7)], *[f"D_{f}_run" for f in ("hh", "hl", "lh", "ll")], *[f"D_breakout_{s}_{k}" for s in ("high", "low") for k in (20, 50)], "Comb_RSIslopePos__ADX_15_25", "Comb_GapUp__CPR_Tmr_Above", "Comb_GapDown__CPR_Tmr_Below", "Comb_ATRlow__EMA20pos", "Comb_ATRhigh__EMA20neg"}
TEXTS = {"D_cpr_vs_yday", "D_structure_trend", "D_day_type"}
#: Columns in prices or volumes are compared to fewer decimals than ratios, products of ranks to more.
COARSE = {"D_rsi14_obv_x": 2, "D_rsi7_obv_x": 2} | dict.fromkeys(["D_obv", "D_obv_slope", "D_dollar_vol", "D_ema20", "D_ema50", "D_ema100", "D_atr14", "D_atr30", "D_macd", "D_macd_signal", "D_macd_hist", "D_macd_hist_rstd10", "D_slope_stability", "D_slope_stability_rmean50", "D_slope_stability_rstd10", "D_slope_stability_rstd20", "D_close_roll_slope_20_rstd20", "D_close_roll_slope_20_rstd10", "D_WQ_12", "D_WQ_23", "D_WQ_41"], 2)
COARSE |= dict.fromkeys(["D_close_roll_slope_20", "D_close_roll_slope_50"], 3) | dict.fromkeys(["D_sma5", "D_sma20", "D_sma50", "D_sma200"], 6) | dict.fromkeys(["D_WQ_13", "D_WQ_16", "D_WQ_19", "D_WQ_20", "D_WQ_29", "D_WQ_33", "D_WQ_35", "D_WQ_38", "D_compress_state", "D_mdi14_rrank10", "D_mdi14_rrank20"], 9) | dict.fromkeys(["D_WQ_26", "D_WQ_3", "D_WQ_40", "D_WQ_44", "D_WQ_6"], 7)

FAMILIES = {
    "feat_ema": ["D_ema20", "D_ema50", "D_ema100", "D_ema20_angle_deg", "D_ema_stack_20_50_100"],
    "feat_rsi": ["D_rsi7", "D_rsi14", "D_rsi7_gt_rsi14"],
    "feat_macd": ["D_macd", "D_macd_signal", "D_macd_hist", "D_macd_hist_rstd10"],
    "feat_adx": ["D_adx14", "D_pdi14", "D_mdi14", "D_mdi14_diff1", "D_mdi14_diff5", "D_mdi14_rrank10", "D_mdi14_rrank20"],
    "feat_atr": ["D_atr14", "D_atr30", "D_atr_ratio_14_30", "D_atr_pct", "D_range_to_atr14", "D_range_pct", "D_gap_pct"],
    "feat_sma": ["D_sma5", "D_sma20", "D_sma50", "D_sma200", "D_golden_regime"],
    "feat_pivots": ["D_prev_high", "D_prev_low", "D_prev_close", "D_cpr_pivot", "D_cpr_bc", "D_cpr_tc", "D_support1", "D_resistance1", "D_support2", "D_resistance2", "D_cpr_width_pct", "D_cpr_vs_yday", "D_tmr_cpr_vs_today_code"],
    "feat_structure": ["D_inside_day", "D_prev_inside_day", "D_hh", "D_hl", "D_lh", "D_ll", "D_daily_trend", "D_structure_trend", "D_structure_trend_code", "D_day_type", "D_hh_run", "D_hl_run", "D_lh_run", "D_ll_run"],
    "feat_candles": ["D_oli", "D_body_ratio", "D_wick_skew", "D_body_ratio_rmean50", "D_body_ratio_rmean20", "D_nr_expand", "D_nr_length", "D_nr_day"],
    "feat_flow": ["D_cmf20", "D_cmf20_rmean50", "D_obv", "D_obv_slope", "D_rsi14_obv_x", "D_rsi7_obv_x"],
    "feat_turnover": ["D_dollar_vol", "D_dvol_z20", "D_dvol_z50", "D_dvol_z252", "D_vol_surge_20", "D_vol_surge_50", "D_amihud_20", "D_amihud_60"],
    "feat_calendar": ["D_dow", *[f"DOW_{k}" for k in range(7)]],
    "feat_bands": ["D_bb_pctB_20", "D_bb_bw_20", "D_compress_state"],
    "feat_volatility": ["D_vol_yz_20", "D_vol_yz_50", "D_realvol_20", "D_realvol_60", "D_realvol_ratio_20_60", "D_downside_dev_60", "D_upside_vol_ratio"],
    "feat_channels": ["D_donch_pos_20", "D_donch_pos_50", "D_breakout_high_20", "D_breakout_high_50", "D_breakout_low_20", "D_breakout_low_50", "D_days_since_boh_20", "D_days_since_bol_20", "D_donch_pos_20_rmean50", "D_donch_pos_50_rmean50", "D_donch_pos_20_lag5", "D_donch_pos_50_lag5"],
    "feat_zscores": ["D_rsi14_z252", "D_atr_pct_z252", "D_vol_z252", "D_ema20_angle_z252"],
    "feat_slopes": ["D_close_roll_slope_20", "D_close_roll_slope_50", "D_midpoint_slope", "D_slope_stability", "D_slope_stability_rmean50", "D_slope_stability_rstd10", "D_slope_stability_rstd20", "D_close_roll_slope_20_rstd20", "D_close_roll_slope_20_rstd10", "D_ret_5d_roll_std"],
    "feat_combos": ["Comb_RSIslopePos__ADX_15_25", "Comb_GapUp__CPR_Tmr_Above", "Comb_GapDown__CPR_Tmr_Below", "Comb_ATRlow__EMA20pos", "Comb_ATRhigh__EMA20neg"],
    "feat_distances": ["D_dist_from_20h", "D_dist_from_20l", "D_dist_from_52wh", "D_dist_from_52wl", "D_pos_in_52w_range", "D_drawdown_252"],
    "feat_returns": ["D_intraday_ret_pct", "D_overnight_share", "D_ret_skew_60", "D_ret_kurt_60", "D_days_since_5pct_up", "D_n_5pct_up_60", "D_n_5pct_up_252"],
    "alpha_correlations": ["D_WQ_3", "D_WQ_6", "D_WQ_44", "D_WQ_40", "D_WQ_26"],
    "alpha_simple": ["D_WQ_12", "D_WQ_23", "D_WQ_33", "D_WQ_41"],
    "alpha_ranked_cov": ["D_WQ_13", "D_WQ_16"],
    "alpha_reversal": ["D_WQ_19", "D_WQ_20", "D_WQ_29"],
    "alpha_ts_ranks": ["D_WQ_35", "D_WQ_38"],
}
ALL = [n for f in FAMILIES.values() for n in f]


def digits(name: str) -> int | None:
    return None if name in INTEGERS or name in TEXTS else COARSE.get(name, 5)


def _family(name: str, columns: list[str]) -> None:
    text = f"{sql.layered(sql.BARS_BRAND, columns)} SELECT symbol, session_date, {rounded_sql({c: digits(c) for c in columns})} FROM x"

    @query(name, text)
    def run(spark, sf_dir):
        out = FEATURES.with_columns(brand_weeks(spark, sf_dir), columns).select("symbol", "session_date", *columns)
        return rounded(out, 5, **COARSE)


for _name, _columns in FAMILIES.items():
    _family(_name, _columns)


@query("bars_brand_week", sql.BARS_BRAND)
def _brand(spark, sf_dir):
    return brand_weeks(spark, sf_dir)


@query("bars_nation_day", sql.BARS_NATION)
def _nation(spark, sf_dir):
    return nation_days(spark, sf_dir)


@query("bars_event_day", f"SELECT symbol, session_date, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, volume FROM ({sql.BARS_EVENT})")
def _event(spark, sf_dir):
    return rounded(event_days(spark, sf_dir))


_LONG = ["D_ema100", "D_rsi14", "D_sma200", "D_drawdown_252"]


@query("feat_long_series", f"{sql.layered(sql.BARS_NATION, _LONG)} SELECT symbol, session_date, {rounded_sql({c: digits(c) for c in _LONG})} FROM x")
def _long(spark, sf_dir):
    """Series of up to 2,500 sessions: exponential means run over many blocks."""
    return rounded(FEATURES.with_columns(nation_days(spark, sf_dir), _LONG).select("symbol", "session_date", *_LONG), 5, **COARSE)


_TREND = """b AS (SELECT *, {period} AS p FROM ({bars})), t AS (SELECT symbol, p, max(high) AS top FROM b GROUP BY 1, 2),
t2 AS (SELECT *, lag(top) OVER (PARTITION BY symbol ORDER BY p) AS prev FROM t),
r AS (SELECT symbol, session_date, p, max(high) OVER (PARTITION BY symbol, p ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b)
SELECT r.symbol, session_date, CASE WHEN run > prev THEN 1 WHEN run < prev THEN -1 ELSE 0 END AS trend FROM r JOIN t2 ON r.symbol = t2.symbol AND r.p = t2.p"""


@query("feat_weekly_trend", "WITH " + _TREND.format(period=sql.SQL["_week"], bars=sql.BARS_NATION))
def _weekly_trend(spark, sf_dir):
    return fx.period_trend(nation_days(spark, sf_dir), w.week_end(), "trend").select("symbol", "session_date", "trend")


@query("feat_monthly_trend", "WITH " + _TREND.format(period=sql.SQL["_month"], bars=sql.BARS_NATION))
def _monthly_trend(spark, sf_dir):
    return fx.period_trend(nation_days(spark, sf_dir), w.month_start(), "trend").select("symbol", "session_date", "trend")


@query("bars_weekly", f"WITH b AS (SELECT *, {sql.SQL['_week']} AS week FROM ({sql.BARS_NATION})) SELECT symbol, week, arg_max(close, session_date) AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume FROM b GROUP BY 1, 2", dates=('week',))
def _weekly(spark, sf_dir):
    return fx.weekly(nation_days(spark, sf_dir))


@query("feat_weekly", f"""WITH b AS (SELECT *, {sql.SQL['_week']} AS week FROM ({sql.BARS_NATION})),
wk AS (SELECT symbol, week, arg_max(close, session_date) AS close, max(high) AS high, min(low) AS low, sum(volume) AS volume FROM b GROUP BY 1, 2),
f AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS weeks, (close / lag(close, 4) OVER v - 1) * 100 AS r4, (close / lag(close, 13) OVER v - 1) * 100 AS r13,
  least(greatest((close - low) / nullif(high - low, 0), 0.0), 1.0) AS pos0, high, low,
  volume / nullif(CASE WHEN count(volume) OVER (PARTITION BY symbol ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) >= 2 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY week ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END, 0) AS vol
  FROM wk WINDOW v AS (PARTITION BY symbol ORDER BY week)),
p AS (SELECT *, CASE WHEN high > low THEN pos0 END AS pos FROM f),
s AS (SELECT symbol, week, CASE WHEN weeks >= 5 THEN lag(r4) OVER v END AS W_ret_4w, CASE WHEN weeks >= 5 THEN lag(r13) OVER v END AS W_ret_13w, CASE WHEN weeks >= 5 THEN lag(pos) OVER v END AS W_close_pos, CASE WHEN weeks >= 5 THEN lag(vol) OVER v END AS W_vol_vs_4w FROM p WINDOW v AS (PARTITION BY symbol ORDER BY week))
SELECT b.symbol, b.session_date, round(W_ret_4w, 5) + 0.0 AS W_ret_4w, round(W_ret_13w, 5) + 0.0 AS W_ret_13w, round(W_close_pos, 5) + 0.0 AS W_close_pos, round(W_vol_vs_4w, 5) + 0.0 AS W_vol_vs_4w FROM b LEFT JOIN s ON b.symbol = s.symbol AND b.week = s.week""")
def _weekly_features(spark, sf_dir):
    return rounded(fx.weekly_features(nation_days(spark, sf_dir)).select("symbol", "session_date", "W_ret_4w", "W_ret_13w", "W_close_pos", "W_vol_vs_4w"), 5)


@query("feat_weekly_vpoc", f"""WITH b AS (SELECT symbol, session_date, (high + low + close) / 3 AS p, volume AS v, {sql.SQL['_week']} AS week FROM ({sql.BARS_NATION})),
j AS (SELECT a.symbol, a.session_date, c.p, c.v, min(c.p) OVER k AS lo, max(c.p) OVER k AS hi FROM b a JOIN b c ON a.symbol = c.symbol AND a.week = c.week AND c.session_date <= a.session_date WINDOW k AS (PARTITION BY a.symbol, a.session_date)),
n AS (SELECT symbol, session_date, lo, hi, CASE WHEN hi > lo THEN least(greatest(floor((p - lo) / ((hi - lo) / 50)), 0), 49) ELSE 0 END AS bin, sum(v) AS v FROM j GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY symbol, session_date ORDER BY v DESC, bin) AS r FROM n)
SELECT symbol, session_date, round(CASE WHEN hi = lo THEN lo ELSE lo + (bin + 0.5) * ((hi - lo) / 50) END, 6) + 0.0 AS D_weekly_vpoc FROM t WHERE r = 1""")
def _vpoc(spark, sf_dir):
    return rounded(FEATURES.with_columns(nation_days(spark, sf_dir), ["D_weekly_vpoc"]).select("symbol", "session_date", "D_weekly_vpoc"), 6)


_FLAGS = ["D_inside_day", "D_daily_trend", "D_structure_trend_code", "D_vol_surge_20", "D_breakout_high_20"]


@query("prevalence", f"""{sql.layered(sql.BARS_BRAND, _FLAGS)}, u AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value FROM x" for c in _FLAGS)}),
c AS (SELECT feature, value, count(*) AS k FROM u GROUP BY 1, 2), m AS (SELECT feature, arg_max(value, row(k, -value)) AS modal_value, max(k) AS modal FROM c WHERE value IS NOT NULL GROUP BY 1)
SELECT feature, sum(k)::BIGINT AS n, count(value) AS n_unique, any_value(modal_value) AS modal_value, round(any_value(modal) / sum(k), 6) AS modal_share, round(coalesce(sum(CASE WHEN value IS NULL THEN k END), 0) / sum(k), 6) AS null_share FROM c JOIN m USING (feature) GROUP BY feature""", dates=())
def _prevalence(spark, sf_dir):
    x = FEATURES.with_columns(brand_weeks(spark, sf_dir), _FLAGS)
    return rounded(fx.prevalence(x, _FLAGS))


@query("flagship_top5", f"""{sql.layered(sql.BARS_NATION, ['D_sma20', 'D_rsi14', 'D_daily_trend'])},
r AS (SELECT symbol, session_date, D_daily_trend, (rank() OVER (PARTITION BY session_date ORDER BY D_rsi14) + (count(*) OVER (PARTITION BY session_date, D_rsi14) - 1) / 2.0) / count(*) OVER (PARTITION BY session_date) AS X_rank_rsi14,
  (rank() OVER (PARTITION BY session_date ORDER BY close / D_sma20) + (count(*) OVER (PARTITION BY session_date, close / D_sma20) - 1) / 2.0) / count(*) OVER (PARTITION BY session_date) AS X_rank_sma FROM x WHERE D_sma20 IS NOT NULL AND D_rsi14 IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY session_date ORDER BY X_rank_rsi14 + X_rank_sma DESC, symbol) AS place FROM r)
SELECT symbol, session_date, D_daily_trend, round(X_rank_rsi14, 6) AS X_rank_rsi14, round(X_rank_sma, 6) AS X_rank_sma, place::INTEGER AS place FROM t WHERE place <= 5""")
def _flagship(spark, sf_dir):
    x = FEATURES.with_columns(nation_days(spark, sf_dir), ["D_sma20", "D_rsi14", "D_daily_trend"])
    x = x.filter(F.col("D_sma20").isNotNull() & F.col("D_rsi14").isNotNull()).withColumn("_rel", F.col("close") / F.col("D_sma20"))
    x = x.select("symbol", "session_date", "D_daily_trend", w.session_rank("D_rsi14").alias("X_rank_rsi14"), w.session_rank("_rel").alias("X_rank_sma"))
    place = F.row_number().over(w.Window.partitionBy("session_date").orderBy((F.col("X_rank_rsi14") + F.col("X_rank_sma")).desc(), "symbol"))
    return rounded(x.withColumn("place", place).filter(F.col("place") <= 5))
