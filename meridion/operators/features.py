"""Causal per-symbol features of bars.  No expression reads a later row (see leaks.check_plan)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridion.functions import windows as w
from meridion.operators.columns import Registry, c

FEATURES = Registry()
feature = FEATURES
#: Sessions before a series' features count as settled.
WARMUP = 312
#: Flags whose null means unknown and is never filled.
PRESERVE_NULL = ("d_roll", "D_vol_surge_20", "D_vol_surge_50")


def _simple(name: str, build, lookback: int = 1, why: str = "") -> None:
    FEATURES.add(name, build, lookback, why)


# Helpers shared by several features.  Names with an underscore are never part of a panel.
_simple("_n", lambda: F.row_number().over(w.series()))
_simple("_pc", lambda: w.lag(c("close")))
_simple("_ph", lambda: w.lag(c("high")))
_simple("_pl", lambda: w.lag(c("low")))
_simple("_rng", lambda: c("high") - c("low"))
_simple("_nz", lambda: F.nullif(c("high") - c("low"), F.lit(0.0)))
_simple("_ret", lambda: w.ratio(c("close"), c("_pc")) - 1)
_simple("_dc", lambda: c("close") - c("_pc"))
_simple("_tr", lambda: F.greatest(c("high") - c("low"), F.abs(c("high") - c("_pc")), F.abs(c("low") - c("_pc"))))
_simple("_gain", lambda: F.greatest(c("_dc"), F.lit(0.0)) + F.when(c("_dc").isNull(), None).otherwise(0.0))
_simple("_loss", lambda: F.greatest(-c("_dc"), F.lit(0.0)) + F.when(c("_dc").isNull(), None).otherwise(0.0))


def _ewm(name: str, x: str, alpha: float, least: int, why: str = "") -> None:
    """Registers an exponential mean of a column and the two helpers it needs."""
    e = w.Ewm(x, alpha, least)

    def needs(column: Column) -> Column:
        c("_n")
        c(x)
        return column

    FEATURES.add(f"{name}_term", lambda: needs(e.term()))
    FEATURES.add(name, lambda: (c(f"{name}_term"), needs(e.value(f"{name}_term")))[1], e.block, why)


for k in (20, 50, 100):
    _ewm(f"D_ema{k}", "close", 2 / (k + 1), k, "trend level")

# Wilder oscillators.
for p in (7, 14):
    _ewm(f"_gain{p}", "_gain", 1 / p, p)
    _ewm(f"_loss{p}", "_loss", 1 / p, p)

    def _rsi(p=p):
        g, l = c(f"_gain{p}"), c(f"_loss{p}")
        return F.when(l == 0, F.when(g > 0, 100.0).when(g == 0, 50.0)).when(g == 0, 0.0).otherwise(100 - 100 / (1 + F.try_divide(g, l)))

    _simple(f"D_rsi{p}", _rsi, 20 * p, "momentum oscillator")
for k in (14, 30):
    _ewm(f"D_atr{k}", "_tr", 1 / k, k, "true range")
_simple("_pdm", lambda: F.when((c("high") - c("_ph") > c("_pl") - c("low")) & (c("high") > c("_ph")), c("high") - c("_ph")).otherwise(0.0))
_simple("_mdm", lambda: F.when((c("_pl") - c("low") > c("high") - c("_ph")) & (c("_pl") > c("low")), c("_pl") - c("low")).otherwise(0.0))
_ewm("_pdm14", "_pdm", 1 / 14, 14)
_ewm("_mdm14", "_mdm", 1 / 14, 14)
_simple("D_pdi14", lambda: 100 * w.ratio(c("_pdm14"), c("D_atr14")), 280, "upward directional share")
_simple("D_mdi14", lambda: 100 * w.ratio(c("_mdm14"), c("D_atr14")), 280, "downward directional share")
_simple("_dx", lambda: 100 * w.ratio(F.abs(c("D_pdi14") - c("D_mdi14")), c("D_pdi14") + c("D_mdi14")))
_ewm("D_adx14", "_dx", 1 / 14, 14, "trend strength")

_ewm("_ema12", "close", 2 / 13, 12)
_ewm("_ema26", "close", 2 / 27, 26)
_simple("D_macd", lambda: c("_ema12") - c("_ema26"), 130, "fast less slow trend")
_ewm("D_macd_signal", "D_macd", 0.2, 9, "smoothed macd")
_simple("D_macd_hist", lambda: c("D_macd") - c("D_macd_signal"), 180, "macd less signal")
_simple("_mfv", lambda: ((c("close") - c("low")) - (c("high") - c("close"))) / c("_nz") * c("volume"))
_simple("D_cmf20", lambda: w.ratio(w.roll(F.sum, c("_mfv"), 20), w.roll(F.sum, c("volume"), 20)), 20, "money flow")

# Previous bar, pivots, candles.
_simple("D_prev_high", lambda: c("_ph") + 0, 2, "previous high")
_simple("D_prev_low", lambda: c("_pl") + 0, 2, "previous low")
_simple("D_prev_close", lambda: c("_pc") + 0, 2, "previous close")
_simple("D_inside_day", lambda: w.flag((c("high") <= c("_ph")) & (c("low") >= c("_pl"))), 2, "inside bar")
_simple("D_prev_inside_day", lambda: F.coalesce(w.lag(c("D_inside_day")), F.lit(0)), 3, "previous inside bar")
_simple("D_cpr_pivot", lambda: (c("high") + c("low") + c("close")) / 3, 1, "pivot")
_simple("D_cpr_bc", lambda: (c("high") + c("low")) / 2, 1, "central range, bottom")
_simple("D_cpr_tc", lambda: 2 * c("D_cpr_pivot") - c("D_cpr_bc"), 1, "central range, top")
_simple("D_support1", lambda: 2 * c("D_cpr_pivot") - c("high"), 1, "support")
_simple("D_resistance1", lambda: 2 * c("D_cpr_pivot") - c("low"), 1, "resistance")
_simple("D_support2", lambda: c("D_cpr_pivot") - c("_rng"), 1, "second support")
_simple("D_resistance2", lambda: c("D_cpr_pivot") + c("_rng"), 1, "second resistance")
_simple("D_cpr_width_pct", lambda: w.ratio(c("D_cpr_tc") - c("D_cpr_bc"), c("close")) * 100, 1, "central range width")
_simple("_pbc", lambda: w.lag(c("D_cpr_bc")))
_simple("_ptc", lambda: w.lag(c("D_cpr_tc")))


def relation(base_bc, base_tc, other_bc, other_tc) -> Column:
    """How a range lies to a base range: Above, Below, Inside or Overlap; null if either is unknown."""
    known = base_bc.isNotNull() & base_tc.isNotNull() & other_bc.isNotNull() & other_tc.isNotNull()
    inside = (other_bc >= base_bc) & (other_tc <= base_tc)
    return F.when(known, F.when(other_bc > base_tc, "Above").when(other_tc < base_bc, "Below").when(inside, "Inside").otherwise("Overlap"))


RELATION_CODE = {"Above": 1, "Below": -1}
TREND_CODE = {"uptrend": 1, "downtrend": -1}


def encode(x: Column, codes: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, v in codes.items():
        out = F.when(x == k, v).otherwise(out)
    return F.coalesce(out, F.lit(0)).cast("int")


_simple("D_cpr_vs_yday", lambda: relation(c("_pbc"), c("_ptc"), c("D_cpr_bc"), c("D_cpr_tc")), 2, "central range against the previous one")
_simple("D_tmr_cpr_vs_today_code", lambda: encode(c("D_cpr_vs_yday"), RELATION_CODE), 2, "the same as a number")
_simple("D_hh", lambda: w.flag(c("high") > c("_ph")), 2, "higher high")
_simple("D_hl", lambda: w.flag(c("low") > c("_pl")), 2, "higher low")
_simple("D_lh", lambda: w.flag(c("high") < c("_ph")), 2, "lower high")
_simple("D_ll", lambda: w.flag(c("low") < c("_pl")), 2, "lower low")
_simple("D_daily_trend", lambda: F.when(c("D_hh") == 1, 1).when(c("D_lh") == 1, -1).otherwise(0), 2, "daily structure")
_simple("D_structure_trend", lambda: F.when((c("D_hh") == 1) & (c("D_hl") == 1), "uptrend").when((c("D_lh") == 1) & (c("D_ll") == 1), "downtrend").otherwise("range"), 2, "structure")
_simple("D_structure_trend_code", lambda: encode(c("D_structure_trend"), TREND_CODE), 2, "structure as a number")
_simple("D_oli", lambda: (c("open") - c("low")) / c("_nz"), 1, "open within the range")
_simple("D_day_type", lambda: F.when(c("open") > c("D_cpr_tc"), "bullish").when(c("open") < c("D_cpr_bc"), "bearish").otherwise("inside"), 1, "open against the central range")
_simple("D_body_ratio", lambda: (c("close") - c("open")) / c("_nz"), 1, "candle body")
_simple("D_wick_skew", lambda: w.clip(((c("high") - F.greatest(c("open"), c("close"))) - (F.least(c("open"), c("close")) - c("low"))) / c("_nz"), -1, 1), 1, "candle wicks")
for _flag in ("hh", "hl", "lh", "ll"):
    _simple(f"_{_flag}_run", lambda f=_flag: w.run_group(c(f"D_{f}") == 1))
    _simple(f"D_{_flag}_run", lambda f=_flag: (c(f"_{f}_run"), w.streak(c(f"D_{f}") == 1, f"_{f}_run"))[1], 20, "length of the run")
_simple("_prng", lambda: w.lag(c("_rng")))
_simple("D_nr_expand", lambda: w.flag(c("_rng") > c("_prng")), 2, "range expands")

# Narrow ranges.
_simple("_nr", lambda: c("_rng") < w.prior(F.min, c("_rng"), 6))
_simple("_nr_run", lambda: w.run_group(c("_nr")))
_simple("D_nr_length", lambda: (c("_nr_run"), w.streak(c("_nr"), "_nr_run"))[1], 26, "narrow ranges in a row")
_simple("D_nr_day", lambda: F.coalesce(*[F.when(c("_rng") < w.prior(F.min, c("_rng"), k - 1), k) for k in range(20, 4, -1)], F.lit(0)), 20, "longest span the range is narrowest of")

# Averages and their relations.
for k in (5, 20, 50, 200):
    _simple(f"D_sma{k}", lambda k=k: w.roll(F.avg, c("close"), k), k, "average level")
_simple("D_rsi7_gt_rsi14", lambda: w.flag(c("D_rsi7") > c("D_rsi14")), 280, "short against long momentum")
_simple("D_ema_stack_20_50_100", lambda: w.flag((c("D_ema20") > c("D_ema50")) & (c("D_ema50") > c("D_ema100"))), 100, "ordered trends")
_simple("_pema20", lambda: w.lag(c("D_ema20")))
_simple("D_ema20_angle_deg", lambda: F.degrees(F.atan(w.ratio(c("D_ema20") - c("_pema20"), c("_pema20")))), 21, "trend angle")
_simple("D_atr_ratio_14_30", lambda: w.ratio(c("D_atr14"), c("D_atr30")), 30, "volatility term structure")
_simple("D_range_to_atr14", lambda: w.ratio(c("_rng"), c("D_atr14")), 14, "range against volatility")
_simple("D_golden_regime", lambda: w.flag((c("close") > c("D_sma200")) & (c("D_sma50") > c("D_sma200"))), 200, "above the long averages")

# Volume.
_simple("_signed", lambda: F.coalesce(F.signum(c("_dc")), F.lit(0.0)) * c("volume"))
_simple("D_obv", lambda: w.cumulative(F.sum, c("_signed")), 1, "on-balance volume")
_simple("_pobv", lambda: w.lag(c("D_obv")))
_simple("D_obv_slope", lambda: c("D_obv") - c("_pobv"), 2, "change of on-balance volume")
_simple("D_price_and_obv_rising", lambda: w.flag((c("close") > c("_pc")) & (c("D_obv") > c("_pobv"))), 2, "price and volume rise together")
_simple("D_dollar_vol", lambda: c("close") * c("volume"), 1, "turnover")
for k in (20, 50, 252):
    _simple(f"D_dvol_z{k}", lambda k=k: w.zscore(c("D_dollar_vol"), k), k, "turnover, standardised")
for k in (20, 50):

    def _surge(k=k):
        limit = w.roll(F.avg, c("volume"), k) + 2 * w.roll(F.stddev_samp, c("volume"), k)
        return F.when(c("volume").isNotNull() & limit.isNotNull(), (c("volume") > limit).cast("int"))

    _simple(f"D_vol_surge_{k}", _surge, k, "volume surge; null is unknown")

# Calendar.
_simple("D_dow", lambda: F.weekday(c("session_date")), 1, "weekday")
for k in range(7):
    _simple(f"DOW_{k}", lambda k=k: (F.weekday(c("session_date")) == k).cast("int"), 1, "weekday")

# Bands, channels, volatility.
_simple("_sd20", lambda: w.roll(F.stddev_samp, c("close"), 20))
_simple("D_bb_pctB_20", lambda: w.clip(w.ratio(c("close") - (c("D_sma20") - 2 * c("_sd20")), 4 * c("_sd20")), -5, 5), 20, "place in the band")
_simple("D_bb_bw_20", lambda: w.ratio(4 * c("_sd20"), c("D_sma20")), 20, "width of the band")
_positive = lambda a, b: F.ln(w.ratio(a, b))  # noqa: E731  null for ratios that aren't positive
_simple("_yz", lambda: F.pow(_positive(c("open"), c("_pc")), 2) + 0.34 * F.pow(_positive(c("close"), c("open")), 2) + 0.66 * (_positive(c("high"), c("open")) * _positive(c("high"), c("close")) + _positive(c("low"), c("open")) * _positive(c("low"), c("close"))))
for k in (20, 50):
    _simple(f"_yz{k}", lambda k=k: w.roll(F.avg, c("_yz"), k))
    _simple(f"D_vol_yz_{k}", lambda k=k: F.when(c(f"_yz{k}") >= 0, F.sqrt(c(f"_yz{k}"))), k + 1, "open-high-low-close volatility")
    _simple(f"_hi{k}", lambda k=k: w.prior(F.max, c("high"), k))
    _simple(f"_lo{k}", lambda k=k: w.prior(F.min, c("low"), k))
    _simple(f"D_donch_pos_{k}", lambda k=k: w.clip(w.ratio(c("close") - c(f"_lo{k}"), c(f"_hi{k}") - c(f"_lo{k}")), -1, 2), k + 1, "place in the channel")
    _simple(f"D_breakout_high_{k}", lambda k=k: w.flag(c("high") > c(f"_hi{k}")), k + 1, "breakout upward")
    _simple(f"D_breakout_low_{k}", lambda k=k: w.flag(c("low") < c(f"_lo{k}")), k + 1, "breakout downward")
_simple("D_days_since_boh_20", lambda: (c("_n"), w.days_since(c("D_breakout_high_20") == 1))[1], 21, "sessions since a breakout upward")
_simple("D_days_since_bol_20", lambda: (c("_n"), w.days_since(c("D_breakout_low_20") == 1))[1], 21, "sessions since a breakout downward")
_simple("D_atr_pct", lambda: w.ratio(c("D_atr14"), c("close")) * 100, 14, "volatility in percent")
_simple("D_range_pct", lambda: w.ratio(c("_rng"), c("close")) * 100, 1, "range in percent")
_simple("D_gap_pct", lambda: (w.ratio(c("open"), c("_pc")) - 1) * 100, 2, "gap in percent")
for _name, _x in (("D_rsi14_z252", "D_rsi14"), ("D_atr_pct_z252", "D_atr_pct"), ("D_vol_z252", "volume"), ("D_ema20_angle_z252", "D_ema20_angle_deg")):
    _simple(_name, lambda x=_x: w.zscore(c(x), 252), 252, "standardised over a year")
_simple("D_rsi14_obv_x", lambda: c("D_rsi14") * c("D_obv_slope"), 280, "momentum times flow")
_simple("D_rsi7_obv_x", lambda: c("D_rsi7") * c("D_obv_slope"), 140, "momentum times flow")
_simple("_c5", lambda: w.lag(c("close"), 5))
_simple("_ret5", lambda: (w.ratio(c("close"), c("_c5")) - 1) * 100)
_simple("D_ret_5d_roll_std", lambda: w.roll(F.stddev_samp, c("_ret5"), 50), 55, "spread of five-session returns")
for k in (20, 50):
    _simple(f"D_close_roll_slope_{k}", lambda k=k: (c("_n"), w.slope(c("close"), k))[1], k, "slope")
_simple("_prsi14", lambda: w.lag(c("D_rsi14")))
_simple("Comb_RSIslopePos__ADX_15_25", lambda: w.flag((c("D_rsi14") > c("_prsi14")) & c("D_adx14").between(15, 25)), 280, "rising momentum in a young trend")
_simple("Comb_GapUp__CPR_Tmr_Above", lambda: w.flag((c("D_gap_pct") > 0) & (c("D_tmr_cpr_vs_today_code") == 1)), 2, "gap up above the range")
_simple("Comb_GapDown__CPR_Tmr_Below", lambda: w.flag((c("D_gap_pct") < 0) & (c("D_tmr_cpr_vs_today_code") == -1)), 2, "gap down below the range")
_simple("Comb_ATRlow__EMA20pos", lambda: w.flag((c("D_atr_pct") <= 2) & (c("D_ema20_angle_deg") > 0)), 21, "calm and rising")
_simple("Comb_ATRhigh__EMA20neg", lambda: w.flag((c("D_atr_pct") >= 4) & (c("D_ema20_angle_deg") < 0)), 21, "wild and falling")
_simple("D_compress_state", lambda: w.ts_rank(c("D_bb_bw_20"), 50, 10), 70, "rank of the band's width")
for k, _n in ((20, "20"), (252, "52w")):
    _simple(f"_hx{k}", lambda k=k: w.prior(F.max, c("high"), k))
    _simple(f"_lx{k}", lambda k=k: w.prior(F.min, c("low"), k))
    _simple(f"D_dist_from_{_n}h", lambda k=k: w.ratio(c("close") - c(f"_hx{k}"), c("D_atr14")), k + 1, "distance from the high")
    _simple(f"D_dist_from_{_n}l", lambda k=k: w.ratio(c("close") - c(f"_lx{k}"), c("D_atr14")), k + 1, "distance from the low")
_simple("_mid", lambda: (c("high") + c("low")) / 2)
_simple("_mid10", lambda: (c("_n"), w.slope(c("_mid"), 10))[1])
_simple("D_midpoint_slope", lambda: w.ratio(c("_mid10"), c("D_atr14")), 14, "slope of the midpoint")
_simple("_slope5", lambda: (c("_n"), w.slope(c("close"), 5))[1])
_simple("D_slope_stability", lambda: w.roll(F.stddev_samp, c("_slope5"), 20, 5), 25, "spread of slopes")
_simple("D_pos_in_52w_range", lambda: w.clip(w.ratio(c("close") - c("_lx252"), c("_hx252") - c("_lx252")), -0.5, 1.5), 253, "place in the year's range")
_simple("D_drawdown_252", lambda: w.ratio(c("close"), w.roll(F.max, c("close"), 252)) - 1, 252, "drawdown")
_simple("D_intraday_ret_pct", lambda: w.ratio(c("close") - c("open"), c("open")) * 100, 1, "return of the session")
_simple("D_overnight_share", lambda: w.ratio(c("D_gap_pct"), F.abs(c("D_gap_pct")) + F.abs(c("D_intraday_ret_pct"))), 2, "share of the gap")
_simple("_illiq", lambda: w.ratio(F.abs(c("_ret")), c("D_dollar_vol")) * 1e7)
for k in (20, 60):
    _simple(f"D_amihud_{k}", lambda k=k: w.roll(F.avg, c("_illiq"), k), k + 1, "price impact")
    _simple(f"D_realvol_{k}", lambda k=k: w.roll(F.stddev_samp, c("_ret"), k) * (252**0.5) * 100, k + 1, "realised volatility")
_simple("D_realvol_ratio_20_60", lambda: w.ratio(c("D_realvol_20"), c("D_realvol_60")), 61, "volatility term structure")
_simple("D_ret_skew_60", lambda: w.skew(c("_ret"), 60), 61, "asymmetry of returns")
_simple("D_ret_kurt_60", lambda: w.kurt(c("_ret"), 60), 61, "tails of returns")
_simple("_down", lambda: F.coalesce(F.least(c("_ret"), F.lit(0.0)) + F.when(c("_ret").isNotNull(), 0.0), F.lit(0.0)))
_simple("_up", lambda: F.coalesce(F.greatest(c("_ret"), F.lit(0.0)) + F.when(c("_ret").isNotNull(), 0.0), F.lit(0.0)))
_simple("_down2", lambda: c("_down") * c("_down"))
_simple("D_downside_dev_60", lambda: F.sqrt(w.roll(F.avg, c("_down2"), 60)) * (252**0.5) * 100, 61, "downside deviation")
_simple("D_upside_vol_ratio", lambda: w.ratio(w.roll(F.stddev_samp, c("_up"), 60), w.roll(F.stddev_samp, c("_down"), 60)), 61, "upside against downside")
_simple("_up5", lambda: F.coalesce(c("_ret") >= 0.05, F.lit(False)))
_simple("_up5n", lambda: c("_up5").cast("double"))
_simple("D_days_since_5pct_up", lambda: (c("_n"), w.days_since(c("_up5")))[1], 2, "sessions since a jump")
for k in (60, 252):
    _simple(f"D_n_5pct_up_{k}", lambda k=k: w.roll(F.sum, c("_up5n"), k), k + 1, "jumps")

# Derived rolling statistics.
for _x, _tail in (("D_slope_stability", (("rmean50", 12), ("rstd10", 3), ("rstd20", 5))), ("D_body_ratio", (("rmean50", 12), ("rmean20", 5))), ("D_close_roll_slope_20", (("rstd20", 5), ("rstd10", 3))), ("D_macd_hist", (("rstd10", 3),)), ("D_donch_pos_50", (("rmean50", 12),)), ("D_donch_pos_20", (("rmean50", 12),)), ("D_cmf20", (("rmean50", 12),))):
    for _t, _least in _tail:
        _simple(f"{_x}_{_t}", lambda x=_x, t=_t, least=_least: w.roll(F.avg if "mean" in t else F.stddev_samp, c(x), int(t[-2:]), least), int(_t[-2:]), "rolling statistic")
for k in (20, 50):
    _simple(f"D_donch_pos_{k}_lag5", lambda k=k: w.lag(c(f"D_donch_pos_{k}"), 5), k + 6, "earlier place in the channel")
for k in (1, 5):
    _simple(f"_mdi_lag{k}", lambda k=k: w.lag(c("D_mdi14"), k))
    _simple(f"D_mdi14_diff{k}", lambda k=k: c("D_mdi14") - c(f"_mdi_lag{k}"), 280, "change of the downward share")
_simple("D_mdi14_rrank10", lambda: w.ts_rank(c("D_mdi14"), 10, 3), 290, "rank of the downward share")
_simple("D_mdi14_rrank20", lambda: w.ts_rank(c("D_mdi14"), 20, 5), 300, "rank of the downward share")

# Alphas: price and volume relations, some over expanding ranks.
_lag = lambda name, x, n: _simple(name, lambda: w.lag(c(x), n))
for _x in ("open", "volume", "high", "close"):
    FEATURES.add_rank(f"_x_{_x}", _x)
_simple("D_WQ_3", lambda: -w.rolling_corr(c("_x_open"), c("_x_volume"), 10, 5), 60, "ranked open against ranked volume")
_simple("D_WQ_6", lambda: -w.rolling_corr(c("open"), c("volume"), 10), 10, "open against volume")
_simple("_dv", lambda: c("volume") - w.lag(c("volume")))
_simple("D_WQ_12", lambda: F.signum(c("_dv")) * -c("_dc"), 2, "volume change against price change")
_simple("_cov13", lambda: w.rolling_cov(c("_x_close"), c("_x_volume"), 5, 3))
_simple("_cov16", lambda: w.rolling_cov(c("_x_high"), c("_x_volume"), 5, 3))
for _x in ("13", "16"):
    FEATURES.add_rank(f"_x_cov{_x}", f"_cov{_x}")
_simple("D_WQ_13", lambda: -c("_x_cov13"), 60, "ranked covariance of close and volume")
_simple("D_WQ_16", lambda: -c("_x_cov16"), 60, "ranked covariance of high and volume")
_lag("_c7", "close", 7)
_simple("_c_c7", lambda: c("close") - c("_c7"))
_lag("_c_c7_5", "_c_c7", 5)
_simple("_ret250", lambda: 1 + w.roll(F.sum, c("_ret"), 250, 50))
FEATURES.add_rank("_x_ret250", "_ret250")
_simple("D_WQ_19", lambda: -F.signum((c("_c_c7") - c("_c_c7_5")) + (c("close") - c("_c5"))) * (1 + c("_x_ret250")), 250, "short reversal in a long trend")
for _n, _x in (("h", "_ph"), ("c", "_pc"), ("l", "_pl")):
    _simple(f"_o_{_n}", lambda x=_x: c("open") - c(x))
    FEATURES.add_rank(f"_x_o_{_n}", f"_o_{_n}")
_simple("D_WQ_20", lambda: -c("_x_o_h") * c("_x_o_c") * c("_x_o_l"), 60, "open against yesterday")
_lag("_h2", "high", 2)
_simple("_h20", lambda: w.roll(F.avg, c("high"), 20, 10))
_simple("D_WQ_23", lambda: F.when(c("_h20") < c("high"), -(c("high") - c("_h2"))).otherwise(0.0), 20, "reversal after a high")
_simple("_ts5_v", lambda: w.ts_rank(c("volume"), 5))
_simple("_ts5_h", lambda: w.ts_rank(c("high"), 5))
_simple("_corr26", lambda: w.rolling_corr(c("_ts5_v"), c("_ts5_h"), 5, 5))
_simple("D_WQ_26", lambda: -w.roll(F.max, c("_corr26"), 3), 14, "ranked volume against ranked high")
_simple("_neg_d5", lambda: c("close") - c("_c5"))
FEATURES.add_rank("_r29", "_neg_d5")
_simple("_x29a", lambda: -c("_r29"))
FEATURES.add_rank("_x29b", "_x29a")
FEATURES.add_rank("D_WQ_29", "_x29b", 60, "ranked reversal")
_simple("_oc", lambda: w.ratio(c("open"), c("close")) - 1)
FEATURES.add_rank("D_WQ_33", "_oc", 60, "ranked open against close")
_simple("_chl", lambda: c("close") + c("high") - c("low"))
_simple("_ts32_v", lambda: w.ts_rank(c("volume"), 32))
_simple("_ts16_chl", lambda: w.ts_rank(c("_chl"), 16))
_simple("_ts32_r", lambda: w.ts_rank(c("_ret"), 32))
_simple("D_WQ_35", lambda: c("_ts32_v") * (1 - c("_ts16_chl")) * (1 - c("_ts32_r")), 33, "volume against price and return")
_simple("_ts10_c", lambda: w.ts_rank(c("close"), 10))
FEATURES.add_rank("_x38a", "_ts10_c")
_simple("_co", lambda: w.ratio(c("close"), c("open")))
FEATURES.add_rank("_x38b", "_co")
_simple("D_WQ_38", lambda: -c("_x38a") * c("_x38b"), 60, "ranked close")
_simple("_sd10h", lambda: w.roll(F.stddev_samp, c("high"), 10, 5))
FEATURES.add_rank("_x40", "_sd10h")
_simple("_corr40", lambda: w.rolling_corr(c("high"), c("volume"), 10))
_simple("D_WQ_40", lambda: -c("_x40") * c("_corr40"), 60, "spread of highs against volume")
_simple("D_WQ_41", lambda: F.when(c("high") * c("low") >= 0, F.sqrt(c("high") * c("low"))) - (c("high") + c("low") + c("close")) / 3, 1, "geometric against arithmetic middle")
_simple("D_WQ_44", lambda: -w.rolling_corr(c("high"), c("_x_volume"), 5, 5), 60, "high against ranked volume")

# Weeks and months.
_simple("_week", lambda: w.week_end())
_simple("_month", lambda: w.month_start())


def _weekly_vpoc() -> Column:
    """Price with the most volume in the current week so far: fifty bins between the lowest and the highest
    typical price, the middle of the first fullest one."""
    frame = Window.partitionBy(w.KEY, "_week").orderBy(w.TIME).rowsBetween(Window.unboundedPreceding, 0)
    c("_week")
    bars = F.collect_list(F.when(c("D_cpr_pivot").isNotNull() & c("volume").isNotNull(), F.struct(c("D_cpr_pivot").alias("p"), c("volume").alias("v")))).over(frame)
    low, high = F.array_min(F.transform(bars, lambda b: b["p"])), F.array_max(F.transform(bars, lambda b: b["p"]))
    width = (high - low) / 50
    place = lambda b: F.least(F.greatest(F.floor(F.try_divide(b["p"] - low, width)), F.lit(0)), F.lit(49))
    weights = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda i: F.aggregate(F.filter(bars, lambda b: place(b) == i), F.lit(0.0), lambda acc, b: acc + b["v"]))
    best = F.array_position(weights, F.array_max(weights)) - 1
    return F.when(F.size(bars) > 0, F.when(high == low, low).otherwise(low + (best + 0.5) * width))


_simple("D_weekly_vpoc", _weekly_vpoc, 5, "fullest price of the week so far")


def features(bars: DataFrame, names: Iterable[str] | None = None, drop_helpers: bool = True) -> DataFrame:
    """Bars with the named features (all by default) and the warm-up flag."""
    wanted = [n for n in FEATURES if not n.startswith("_") and not n.endswith("_term")] if names is None else list(names)
    out = FEATURES.with_columns(bars, [*wanted, "_n"])
    out = out.withColumn("D_is_warmup", (F.col("_n") <= WARMUP).cast("int"))
    return out.select(*bars.columns, *wanted, "D_is_warmup") if drop_helpers else out


def period_trend(bars: DataFrame, period: Column, out: str) -> DataFrame:
    """1, -1 or 0: the running high of the current period against the highest of the previous observed one."""
    b = bars.withColumn("_p", period)
    tops = b.groupBy("symbol", "_p").agg(F.max("high").alias("_top"))
    tops = tops.withColumn("_last", F.lag("_top").over(Window.partitionBy("symbol").orderBy("_p"))).drop("_top")
    running = F.max("high").over(Window.partitionBy("symbol", "_p").orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0))
    b = b.withColumn("_run", running).join(tops, ["symbol", "_p"])
    return b.withColumn(out, F.when(F.col("_run") > F.col("_last"), 1).when(F.col("_run") < F.col("_last"), -1).otherwise(0)).drop("_p", "_run", "_last")


def weekly(bars: DataFrame) -> DataFrame:
    """Week bars: last close, highest high, lowest low and volume of each observed Saturday-to-Friday week."""
    return bars.groupBy("symbol", w.week_end().alias("week")).agg(F.max_by("close", "session_date").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), F.sum("volume").alias("volume"))


def weekly_features(bars: DataFrame) -> DataFrame:
    """W_ret_4w, W_ret_13w, W_close_pos and W_vol_vs_4w of the last completed observed week."""
    s = Window.partitionBy("symbol").orderBy("week")
    wk = weekly(bars)
    past = lambda n: F.lag("close", n).over(s)
    mean4 = F.when(F.count("volume").over(s.rowsBetween(-4, -1)) >= 2, F.avg("volume").over(s.rowsBetween(-4, -1)))
    weeks = F.count("*").over(Window.partitionBy("symbol"))
    wk = wk.select("symbol", "week", weeks.alias("_weeks"), ((w.ratio("close", past(4)) - 1) * 100).alias("r4"), ((w.ratio("close", past(13)) - 1) * 100).alias("r13"), w.clip(w.ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")), 0, 1).alias("pos"), w.ratio(F.col("volume"), mean4).alias("vol"))
    known = F.col("_weeks") >= 5
    shifted = wk.select("symbol", F.col("week").alias("_week"), *[F.when(known, F.lag(x).over(s)).alias(y) for x, y in (("r4", "W_ret_4w"), ("r13", "W_ret_13w"), ("pos", "W_close_pos"), ("vol", "W_vol_vs_4w"))])
    return bars.withColumn("_week", w.week_end()).join(shifted, ["symbol", "_week"], "left").drop("_week")


def prevalence(df: DataFrame, columns: list[str], most: int = 10) -> DataFrame:
    """For each column of at most `most` distinct values: n, distinct values, modal value and share, null share."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in columns])).alias("x")).select("x.*")
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("k"))
    out = counts.groupBy("feature").agg(
        F.sum("k").alias("n"), F.count("value").alias("n_unique"), F.max(F.when(F.col("value").isNotNull(), F.col("k"))).alias("modal"),
        F.max(F.when(F.col("value").isNotNull(), F.struct(F.col("k"), (-F.col("value")).alias("v")))).alias("top"), F.sum(F.when(F.col("value").isNull(), F.col("k")).otherwise(0)).alias("nulls"),
    )
    return out.filter(F.col("n_unique") <= most).select("feature", "n", "n_unique", (-F.col("top.v")).alias("modal_value"), F.try_divide(F.col("modal").cast("double"), F.col("n")).alias("modal_share"), (F.col("nulls") / F.col("n")).alias("null_share"))
