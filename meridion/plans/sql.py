"""Builds the SQL that checks the engine: the same columns, stated for another database.

Columns are SQL expressions over other columns.  They are sorted into layers like the engine's own, each
layer a common table expression.  Recursive means are folds over lists here, not scaled sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

S = "PARTITION BY symbol ORDER BY session_date"
BARS_BRAND = """SELECT p.p_brand AS symbol, date_trunc('week', l_shipdate)::DATE AS session_date,
  arg_min(l_extendedprice, o) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, arg_max(l_extendedprice, o) AS close, sum(l_quantity)::DOUBLE AS volume
  FROM (SELECT *, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS o FROM lineitem) l JOIN part p ON l_partkey = p_partkey GROUP BY 1, 2"""
BARS_NATION = """SELECT s.s_nationkey::VARCHAR AS symbol, l_shipdate::DATE AS session_date,
  arg_min(l_extendedprice, o) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, arg_max(l_extendedprice, o) AS close, sum(l_quantity)::DOUBLE AS volume
  FROM (SELECT *, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS o FROM lineitem) l JOIN supplier s ON l_suppkey = s_suppkey GROUP BY 1, 2"""
BARS_EVENT = """SELECT event_type AS symbol, ts::DATE AS session_date, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, row(ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2"""


def rows(k: int) -> str:
    return f"({S} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def before(k: int) -> str:
    return f"({S} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


CUM = f"({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, k: int, least: int | None = None, frame: str | None = None) -> str:
    frame = frame or rows(k)
    return f"CASE WHEN count({x}) OVER {frame} >= {k if least is None else least} THEN {f}({x}) OVER {frame} END"


def prior(f: str, x: str, k: int, least: int | None = None) -> str:
    return roll(f, x, k, least, before(k))


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({S})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0.0))"


def z(x: str, k: int) -> str:
    return div(f"{x} - ({roll('avg', x, k)})", f"({roll('stddev_samp', x, k)})")


def ewm(x: str, alpha: str, least: int) -> str:
    values = f"(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {CUM})"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER {CUM} >= {least} THEN list_reduce({values}, lambda a, b: a + {alpha} * (b - a), {values}[1]) END"


def rank(x: str, frame: str, least: int) -> str:
    values = f"(list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {frame})"
    return f"CASE WHEN {x} IS NOT NULL AND count({x}) OVER {frame} >= {least} THEN (len(list_filter({values}, lambda v: v < {x})) + (len(list_filter({values}, lambda v: v = {x})) + 1) / 2.0) / len({values}) END"


def xrank(x: str, least: int = 60) -> str:
    return rank(x, CUM, least)


def tsrank(x: str, k: int, least: int | None = None) -> str:
    return rank(x, rows(k), k if least is None else least)


def slope(x: str, k: int) -> str:
    return f"CASE WHEN count({x}) OVER {rows(k)} >= {k} THEN regr_slope({x}, _n) OVER {rows(k)} END"


def corr(x: str, y: str, k: int, least: int | None = None) -> str:
    f = rows(k)
    n = f"count({x} + {y}) OVER {f}"
    mx, my = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
    spread = f"(stddev_pop({mx}) OVER {f} * stddev_pop({my}) OVER {f})"
    return f"CASE WHEN {n} >= {least or k} AND {spread} > 1e-12 THEN covar_pop({mx}, {my}) OVER {f} / {spread} END"


def cov(x: str, y: str, k: int, least: int) -> str:
    return f"CASE WHEN count({x} + {y}) OVER {rows(k)} >= {max(2, least)} THEN covar_samp({x}, {y}) OVER {rows(k)} END"


def flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1 ELSE 0 END"


def clip(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {float(lo)}), {float(hi)}) END"


def streak(condition: str, group: str) -> str:
    return f"(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, {group} ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::INTEGER"


def run_group(condition: str) -> str:
    return f"sum(CASE WHEN {condition} THEN 0 ELSE 1 END) OVER {CUM}"


def days_since(condition: str) -> str:
    return f"coalesce(_n - max(CASE WHEN {condition} THEN _n END) OVER {CUM}, 0)::INTEGER"


SQL: dict[str, str] = {
    "_n": f"row_number() OVER ({S})", "_pc": lag("close"), "_ph": lag("high"), "_pl": lag("low"), "_rng": "high - low", "_nz": "nullif(high - low, 0.0)",
    "_ret": "close / nullif(_pc, 0.0) - 1", "_dc": "close - _pc", "_tr": "greatest(high - low, abs(high - _pc), abs(low - _pc))",
    "_gain": "CASE WHEN _dc IS NOT NULL THEN greatest(_dc, 0.0) END", "_loss": "CASE WHEN _dc IS NOT NULL THEN greatest(-_dc, 0.0) END",
}
for k in (20, 50, 100):
    SQL[f"D_ema{k}"] = ewm("close", f"(2.0 / {k + 1})", k)
for k in (7, 14):
    SQL[f"_gain{k}"], SQL[f"_loss{k}"] = ewm("_gain", f"(1.0 / {k})", k), ewm("_loss", f"(1.0 / {k})", k)
    SQL[f"D_rsi{k}"] = f"CASE WHEN _loss{k} = 0 THEN CASE WHEN _gain{k} > 0 THEN 100.0 ELSE 50.0 END WHEN _gain{k} = 0 THEN 0.0 ELSE 100 - 100 / (1 + _gain{k} / _loss{k}) END"
for k in (14, 30):
    SQL[f"D_atr{k}"] = ewm("_tr", f"(1.0 / {k})", k)
SQL |= {
    "_pdm": "CASE WHEN high - _ph > _pl - low AND high > _ph THEN high - _ph ELSE 0.0 END", "_mdm": "CASE WHEN _pl - low > high - _ph AND _pl > low THEN _pl - low ELSE 0.0 END",
    "_pdm14": ewm("_pdm", "(1.0 / 14)", 14), "_mdm14": ewm("_mdm", "(1.0 / 14)", 14), "D_pdi14": f"100 * {div('_pdm14', 'D_atr14')}", "D_mdi14": f"100 * {div('_mdm14', 'D_atr14')}",
    "_dx": f"100 * {div('abs(D_pdi14 - D_mdi14)', 'D_pdi14 + D_mdi14')}", "D_adx14": ewm("_dx", "(1.0 / 14)", 14),
    "_ema12": ewm("close", "(2.0 / 13)", 12), "_ema26": ewm("close", "(2.0 / 27)", 26), "D_macd": "_ema12 - _ema26", "D_macd_signal": ewm("D_macd", "0.2", 9), "D_macd_hist": "D_macd - D_macd_signal",
    "_mfv": "((close - low) - (high - close)) / _nz * volume", "D_cmf20": div(roll("sum", "_mfv", 20), f"({roll('sum', 'volume', 20)})"),
    "D_prev_high": "_ph", "D_prev_low": "_pl", "D_prev_close": "_pc", "D_inside_day": flag("high <= _ph AND low >= _pl"), "D_prev_inside_day": f"coalesce({lag('D_inside_day')}, 0)",
    "D_cpr_pivot": "(high + low + close) / 3", "D_cpr_bc": "(high + low) / 2", "D_cpr_tc": "2 * D_cpr_pivot - D_cpr_bc", "D_support1": "2 * D_cpr_pivot - high", "D_resistance1": "2 * D_cpr_pivot - low",
    "D_support2": "D_cpr_pivot - _rng", "D_resistance2": "D_cpr_pivot + _rng", "D_cpr_width_pct": f"{div('D_cpr_tc - D_cpr_bc', 'close')} * 100", "_pbc": lag("D_cpr_bc"), "_ptc": lag("D_cpr_tc"),
    "D_cpr_vs_yday": "CASE WHEN _pbc IS NULL OR _ptc IS NULL OR D_cpr_bc IS NULL OR D_cpr_tc IS NULL THEN NULL WHEN D_cpr_bc > _ptc THEN 'Above' WHEN D_cpr_tc < _pbc THEN 'Below' WHEN D_cpr_bc >= _pbc AND D_cpr_tc <= _ptc THEN 'Inside' ELSE 'Overlap' END",
    "D_tmr_cpr_vs_today_code": "CASE D_cpr_vs_yday WHEN 'Above' THEN 1 WHEN 'Below' THEN -1 ELSE 0 END",
    "D_hh": flag("high > _ph"), "D_hl": flag("low > _pl"), "D_lh": flag("high < _ph"), "D_ll": flag("low < _pl"), "D_daily_trend": "CASE WHEN D_hh = 1 THEN 1 WHEN D_lh = 1 THEN -1 ELSE 0 END",
    "D_structure_trend": "CASE WHEN D_hh = 1 AND D_hl = 1 THEN 'uptrend' WHEN D_lh = 1 AND D_ll = 1 THEN 'downtrend' ELSE 'range' END",
    "D_structure_trend_code": "CASE D_structure_trend WHEN 'uptrend' THEN 1 WHEN 'downtrend' THEN -1 ELSE 0 END",
    "D_oli": "(open - low) / _nz", "D_day_type": "CASE WHEN open > D_cpr_tc THEN 'bullish' WHEN open < D_cpr_bc THEN 'bearish' ELSE 'inside' END", "D_body_ratio": "(close - open) / _nz",
    "D_wick_skew": clip("((high - greatest(open, close)) - (least(open, close) - low)) / _nz", -1, 1), "_prng": lag("_rng"), "D_nr_expand": flag("_rng > _prng"),
    "_nr": f"_rng < ({prior('min', '_rng', 6)})", "_nr_run": run_group("_nr"), "D_nr_length": streak("_nr", "_nr_run"),
    "D_nr_day": "coalesce(" + ", ".join(f"CASE WHEN _rng < ({prior('min', '_rng', k - 1)}) THEN {k} END" for k in range(20, 4, -1)) + ", 0)",
}
for f in ("hh", "hl", "lh", "ll"):
    SQL[f"_{f}_run"], SQL[f"D_{f}_run"] = run_group(f"D_{f} = 1"), streak(f"D_{f} = 1", f"_{f}_run")
for k in (5, 20, 50, 200):
    SQL[f"D_sma{k}"] = roll("avg", "close", k)
SQL |= {
    "D_rsi7_gt_rsi14": flag("D_rsi7 > D_rsi14"), "D_ema_stack_20_50_100": flag("D_ema20 > D_ema50 AND D_ema50 > D_ema100"), "_pema20": lag("D_ema20"),
    "D_ema20_angle_deg": f"degrees(atan({div('D_ema20 - _pema20', '_pema20')}))", "D_atr_ratio_14_30": div("D_atr14", "D_atr30"), "D_range_to_atr14": div("_rng", "D_atr14"),
    "D_golden_regime": flag("close > D_sma200 AND D_sma50 > D_sma200"), "_signed": "coalesce(sign(_dc), 0) * volume", "D_obv": f"CASE WHEN _signed IS NOT NULL THEN sum(_signed) OVER {CUM} END", "_pobv": lag("D_obv"), "D_obv_slope": "D_obv - _pobv", "D_dollar_vol": "close * volume",
    "D_dow": "isodow(session_date) - 1", "_sd20": roll("stddev_samp", "close", 20), "D_bb_pctB_20": clip(div("close - (D_sma20 - 2 * _sd20)", "4 * _sd20"), -5, 5), "D_bb_bw_20": div("4 * _sd20", "D_sma20"),
    "_yz": "pow(ln(open / _pc), 2) + 0.34 * pow(ln(close / open), 2) + 0.66 * (ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close))",
}
for k in range(7):
    SQL[f"DOW_{k}"] = flag(f"isodow(session_date) - 1 = {k}")
for k in (20, 50, 252):
    SQL[f"D_dvol_z{k}"] = z("D_dollar_vol", k)
for k in (20, 50):
    limit = f"(({roll('avg', 'volume', k)}) + 2 * ({roll('stddev_samp', 'volume', k)}))"
    SQL[f"D_vol_surge_{k}"] = f"CASE WHEN volume IS NOT NULL AND {limit} IS NOT NULL THEN CASE WHEN volume > {limit} THEN 1 ELSE 0 END END"
    SQL[f"_yz{k}"], SQL[f"D_vol_yz_{k}"] = roll("avg", "_yz", k), f"CASE WHEN _yz{k} >= 0 THEN sqrt(_yz{k}) END"
    SQL[f"_hi{k}"], SQL[f"_lo{k}"] = prior("max", "high", k), prior("min", "low", k)
    SQL[f"D_donch_pos_{k}"] = clip(div(f"close - _lo{k}", f"_hi{k} - _lo{k}"), -1, 2)
    SQL[f"D_breakout_high_{k}"], SQL[f"D_breakout_low_{k}"] = flag(f"high > _hi{k}"), flag(f"low < _lo{k}")
    SQL[f"D_close_roll_slope_{k}"] = slope("close", k)
    SQL[f"D_donch_pos_{k}_lag5"] = lag(f"D_donch_pos_{k}", 5)
for name, x in (("D_rsi14_z252", "D_rsi14"), ("D_atr_pct_z252", "D_atr_pct"), ("D_vol_z252", "volume"), ("D_ema20_angle_z252", "D_ema20_angle_deg")):
    SQL[name] = z(x, 252)
SQL |= {
    "D_days_since_boh_20": days_since("D_breakout_high_20 = 1"), "D_days_since_bol_20": days_since("D_breakout_low_20 = 1"), "D_atr_pct": f"{div('D_atr14', 'close')} * 100", "D_range_pct": f"{div('_rng', 'close')} * 100", "D_gap_pct": f"({div('open', '_pc')} - 1) * 100",
    "D_rsi14_obv_x": "D_rsi14 * D_obv_slope", "D_rsi7_obv_x": "D_rsi7 * D_obv_slope", "_c5": lag("close", 5), "_ret5": f"({div('close', '_c5')} - 1) * 100", "D_ret_5d_roll_std": roll("stddev_samp", "_ret5", 50), "_prsi14": lag("D_rsi14"),
    "Comb_RSIslopePos__ADX_15_25": flag("D_rsi14 > _prsi14 AND D_adx14 BETWEEN 15 AND 25"), "Comb_GapUp__CPR_Tmr_Above": flag("D_gap_pct > 0 AND D_tmr_cpr_vs_today_code = 1"), "Comb_GapDown__CPR_Tmr_Below": flag("D_gap_pct < 0 AND D_tmr_cpr_vs_today_code = -1"),
    "Comb_ATRlow__EMA20pos": flag("D_atr_pct <= 2 AND D_ema20_angle_deg > 0"), "Comb_ATRhigh__EMA20neg": flag("D_atr_pct >= 4 AND D_ema20_angle_deg < 0"), "D_compress_state": tsrank("D_bb_bw_20", 50, 10),
    "_mid": "(high + low) / 2", "_mid10": slope("_mid", 10), "D_midpoint_slope": div("_mid10", "D_atr14"), "_slope5": slope("close", 5), "D_slope_stability": roll("stddev_samp", "_slope5", 20, 5),
    "D_pos_in_52w_range": clip(div("close - _lx252", "_hx252 - _lx252"), -0.5, 1.5), "D_drawdown_252": f"{div('close', '(' + roll('max', 'close', 252) + ')')} - 1", "D_intraday_ret_pct": f"{div('close - open', 'open')} * 100",
    "D_overnight_share": div("D_gap_pct", "abs(D_gap_pct) + abs(D_intraday_ret_pct)"), "_illiq": f"{div('abs(_ret)', 'D_dollar_vol')} * 1e7", "D_realvol_ratio_20_60": div("D_realvol_20", "D_realvol_60"),
    "D_ret_skew_60": roll("skewness", "_ret", 60), "D_ret_kurt_60": roll("kurtosis", "_ret", 60), "_down": "CASE WHEN _ret < 0 THEN _ret ELSE 0.0 END", "_up": "CASE WHEN _ret > 0 THEN _ret ELSE 0.0 END", "_down2": "_down * _down",
    "D_downside_dev_60": f"sqrt({roll('avg', '_down2', 60)}) * sqrt(252.0) * 100", "D_upside_vol_ratio": div(roll("stddev_samp", "_up", 60), f"({roll('stddev_samp', '_down', 60)})"),
    "_up5": "coalesce(_ret >= 0.05, false)", "_up5n": "CASE WHEN _up5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "D_days_since_5pct_up": days_since("_up5"),
}
for k, n in ((20, "20"), (252, "52w")):
    SQL[f"_hx{k}"], SQL[f"_lx{k}"] = prior("max", "high", k), prior("min", "low", k)
    SQL[f"D_dist_from_{n}h"], SQL[f"D_dist_from_{n}l"] = div(f"close - _hx{k}", "D_atr14"), div(f"close - _lx{k}", "D_atr14")
for k in (20, 60):
    SQL[f"D_amihud_{k}"], SQL[f"D_realvol_{k}"] = roll("avg", "_illiq", k), f"({roll('stddev_samp', '_ret', k)}) * sqrt(252.0) * 100"
for k in (60, 252):
    SQL[f"D_n_5pct_up_{k}"] = roll("sum", "_up5n", k)
for x, tail in (("D_slope_stability", (("rmean50", 12), ("rstd10", 3), ("rstd20", 5))), ("D_body_ratio", (("rmean50", 12), ("rmean20", 5))), ("D_close_roll_slope_20", (("rstd20", 5), ("rstd10", 3))), ("D_macd_hist", (("rstd10", 3),)), ("D_donch_pos_50", (("rmean50", 12),)), ("D_donch_pos_20", (("rmean50", 12),)), ("D_cmf20", (("rmean50", 12),))):
    for t, least in tail:
        SQL[f"{x}_{t}"] = roll("avg" if "mean" in t else "stddev_samp", x, int(t[-2:]), least)
for k in (1, 5):
    SQL[f"D_mdi14_diff{k}"] = f"D_mdi14 - ({lag('D_mdi14', k)})"
SQL |= {"D_mdi14_rrank10": tsrank("D_mdi14", 10, 3), "D_mdi14_rrank20": tsrank("D_mdi14", 20, 5)}
for x in ("open", "volume", "high", "close"):
    SQL[f"_x_{x}"] = xrank(x)
for n, x in (("h", "_ph"), ("c", "_pc"), ("l", "_pl")):
    SQL[f"_o_{n}"], SQL[f"_x_o_{n}"] = f"open - {x}", xrank(f"_o_{n}")
SQL |= {
    "D_WQ_3": f"-({corr('_x_open', '_x_volume', 10, 5)})", "D_WQ_6": f"-({corr('open', 'volume', 10)})", "D_WQ_12": f"sign(volume - ({lag('volume')})) * -_dc",
    "_cov13": cov("_x_close", "_x_volume", 5, 3), "_cov16": cov("_x_high", "_x_volume", 5, 3), "D_WQ_13": f"-({xrank('_cov13')})", "D_WQ_16": f"-({xrank('_cov16')})",
    "_c7": lag("close", 7), "_c_c7": "close - _c7", "_c_c7_5": lag("_c_c7", 5), "_ret250": f"1 + ({roll('sum', '_ret', 250, 50)})", "_x_ret250": xrank("_ret250"), "D_WQ_19": "-sign((_c_c7 - _c_c7_5) + (close - _c5)) * (1 + _x_ret250)",
    "D_WQ_20": "-_x_o_h * _x_o_c * _x_o_l", "_h2": lag("high", 2), "_h20": roll("avg", "high", 20, 10), "D_WQ_23": "CASE WHEN _h20 < high THEN -(high - _h2) ELSE 0.0 END",
    "_ts5_v": tsrank("volume", 5), "_ts5_h": tsrank("high", 5), "_corr26": corr("_ts5_v", "_ts5_h", 5, 5), "D_WQ_26": f"-({roll('max', '_corr26', 3)})",
    "_neg_d5": "close - _c5", "_x29a": f"-({xrank('_neg_d5')})", "_x29b": xrank("_x29a"), "D_WQ_29": xrank("_x29b"), "_oc": "open / nullif(close, 0.0) - 1", "D_WQ_33": xrank("_oc"),
    "_chl": "close + high - low", "_ts32_v": tsrank("volume", 32), "_ts16_chl": tsrank("_chl", 16), "_ts32_r": tsrank("_ret", 32), "D_WQ_35": "_ts32_v * (1 - _ts16_chl) * (1 - _ts32_r)",
    "_ts10_c": tsrank("close", 10), "_x38a": xrank("_ts10_c"), "_co": "close / nullif(open, 0.0)", "_x38b": xrank("_co"), "D_WQ_38": "-_x38a * _x38b", "_sd10h": roll("stddev_samp", "high", 10, 5), "_x40": xrank("_sd10h"),
    "_corr40": corr("high", "volume", 10), "D_WQ_40": "-_x40 * _corr40", "D_WQ_41": "sqrt(high * low) - (high + low + close) / 3", "D_WQ_44": f"-({corr('high', '_x_volume', 5, 5)})",
    "_week": "(session_date + ((12 - isodow(session_date)) % 7)::INTEGER)::DATE", "_month": "date_trunc('month', session_date)::DATE",
}
GIVEN = {"symbol", "session_date", "open", "high", "low", "close", "volume"}


def layered(base: str, wanted: Iterable[str], given: set[str] = GIVEN, extra: dict[str, str] | None = None) -> str:
    """`WITH` clause whose last table, `x`, has the base's columns and the wanted ones."""
    book = SQL | (extra or {})
    level: dict[str, int] = dict.fromkeys(given, 0)

    def visit(name: str) -> int:
        if name not in level:
            needs = {w for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", book[name]) if w in book and w not in given and w != name}
            level[name] = 1 + max((visit(n) for n in sorted(needs)), default=0)
        return level[name]

    for w in wanted:
        visit(w)
    top = max(level.values())
    out = [f"WITH l0 AS ({base})"]
    for k in range(1, top + 1):
        names = sorted(n for n, v in level.items() if v == k)
        out.append(f"l{k} AS (SELECT *, " + ", ".join(f"{book[n]} AS {n}" for n in names) + f" FROM l{k - 1})")
    out.append(f"x AS (SELECT * FROM l{top})")
    return ", ".join(out)
