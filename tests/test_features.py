import math

import numpy as np
import pandas as pd
import pytest
from scenarios import series

from meridion.functions import windows as w
from meridion.operators import leaks
from meridion.operators import features as fx
from meridion.operators.features import FEATURES, features
from meridion.operators.labels import base_labels, path_labels
from pyspark.sql import functions as F

N = 400


@pytest.fixture(scope="module")
def frame():
    return pd.DataFrame(series("A", N, 1), columns=["symbol", "session_date", "open", "high", "low", "close", "volume"])


def got(spark, bars, rows, names):
    return FEATURES.with_columns(bars(rows), names).orderBy("symbol", "session_date").toPandas()


def wilder(x, p):
    return pd.Series(x).ewm(alpha=1 / p, adjust=False, min_periods=p).mean()


def test_exponential_means(spark, bars, frame):
    rows = series("A", N, 1)
    out = got(spark, bars, rows, ["D_ema20", "D_macd_signal", "D_rsi14", "D_atr14", "D_adx14"])
    c, h, l = frame["close"], frame["high"], frame["low"]
    assert np.allclose(out["D_ema20"], c.ewm(span=20, adjust=False, min_periods=20).mean(), rtol=1e-9, equal_nan=True)
    macd = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
    assert np.allclose(out["D_macd_signal"], macd.ewm(span=9, adjust=False, min_periods=9).mean(), rtol=1e-7, atol=1e-9, equal_nan=True)
    d = c.diff()
    g, s = wilder(d.clip(lower=0), 14), wilder(-d.clip(upper=0), 14)
    assert np.allclose(out["D_rsi14"], 100 - 100 / (1 + g / s), rtol=1e-8, equal_nan=True)
    tr = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1)
    atr = wilder(tr, 14)
    assert np.allclose(out["D_atr14"], atr, rtol=1e-9, equal_nan=True)
    up, down = h.diff(), -l.diff()
    p, m = wilder(np.where((up > down) & (up > 0), up, 0.0), 14), wilder(np.where((down > up) & (down > 0), down, 0.0), 14)
    pdi, mdi = 100 * p / atr, 100 * m / atr
    adx = wilder(100 * (pdi - mdi).abs() / (pdi + mdi), 14)
    assert np.allclose(out["D_adx14"], adx, rtol=1e-8, equal_nan=True)
    assert out["D_adx14"].first_valid_index() == 26


def test_long_series_don_t_overflow(spark):
    n = 20_000
    df = spark.range(n).select(F.lit("A").alias("symbol"), F.expr("date_add(date'1950-01-01', cast(id as int))").alias("session_date"), (F.col("id") % 97).cast("double").alias("close"), (F.col("id") + 1).cast("int").alias("_n"))
    e = w.Ewm("close", 1 / 7, 7)
    out = df.withColumn("t", e.term()).withColumn("y", e.value("t")).orderBy("session_date").toPandas()
    want = out["close"].ewm(alpha=1 / 7, adjust=False, min_periods=7).mean()
    assert np.allclose(out["y"], want, rtol=1e-9, equal_nan=True)


def test_ranks_streaks_and_moments(spark, bars, frame):
    rows = series("A", N, 1)
    out = got(spark, bars, rows, ["_x_close", "_ts10_c", "D_hh_run", "D_days_since_boh_20", "D_ret_skew_60", "D_ret_kurt_60", "D_close_roll_slope_20", "D_nr_day"])
    c, h = frame["close"], frame["high"]
    rank = [np.nan if i < 59 else ((c[: i + 1] < c[i]).sum() + ((c[: i + 1] == c[i]).sum() + 1) / 2) / (i + 1) for i in range(N)]
    assert np.allclose(out["_x_close"], rank, atol=1e-12, equal_nan=True)
    assert np.allclose(out["_ts10_c"], c.rolling(10).rank(pct=True), atol=1e-12, equal_nan=True)
    run, since, last = [], [], None
    for i in range(N):
        run.append((run[-1] + 1 if run else 1) if i and h[i] > h[i - 1] else 0)
        if i >= 20 and h[i] > h[i - 20 : i].max():
            last = i
        since.append(0 if last is None else i - last)
    assert out["D_hh_run"].tolist() == run and out["D_days_since_boh_20"].tolist() == since
    r = c.pct_change()
    assert np.allclose(out["D_ret_skew_60"], r.rolling(60).skew(), rtol=1e-6, atol=1e-9, equal_nan=True)
    assert np.allclose(out["D_ret_kurt_60"], r.rolling(60).kurt(), rtol=1e-5, atol=1e-8, equal_nan=True)
    slope = [np.nan if i < 19 else np.polyfit(range(20), c[i - 19 : i + 1], 1)[0] for i in range(N)]
    assert np.allclose(out["D_close_roll_slope_20"], slope, rtol=1e-6, atol=1e-9, equal_nan=True)
    rng = (frame["high"] - frame["low"]).to_numpy()
    want = [max((k for k in range(5, 21) if i >= k - 1 and rng[i] < rng[i - k + 1 : i].min()), default=0) for i in range(N)]
    assert out["D_nr_day"].tolist() == want


def test_flat_and_monotone_series(spark, bars):
    flat = [("F", d, 10.0, 10.0, 10.0, 10.0, 5.0) for _, d, *_ in series("x", 60, 1)]
    up = [("U", d, 10.0 + i, 10.5 + i, 9.5 + i, 10.2 + i, 5.0) for i, (_, d, *_) in enumerate(series("x", 60, 1))]
    out = got(spark, bars, flat + up, ["D_rsi14", "D_atr14", "D_cmf20", "D_bb_pctB_20"])
    f, u = out[out.symbol == "F"].iloc[-1], out[out.symbol == "U"].iloc[-1]
    assert f.D_rsi14 == 50 and f.D_atr14 == 0 and math.isnan(f.D_cmf20) and math.isnan(f.D_bb_pctB_20)
    assert u.D_rsi14 == 100


def test_scale_invariance(spark, bars):
    names = ["D_rsi14", "D_bb_pctB_20", "D_donch_pos_50", "D_atr_pct", "D_vol_yz_20", "D_WQ_33", "D_ret_skew_60"]
    a, b = got(spark, bars, series("A", N, 3), names), got(spark, bars, series("A", N, 3, scale=7.3), names)
    for n in names:
        assert np.allclose(a[n], b[n], rtol=1e-6, atol=1e-8, equal_nan=True), n


def test_pathological_rows(spark, bars):
    base = series("P", 120, 4)
    rows = [list(r) for r in base]
    for i in range(30, 35):
        rows[i][2:6] = [None] * 4
    for i in range(50, 60):
        rows[i][6] = 0.0
    rows[70][5] = -1.0
    rows[71][6] = None
    rows += [list(r) for r in series("ONE", 1, 5)] + [list(r) for r in series("TWO", 2, 6)]
    names = [n for n in FEATURES if not n.startswith("_") and not n.endswith("_term") and "WQ" not in n and n != "D_weekly_vpoc"]
    out = features(bars([tuple(r) for r in rows]), names).toPandas()
    assert len(out) == len(rows)
    numbers = out.select_dtypes("number")
    assert not np.isinf(numbers.to_numpy(float, na_value=np.nan)).any()


def test_no_feature_reads_the_future(spark, bars):
    rows = series("A", 130, 7) + series("B", 130, 8)
    names = ["D_ema20", "D_rsi14", "D_adx14", "D_donch_pos_20", "D_WQ_3", "D_hh_run", "D_vol_surge_20", "D_slope_stability", "D_weekly_vpoc"]
    assert leaks.canary(bars(rows), lambda b: FEATURES.with_columns(b, names), names) == []
    assert "label_fwd_ret_5d" in leaks.canary(bars(rows), base_labels, ["label_fwd_ret_5d"])
    leaks.check_plan(features(bars(rows), names))
    assert leaks.forward_windows(base_labels(bars(rows))) != []
    with pytest.raises(ValueError):
        leaks.check_plan(bars(rows).withColumn("D_peek", w.lead("close")))
    with pytest.raises(ValueError):
        leaks.check_plan(bars(rows).withColumn("D_center", F.avg("close").over(w.series().rowsBetween(-2, 2))))


def test_labels(spark, bars):
    rows = series("A", 60, 9)
    out = path_labels(base_labels(bars(rows))).orderBy("session_date").toPandas()
    assert out["label_mfe_5d"].isna().tolist() == [False] * 55 + [True] * 5
    c, h, l = out["close"], out["high"], out["low"]
    assert out["label_mfe_5d"][10] == pytest.approx(h[11:16].max() / c[10] - 1)
    assert out["label_first_touch_5p3"].isna().tolist() == [False] * 55 + [True] * 5
    for i in range(55):
        first = 0
        for k in range(1, 6):
            if l[i + k] / c[i] - 1 <= -0.03:
                first = -1
            elif h[i + k] / c[i] - 1 >= 0.05:
                first = 1
            if first:
                break
        assert out["label_first_touch_5p3"][i] == first


def test_a_day_that_meets_both_barriers_is_the_stop(spark, bars):
    rows = [list(r) for r in series("A", 40, 10)]
    for r in rows[20:]:
        r[2:6] = [100.0, 100.0, 100.0, 100.0]
    rows[25][2:6] = [100.0, 110.0, 90.0, 100.0]
    out = path_labels(bars([tuple(r) for r in rows])).orderBy("session_date").toPandas()
    r = out.iloc[22]
    assert (r.label_first_touch_5p3, r.label_same_day_ambiguous_5p3, r.label_days_to_tp_5p3, r.label_days_to_sl_5p3) == (-1, 1, 3, 3)


LEAKS = ["s.rank(pct=True)", "s.mean()", "s.std()", "s.quantile(0.9)", "s.max()", "s.corr(t)", "s.shift(-3)", "s.diff(-1)", "s.bfill()", "s.fillna(method='bfill')", "s.rolling(20, center=True).mean()", "s.interpolate(limit_direction='both')", "s[::-1]", "df.groupby('k')['v'].rank(pct=True)", "s.resample('W').max()", "F.lead('x', 1)", "w.rowsBetween(0, 3)", "w.rowsBetween(-2, Window.unboundedFollowing)"]
CAUSAL = ["s.rolling(20).mean()", "s.expanding(min_periods=60).rank(pct=True)", "s.ewm(span=20, adjust=False).mean()", "pd.concat([s, t], axis=1).max(axis=1)", "s.shift(1)", "s.ffill()", "(s.diff() * t).cumsum()", "s.shift(-5)  # leak-free: the label", "w.rowsBetween(-19, 0)", "F.max(x)"]


def test_source_that_reads_ahead():
    find = lambda body: leaks.source_findings(f"def f(df):\n    {body}\n    return df\n")
    assert [x for x in LEAKS if not find(f"df['x'] = {x}")] == [] and [x for x in CAUSAL if find(f"df['x'] = {x}")] == []
    assert find("r = s.rolling(20)\n    df['x'] = r.mean()\n    df['y'] = r.std()") == []
    assert find("# leak-free: by session\n    df['x'] = df.groupby('t')['v'].rank()") == [] and find("# by session\n    df['x'] = df.groupby('t')['v'].rank()")
    with pytest.raises(ValueError):
        leaks.check_source("def f(s):\n    return s.shift(-1)\n")
    leaks.check_source(fx)


def test_nulls_that_mean_unknown(spark):
    a = spark.createDataFrame([(None, 1), (2, None)], "x int, y int")
    assert leaks.null_census(a, ["x", "y"]).first() == (1, 1)
    leaks.assert_nulls_kept(a, a, ["x"])
    with pytest.raises(ValueError):
        leaks.assert_nulls_kept(a, a.na.fill(0), ["x"])
