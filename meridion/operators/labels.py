"""Forward outcomes.  The only columns that may look past the current row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridion.functions import windows as w

HORIZON = 5
TOUCH = 0.05
#: Target and stop of each path label, in fractions of the close or multiples of volatility.
VARIANTS = {
    "5p3": (0.05, 0.03, False),
    "3p2": (0.03, 0.02, False),
    "atr1p5_1p0": (1.5, 1.0, True),
    "atr2p0_1p0": (2.0, 1.0, True),
    "atr1p0_1p0": (1.0, 1.0, True),
}
PRIMARY = "atr1p5_1p0"


def simple_atr_pct(k: int = 14) -> list[tuple[str, Column]]:
    """Two layers: the true range (unknown on the first bar) and its simple mean over the close."""
    tr = F.when(w.lag("close").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - w.lag("close")), F.abs(F.col("low") - w.lag("close"))))
    return [("_ltr", tr), ("_latr", w.ratio(w.roll(F.avg, "_ltr", k), "close"))]


def base_labels(bars: DataFrame, horizon: int = HORIZON, touch: float = TOUCH) -> DataFrame:
    """label_mfe_5d, label_mae_5d, label_fwd_ret_5d, label_touch; null while the horizon is incomplete."""
    frame = w.forward(horizon)
    whole = (F.count("high").over(frame) == horizon) & (F.count("low").over(frame) == horizon)
    mfe = F.when(whole, w.ratio(F.max("high").over(frame), "close") - 1)
    mae = F.when(whole, w.ratio(F.min("low").over(frame), "close") - 1)
    out = bars.select("*", mfe.alias("label_mfe_5d"), mae.alias("label_mae_5d"), (w.ratio(w.lead("close", horizon), "close") - 1).alias("label_fwd_ret_5d"))
    return out.withColumn("label_touch", F.when(F.col("label_mfe_5d").isNotNull(), (F.col("label_mfe_5d") >= touch).cast("int")))


def path_labels(bars: DataFrame, horizon: int = HORIZON, variants: dict = VARIANTS) -> DataFrame:
    """For each variant: which barrier the path meets first, and when.

    `label_first_touch_<v>` is 1 (target), -1 (stop) or 0 (neither); a day that meets both is the stop and
    ambiguous.  Null where a level or any of the next bars is unknown.
    """
    out = bars
    for name, x in simple_atr_pct():
        out = out.withColumn(name, x)
    ahead = [(w.lead("high", i), w.lead("low", i)) for i in range(1, horizon + 1)]
    out = out.select("*", *[x.alias(f"_{n}{i}") for i, (h, l) in enumerate(ahead, 1) for n, x in (("h", h), ("l", l))])
    whole = F.lit(True)
    for i in range(1, horizon + 1):
        whole = whole & F.col(f"_h{i}").isNotNull() & F.col(f"_l{i}").isNotNull()
    cols = []
    for v, (tp, sl, scaled) in variants.items():
        up = F.lit(float(tp)) * (F.col("_latr") if scaled else F.lit(1.0))
        down = F.lit(float(sl)) * (F.col("_latr") if scaled else F.lit(1.0))
        known = whole & up.isNotNull() & (F.col("close") > 0)
        k_tp = F.coalesce(*[F.when(F.col(f"_h{i}") / F.col("close") - 1 >= up, i) for i in range(1, horizon + 1)])
        k_sl = F.coalesce(*[F.when(F.col(f"_l{i}") / F.col("close") - 1 <= -down, i) for i in range(1, horizon + 1)])
        first = F.when(k_sl.isNotNull() & (k_tp.isNull() | (k_sl <= k_tp)), -1).when(k_tp.isNotNull(), 1).otherwise(0)
        put = lambda x: F.when(known, x)  # noqa: B023,E731
        cols += [
            put(first).alias(f"label_first_touch_{v}"), put((first == 1).cast("int")).alias(f"label_tp_before_sl_{v}"),
            put(k_tp).alias(f"label_days_to_tp_{v}"), put(k_sl).alias(f"label_days_to_sl_{v}"),
            put(F.coalesce(k_tp == k_sl, F.lit(False)).cast("int")).alias(f"label_same_day_ambiguous_{v}"), put(k_tp.isNotNull().cast("int")).alias(f"label_touch_{v}"),
        ]
    out = out.select("*", *cols)
    if PRIMARY in variants:
        out = out.select("*", *[F.col(f"label_{x}_{PRIMARY}").alias(f"label_{x}") for x in ("tp_before_sl", "days_to_tp", "days_to_sl", "first_touch", "same_day_ambiguous")])
    return out.drop("_ltr", "_latr", *[f"_{n}{i}" for i in range(1, horizon + 1) for n in "hl"])
