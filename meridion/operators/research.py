"""Barrier grids, regimes and shrunken rates, analogue search, feature audit and ranking metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridion.functions import windows as w
from meridion.operators import ingest
from meridion.operators.labels import simple_atr_pct

#: The grids of targets and stops, as fractions and as multiples of volatility, and the cost of a round trip.
TARGETS, STOPS = (0.02, 0.03, 0.04, 0.05, 0.07, 0.10, 0.15), (0.015, 0.02, 0.03, 0.04, 0.05)
ATR_TARGETS, ATR_STOPS = (0.75, 1.0, 1.5, 2.0, 3.0), (0.5, 0.75, 1.0, 1.5)
COST = 0.0035
#: Names of regimes (the middle one where no rule holds), and of amounts of evidence.
REGIMES = ("strong_uptrend", "weak_uptrend", "sideways", "weak_downtrend", "strong_downtrend", "vol_compression", "vol_expansion")
EVIDENCE = ("insufficient", "weak", "moderate", "strong")
#: What a personality is made of, and how each part is read.
DIMENSIONS = {
    "label_touch": ("rate", "P(+5% within 5d)"), "label_tp_before_sl": ("rate", "P(TP before SL)"), "label_fwd_ret_5d": ("mean", "Expected 5d return"),
    "label_mfe_5d": ("mean", "Expected MFE"), "label_mae_5d": ("mean", "Expected MAE"), "label_days_to_tp": ("mean", "Days to target"),
}


def liquid_sample(bars: DataFrame, sample: int | None = None, least_turnover: float = 0.0, seed: int = 0) -> DataFrame:
    """Bars of the series whose recent median turnover reaches the floor, and of those of `sample` that the seed picks."""
    out = bars
    if least_turnover:
        out = out.join(ingest.turnover(bars).filter(F.col("median_turnover") >= least_turnover).select("symbol"), "symbol", "left_semi")
    return out if sample is None else out.join(ingest.sample_symbols(out, sample, seed), "symbol", "left_semi")


def episodes(bars: DataFrame, horizon: int = 5, first: int = 60, least: int = 80) -> DataFrame:
    """One row a bar from the 61st on with a complete path: running highs and lows ahead, end return, volatility."""
    out = bars
    for name, x in simple_atr_pct():
        out = out.withColumn(name, x)
    ahead = range(1, horizon + 1)
    highs, lows = F.array(*[w.lead("high", i) for i in ahead]), F.array(*[w.lead("low", i) for i in ahead])
    out = out.select("symbol", "session_date", "close", "_latr", highs.alias("_h"), lows.alias("_l"), w.lead("close", horizon).alias("_end"), F.row_number().over(w.series()).alias("_n"), F.count("*").over(Window.partitionBy("symbol")).alias("_total"))
    out = out.filter((F.col("_total") >= horizon + least) & (F.col("_n") > first) & (F.col("close") > 0) & F.forall("_h", lambda x: x.isNotNull()) & F.forall("_l", lambda x: x.isNotNull()))
    running = lambda name, pick: F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: pick(F.slice(name, F.lit(1), k)) / F.col("close") - 1)
    return out.select("symbol", "session_date", running("_h", F.array_max).alias("run_hi"), running("_l", F.array_min).alias("run_lo"), (F.col("_end") / F.col("close") - 1).alias("fwd_ret"), F.col("_latr").alias("atr_pct"))


def barrier_scan(paths: DataFrame, targets=TARGETS, stops=STOPS, scaled: bool = False, cost: float = COST) -> DataFrame:
    """Per target and stop: how often each is met, which first, when, and what that pays.

    Payoffs are those of the median levels, and of the mean end return where neither is met, less the cost.  `lo` counts
    a session that meets both barriers as the stop, `hi` as the target.  `breakeven` is the rate of targets that pays
    the stops, the cost and what is left unresolved; `lift_needed` is what that asks above `tp_first_lo`.  Scaled grids
    leave out episodes without a volatility.  The grid is exploded beside each episode and pre-aggregated in place.
    """
    grid = F.array(*[F.struct(F.lit(float(t)).alias("tp"), F.lit(float(s)).alias("sl")) for t in targets for s in stops])
    x = (paths.filter(F.col("atr_pct").isNotNull()) if scaled else paths).select("*", F.explode(grid).alias("g")).select("*", "g.tp", "g.sl")
    unit = F.col("atr_pct") if scaled else F.lit(1.0)
    x = x.withColumns({"_up": F.col("tp") * unit, "_down": F.col("sl") * unit})
    first = lambda path, hit: F.nullif(F.array_position(F.transform(path, lambda v: F.when(hit(v), 1).otherwise(0)), 1), F.lit(0))
    x = x.withColumns({"k_tp": first("run_hi", lambda v: v >= F.col("_up")), "k_sl": first("run_lo", lambda v: v <= -F.col("_down"))})
    tp, sl = F.col("k_tp").isNotNull(), F.col("k_sl").isNotNull()
    later = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) < F.col(b)))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    out = x.groupBy("tp", "sl").agg(
        F.count("*").alias("n"), share(tp).alias("tp_touch"), share(sl).alias("sl_touch"), share(~tp & ~sl).alias("neither"),
        share(later("k_tp", "k_sl")).alias("tp_first_lo"), share(later("k_sl", "k_tp")).alias("_sl_first"), share(F.col("k_tp") == F.col("k_sl")).alias("ambiguous"),
        w.median(F.col("k_tp")).alias("median_days"), share(F.col("k_tp") <= 1).alias("within_1d"), share(F.col("k_tp") <= 3).alias("within_3d"),
        w.median(F.col("_up")).alias("_tp"), w.median(F.col("_down")).alias("_sl"), F.coalesce(F.avg(F.when(~tp & ~sl, F.col("fwd_ret"))), F.lit(0.0)).alias("_rest"),
    )
    c = F.col
    out = out.withColumn("tp_first_hi", c("tp_first_lo") + c("ambiguous"))
    left = c("neither") * c("_rest")
    out = out.withColumns({
        "reward_risk": F.round(w.ratio("_tp", "_sl"), 2),
        "pay_lo": c("tp_first_lo") * c("_tp") - (c("_sl_first") + c("ambiguous")) * c("_sl") + left - cost,
        "pay_hi": c("tp_first_hi") * c("_tp") - c("_sl_first") * c("_sl") + left - cost,
        "breakeven": w.ratio(F.lit(cost) + c("_sl") - left, c("_tp") + c("_sl")),
    })
    return out.withColumn("lift_needed", c("breakeven") - c("tp_first_lo")).drop("_tp", "_sl", "_rest", "_sl_first")


def barrier_stability(paths: DataFrame, targets=TARGETS, stops=STOPS, blocks: int = 3, least: int = 5000, scaled: bool = False) -> DataFrame:
    """One row: the mean rank correlation of the grid's payoffs between blocks of years, the pairs of blocks, a verdict.

    Blocks with under `least` episodes don't count.  All blocks are scanned in one pass.
    """
    years = paths.select(F.year("session_date").alias("year")).distinct()
    block = years.select("year", F.ntile(blocks).over(Window.orderBy("year")).alias("block"))
    x = paths.withColumn("year", F.year("session_date")).join(F.broadcast(block), "year")
    big = x.groupBy("block").agg(F.count("*").alias("c")).filter(F.col("c") >= least).select("block")
    x = x.join(F.broadcast(big), "block")
    scans = None
    for b in range(1, blocks + 1):
        one = barrier_scan(x.filter(F.col("block") == b), targets, stops, scaled).select("tp", "sl", F.lit(b).alias("block"), "pay_lo")
        scans = one if scans is None else scans.unionByName(one)
    # Ranks by the payoff as it is shown, rounded; equal ones in the order of the grid.
    ranked = scans.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy(F.desc(F.round("pay_lo", 5)), "tp", "sl")).cast("double"))
    a, c = ranked.alias("a"), ranked.alias("c")
    pairs = a.join(c, (F.col("a.tp") == F.col("c.tp")) & (F.col("a.sl") == F.col("c.sl")) & (F.col("a.block") < F.col("c.block")))
    by = pairs.groupBy(F.col("a.block").alias("one"), F.col("c.block").alias("two")).agg(F.corr("a.r", "c.r").alias("rho"), F.count("*").alias("n")).filter("n > 3")
    mean = by.agg(F.avg("rho").alias("mean_rho"), F.count("rho").alias("pairs"))
    return mean.withColumn("verdict", F.when(F.col("mean_rho") > 0.7, "stable").when(F.col("mean_rho") < 0.4, "unstable").when(F.col("mean_rho").isNotNull(), "partly stable"))


def regimes(features: DataFrame, trend: str, volatility: str, location: str, least: int = 252) -> DataFrame:
    """Trend regime by expanding ranks of a series' own history; extreme volatility overrides it; an unknown trend is unknown."""
    ranked = w.expanding_ranks(features, {"_t": trend, "_v": volatility, "_l": location}, least)
    t, v = F.col("_t"), F.col("_v")
    up2, up1, flat, down1, down2, calm, wild = (F.lit(r) for r in REGIMES)
    base = F.when(t >= 0.8, up2).when(t >= 0.6, up1).when(t <= 0.2, down2).when(t <= 0.4, down1).otherwise(flat)
    regime = F.when(t.isNotNull(), F.when(v >= 0.85, wild).when(v <= 0.15, calm).otherwise(base))
    return ranked.withColumns({"regime": regime, "regime_location_pct": F.round("_l", 3)}).drop("_t", "_v", "_l")


def personality_many(labelled: DataFrame, outcomes: list[str], by: str, lag: int = 5, strength: float = 50.0) -> DataFrame:
    """For each outcome: what a series did in its regime so far, what all did, and the first shrunk to the second.

    Only outcomes that were known `lag` sessions before count.  Rows of all series are taken in the order of session and
    symbol; earlier sessions are summed by session first, so that no window holds more than the sessions of a regime or
    the series of a session.  n, its conservative effective size and the evidence come from the first outcome; the first
    row of a series in a regime has none.  All outcomes share the shuffles of one.
    """
    x = labelled.withColumns({f"_{y}": w.lag(F.col(y).cast("double"), lag) for y in outcomes}).filter(F.col(by).isNotNull())
    own = Window.partitionBy("symbol", by).orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    peers = Window.partitionBy(by, "session_date").orderBy("symbol").rowsBetween(Window.unboundedPreceding, -1)
    many = lambda f, frame, name: {f"{name}{i}": F.coalesce(f(f"_{y}").over(frame), F.lit(0)) for i, y in enumerate(outcomes)}
    x = x.withColumns(many(F.count, own, "_n") | many(F.sum, own, "_s") | many(F.count, peers, "_pn") | many(F.sum, peers, "_ps") | {"_rows": F.count("*").over(own)})
    day = x.groupBy(by, "session_date").agg(*[f(f"_{y}").alias(f"_d{n}{i}") for i, y in enumerate(outcomes) for f, n in ((F.count, "n"), (F.sum, "s"))])
    along = Window.partitionBy(by).orderBy("session_date").rowsBetween(Window.unboundedPreceding, -1)
    day = day.select(by, "session_date", *[F.coalesce(F.sum(f"_d{n}{i}").over(along), F.lit(0)).alias(f"_g{n}{i}") for i in range(len(outcomes)) for n in "ns"])
    x = x.join(day, [by, "session_date"])
    n = lambda i: F.when(F.col("_rows") > 0, F.col(f"_n{i}"))
    cols = [n(0).alias("n"), (n(0) / F.lit(float(lag))).alias("n_eff")]
    for i, y in enumerate(outcomes):
        eff = n(i) / F.lit(float(lag))
        stock = w.ratio(F.col(f"_s{i}"), F.col(f"_n{i}").cast("double"))
        every = w.ratio(F.col(f"_gs{i}") + F.col(f"_ps{i}"), (F.col(f"_gn{i}") + F.col(f"_pn{i}")).cast("double"))
        est = F.when(eff.isNotNull(), F.when(stock.isNull(), every).otherwise((eff * stock + strength * every) / (eff + strength)))
        cols += [est.alias(f"{y}__est"), stock.alias(f"{y}__stock"), every.alias(f"{y}__global")]
    out = x.select("symbol", "session_date", by, *cols)
    eff = F.coalesce("n_eff", F.lit(0.0))
    none, thin, some, ample = (F.lit(e) for e in EVIDENCE)
    evidence = F.when(eff < 5, none).when(eff < 20, thin).when(eff < 60, some).otherwise(ample)
    return out.withColumns({"weight": F.col("n_eff") / (F.col("n_eff") + strength), "evidence": evidence})


def personality(labelled: DataFrame, label: str, by: str, lag: int = 5, strength: float = 50.0) -> DataFrame:
    """`personality_many` of one outcome: stock_rate, global_rate and their shrunk estimate."""
    p = personality_many(labelled, [label], by, lag, strength)
    names = {f"{label}__stock": "stock_rate", f"{label}__global": "global_rate", f"{label}__est": "estimate"}
    return p.select("symbol", "session_date", by, "n", *[F.col(a).alias(b) for a, b in names.items()], "weight", "evidence")


def card(table: DataFrame, symbol: str, date) -> DataFrame:
    """The latest row of a series at or before a date."""
    rest = [c for c in table.columns if c not in ("symbol", "session_date")]
    x = table.filter((F.col("symbol") == symbol) & (F.col("session_date") <= F.lit(date)))
    last = x.agg(F.max_by(F.struct("symbol", "session_date", *rest), "session_date").alias("r"))
    return last.filter("r IS NOT NULL").select("r.*")


def card_text(personalities: DataFrame, panel: DataFrame | None, symbol: str, date, dimensions: dict = DIMENSIONS) -> str:
    """A card to read: where the series stands (with a panel), and what its regime did to it and to all."""
    rows = card(personalities, symbol, date).collect()
    if not rows:
        return f"{symbol}: no estimate at that date"
    r = rows[0].asDict()
    show = lambda v, kind: "n/a" if v is None else f"{v:.1%}" if kind == "rate" else f"{v:+.2%}" if kind == "move" else f"{v:.1f}"
    out = [f"{symbol} - {r['session_date']}", f"  regime: {r['regime']}"]
    if panel is not None and (at := card(panel, symbol, date).collect()):
        a = at[0].asDict()
        for column, name, kind in (("D_pos_in_52w_range", "position in the year's range", "number"), ("D_drawdown_252", "drawdown from the peak", "move"), ("D_realvol_20", "realised volatility, 20 days", "number")):
            out.append(f"  {name}: {show(a.get(column), kind)}")
    for column, (kind, name) in dimensions.items():
        if r.get(f"{column}__est") is not None:
            kind = kind if kind == "rate" else "number" if "days" in column else "move"
            out.append(f"  {name}: {show(r[f'{column}__est'], kind)} (this series {show(r[f'{column}__stock'], kind)}, all {show(r[f'{column}__global'], kind)})")
    n, eff = r.get("n") or 0, r.get("n_eff") or 0.0
    out += [f"  episodes: {n}, taken as {eff:.0f} independent ones", f"  evidence: {r['evidence']}", f"  weight of this series: {show(r.get('weight') or 0.0, 'rate')}"]
    return "\n".join([*out, "  Rates of the past, neither predictions nor calibrated."])


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, shard: int = 16384) -> DataFrame:
    """k nearest vectors by Euclidean distance for any number of queries; rows without an id or a vector drop out.

    Blocks of queries meet shards of vectors in tasks of bounded size.  A task finds its k nearest by one matrix
    product, with a margin for its rounding, and measures those exactly.
    """
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((vectors, shard), (queries, block)))
    whole = lambda df, i, x: df.select(F.col("id").alias(i), F.col("v").cast("array<double>").alias(x)).na.drop()
    dealt = lambda i, n: F.pmod(F.xxhash64(i), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    pool = whole(vectors, "id", "v").withColumn("_shard", dealt("id", shards)).withColumn("_block", every(blocks))
    asked = whole(queries, "q_id", "q").withColumn("_block", dealt("q_id", blocks)).withColumn("_shard", every(shards))
    types = dict(vectors.dtypes)["id"], dict(queries.dtypes)["id"]

    def search(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q_id": q["q_id"].iloc[:0], "id": p["id"].iloc[:0], "distance": np.zeros(0)})]
        if len(p) and len(q):
            ids, x, y = p["id"].to_numpy(), np.stack(p["v"].to_list()), np.stack(q["q"].to_list())
            x2, y2 = (x**2).sum(1), (y**2).sum(1)
            slack = 1e-9 * (x2.max() + y2.max())
            for i in range(0, len(q), 256):
                d2 = y2[i : i + 256, None] + x2 - 2 * y[i : i + 256] @ x.T
                for j, own in enumerate(q["q_id"].iloc[i : i + 256]):
                    d2[j, ids == own] = np.inf
                    n = min(k, len(p)) - 1
                    near = np.flatnonzero((d2[j] <= np.partition(d2[j], n)[n] + slack) & np.isfinite(d2[j]))
                    d = np.sqrt(((x[near] - y[i + j]) ** 2).sum(1))
                    best = np.lexsort((ids[near], d))[:k]
                    out.append(pd.DataFrame({"q_id": own, "id": ids[near[best]], "distance": d[best]}))
        return pd.concat(out)

    pairs = pool.groupBy("_shard", "_block").cogroup(asked.groupBy("_shard", "_block")).applyInPandas(search, f"q_id {types[1]}, id {types[0]}, distance double")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("distance", "id"))).filter(F.col("rank") <= k)


def eras(df: DataFrame, n: int = 3) -> DataFrame:
    """Blocks of equally many rows in the order of session and symbol; a block may begin within a session."""
    x = w.positions(df, "_pos", "_all")
    # The first block whose upper place, (rows - 1) i / n, reaches the row's.
    last = F.greatest(F.col("_all") - 1, F.lit(1))
    return x.withColumn("era", F.greatest(F.lit(1), F.floor((F.col("_pos") * n + last - 1) / last)).cast("int")).drop("_pos", "_all")


# Metrics of scored predictions (session_date, symbol, y, score).
def top_n(scored: DataFrame, sizes: tuple[int, ...] = (1, 3, 5, 10), hurdle: float = 0.424, by: tuple[str, ...] = ()) -> DataFrame:
    """Realised rate of each session's best n, two standard errors, and whether the lower end clears the hurdle."""
    r = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "session_date").orderBy(F.desc("score"), "symbol")))
    picks = r.filter(F.col("rank") <= max(sizes)).select(*by, "y", F.explode(F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n >= F.col("rank"))).alias("top"))
    x = picks.groupBy(*by, "top").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
    se = 2 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    return x.select(*by, "top", "n", "rate", se.alias("two_se"), (F.col("rate") - se > hurdle).alias("clears"))


def classification(scored: DataFrame) -> DataFrame:
    """AUC by average ranks, Brier score, log loss; ranks come from running totals over ranges of the distinct scores."""
    by = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    ranked = w.running_total(by, "score", ["n"])
    auc = ranked.select("*", (F.col("n_before") + (F.col("n") + 1) / 2).alias("rank")).agg(F.sum(F.col("rank") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    p = F.least(F.greatest(F.col("score"), F.lit(1e-6)), F.lit(1 - 1e-6))
    rest = scored.agg(F.avg((p - F.col("y")) ** 2).alias("brier"), F.avg(-(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))).alias("logloss"), F.count("*").alias("n"))
    return auc.join(rest).select("n", F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("q")).alias("auc"), "brier", "logloss")


def daily_rank_correlation(scored: DataFrame, by: tuple[str, ...] = (), least: int = 3) -> DataFrame:
    """Mean and median over sessions of the rank correlation of score and outcome; sessions of one outcome don't count."""
    key = [*by, "session_date"]
    rank = lambda x: F.rank().over(Window.partitionBy(*key).orderBy(x)) + (F.count("*").over(Window.partitionBy(*key, x)) - 1) / 2
    r = scored.select(*key, "y", "score", rank("score").alias("rs"), rank("y").alias("ry"))
    spread = F.stddev_pop("rs") * F.stddev_pop("ry")
    d = r.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("y").alias("k"), F.try_divide(F.covar_pop("rs", "ry"), F.when(spread > 1e-12, spread)).alias("ic"))
    d = d.filter((F.col("n") >= least) & (F.col("k") >= 2))
    return d.groupBy(*by).agg(F.count("ic").alias("sessions"), F.avg("ic").alias("mean_daily_spearman"), w.median(F.col("ic")).alias("median_daily_spearman"))


def fold_metrics(scored: DataFrame, hurdle: float = 0.424) -> DataFrame:
    """A row a fold: size, base rate, AUC, log loss, Brier score, rates of the best n, daily rank correlation."""
    out = None
    for fold in sorted(r.fold for r in scored.select("fold").distinct().collect()):
        x = scored.filter(F.col("fold") == fold).select("session_date", "symbol", "y", "score")
        tops = top_n(x, hurdle=hurdle).agg(*[F.max(F.when(F.col("top") == n, F.col(a))).alias(f"top{n}_{b}") for n in (1, 3, 5, 10) for a, b in (("rate", "realised"), ("two_se", "se2"), ("clears", "clears"))])
        row = classification(x).join(x.agg(F.avg("y").alias("base_rate"))).join(tops).join(daily_rank_correlation(x).drop("sessions")).withColumn("fold", F.lit(fold))
        out = row if out is None else out.unionByName(row)
    for n in (1, 3, 5, 10):
        out = out.withColumn(f"top{n}_lower_2se", F.col(f"top{n}_realised") - F.col(f"top{n}_se2"))
    return out


#: What is summarised over folds.
SUMMARISED = ("auc", "logloss", "brier", "top1_realised", "top1_lower_2se", "top3_realised", "top3_lower_2se", "top5_realised", "top5_lower_2se", "top10_realised", "top10_lower_2se", "mean_daily_spearman")


def fold_summary(metrics: DataFrame, hurdle: float = 0.424) -> DataFrame:
    """One row: mean, median and least of each metric over the folds, and whether every fold's first pick clears the hurdle."""
    cols = [f(x).alias(f"{x}_{n}") for x in SUMMARISED for f, n in ((F.avg, "mean"), (lambda x: w.median(F.col(x)), "median"), (F.min, "min"))]
    every = lambda x: F.coalesce(F.every(F.coalesce(F.col(x) > hurdle, F.lit(False))), F.lit(False))
    return metrics.agg(F.count("*").alias("folds"), *cols, every("top1_realised").alias("top1_all_folds_above_hurdle"), every("top1_lower_2se").alias("top1_all_folds_clear_hurdle"))


def stratified(df: DataFrame, cap: int) -> DataFrame:
    """An even spread of at most `cap` rows in the order of (session_date, symbol): rows floor(i n / cap)."""
    x = w.positions(df, "_pos", "_all")
    first = F.floor((F.col("_pos") * cap + F.col("_all") - 1) / F.col("_all"))  # smallest i with floor(i n / cap) >= pos
    keep = (F.col("_all") <= cap) | ((first < cap) & (F.floor(first * F.col("_all") / cap) == F.col("_pos")))
    return x.filter(keep).drop("_all", "_pos")
