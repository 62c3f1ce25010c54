"""Barrier grids, regimes, analogues, audit, models and metrics."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from meridion.functions import windows as w
from meridion.operators import audit, memory, models, panel, research
from meridion.operators.features import FEATURES
from meridion.operators.labels import base_labels, path_labels
from meridion.plans import sql
from meridion.plans.catalog import query, rounded
from meridion.sources.bars import brand_weeks, nation_days, table
from meridion.work import kept

_V = "PARTITION BY symbol ORDER BY session_date"


def _paths_sql(bars: str) -> str:
    return f"""b AS ({bars}), p0 AS (SELECT *, lag(close) OVER ({_V}) AS pc, row_number() OVER ({_V}) AS n, count(*) OVER (PARTITION BY symbol) AS total, {", ".join(f"lead(high, {i}) OVER ({_V}) AS h{i}, lead(low, {i}) OVER ({_V}) AS l{i}" for i in range(1, 6))}, lead(close, 5) OVER ({_V}) AS e FROM b),
p1 AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM p0),
p2 AS (SELECT *, CASE WHEN count(tr) OVER ({_V} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) >= 14 THEN avg(tr) OVER ({_V} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END / close AS atr FROM p1),
ep AS (SELECT symbol, session_date, atr, e / close - 1 AS f, {", ".join(f"h{i} / close - 1 AS h{i}, l{i} / close - 1 AS l{i}" for i in range(1, 6))} FROM p2 WHERE total >= 85 AND n > 60 AND close > 0 AND h5 IS NOT NULL AND l5 IS NOT NULL)"""


_FIXED = ("[0.02, 0.03, 0.04, 0.05, 0.07, 0.10, 0.15]", "[0.015, 0.02, 0.03, 0.04, 0.05]")
_SCALED = ("[0.75, 1.0, 1.5, 2.0, 3.0]", "[0.5, 0.75, 1.0, 1.5]")


def _grid_sql(grid: tuple[str, str], scaled: bool, source: str = "ep", by: str = "") -> str:
    """Tables up to `z`, a row a target and stop (and `by`): payoffs of the median levels, the rest at its mean end return, less 0.0035."""
    unit = "atr" if scaled else "1.0"
    k = lambda side, test: "coalesce(" + ", ".join(f"CASE WHEN {side}{i} {test} THEN {i} END" for i in range(1, 6)) + ")"
    return f"""g AS (SELECT unnest({grid[0]}::DOUBLE[]) AS tp), h AS (SELECT tp, unnest({grid[1]}::DOUBLE[]) AS sl FROM g),
x AS (SELECT {by}tp, sl, f, tp * {unit} AS u, sl * {unit} AS d, {k('h', f'>= tp * {unit}')} AS kt, {k('l', f'<= -(sl * {unit})')} AS ks FROM {source}, h{' WHERE atr IS NOT NULL' if scaled else ''}),
y AS (SELECT *, kt IS NOT NULL AND (ks IS NULL OR kt < ks) AS tf, ks IS NOT NULL AND (kt IS NULL OR ks < kt) AS sf, coalesce(kt = ks, false) AS tie, kt IS NULL AND ks IS NULL AS nn FROM x),
a AS (SELECT {by}tp, sl, count(*) AS n, avg((kt IS NOT NULL)::INTEGER) AS tt, avg((ks IS NOT NULL)::INTEGER) AS st, avg(nn::INTEGER) AS nn, avg(tf::INTEGER) AS tf, avg(sf::INTEGER) AS sf, avg(tie::INTEGER) AS tie, median(kt)::DOUBLE AS md, avg(coalesce(kt <= 1, false)::INTEGER) AS d1, avg(coalesce(kt <= 3, false)::INTEGER) AS d3,
  median(u) AS mu, median(d) AS md2, coalesce(avg(f) FILTER (nn), 0.0) AS rest FROM y GROUP BY {by}tp, sl),
z AS (SELECT {by}tp, sl, n, tt, st, nn, tf, tie, md, d1, d3, mu / md2 AS rr, tf * mu - (sf + tie) * md2 + nn * rest - 0.0035 AS pl, (tf + tie) * mu - sf * md2 + nn * rest - 0.0035 AS ph, (0.0035 + md2 - nn * rest) / (mu + md2) AS be FROM a)"""


_SCAN = "SELECT tp, sl, n, round(tt, 6) AS tp_touch, round(st, 6) AS sl_touch, round(nn, 6) AS neither, round(tf, 6) AS tp_first_lo, round(tie, 6) AS ambiguous, md AS median_days, round(d1, 6) AS within_1d, round(d3, 6) AS within_3d, round(tf + tie, 6) AS tp_first_hi, round(rr, 2) AS reward_risk, round(pl, 6) + 0.0 AS pay_lo, round(ph, 6) + 0.0 AS pay_hi, round(be, 6) AS breakeven, round(be - tf, 6) + 0.0 AS lift_needed FROM z"


@query("barrier_scan", f"WITH {_paths_sql(sql.BARS_BRAND)}, {_grid_sql(_FIXED, False)} {_SCAN}", dates=())
def _scan(spark, sf_dir):
    return rounded(research.barrier_scan(research.episodes(brand_weeks(spark, sf_dir))))


@query("barrier_scan_scaled", f"WITH {_paths_sql(sql.BARS_BRAND)}, {_grid_sql(_SCALED, True)} {_SCAN}", dates=())
def _scan_scaled(spark, sf_dir):
    return rounded(research.barrier_scan(research.episodes(brand_weeks(spark, sf_dir)), research.ATR_TARGETS, research.ATR_STOPS, True))


@query("barrier_stability", f"""WITH {_paths_sql(sql.BARS_NATION)}, yb AS (SELECT y, ntile(3) OVER (ORDER BY y) AS block FROM (SELECT DISTINCT year(session_date) AS y FROM ep)), eb AS (SELECT ep.*, block FROM ep JOIN yb ON y = year(session_date)),
big AS (SELECT * FROM eb WHERE block IN (SELECT block FROM eb GROUP BY 1 HAVING count(*) >= 5000)), {_grid_sql(_FIXED, False, 'big', 'block, ')},
o AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY round(pl, 5) DESC, tp, sl) AS r FROM z), c AS (SELECT p.block, q.block, corr(p.r, q.r) AS rho FROM o p JOIN o q ON p.tp = q.tp AND p.sl = q.sl AND p.block < q.block GROUP BY 1, 2 HAVING count(*) > 3),
m AS (SELECT avg(rho) AS r, count(rho) AS pairs FROM c) SELECT round(r, 4) + 0.0 AS mean_rho, pairs, CASE WHEN r > 0.7 THEN 'stable' WHEN r < 0.4 THEN 'unstable' WHEN r IS NOT NULL THEN 'partly stable' END AS verdict FROM m""", dates=())
def _stability(spark, sf_dir):
    """Whether the grid's payoffs rank alike in three blocks of years, of 5,000 episodes or more each."""
    return rounded(research.barrier_stability(research.episodes(nation_days(spark, sf_dir))), 4)


@query("liquid_sample", f"WITH b AS ({sql.BARS_NATION}), t AS (SELECT symbol, median(close * volume) AS m FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS r, count(*) OVER (PARTITION BY symbol) AS c FROM b) WHERE r <= 60 AND c >= 30 GROUP BY 1), k AS (SELECT median(m) AS floor FROM t) SELECT symbol, count(*) AS bars FROM b WHERE symbol IN (SELECT symbol FROM t WHERE m >= 900000.0) GROUP BY 1", dates=())
def _liquid(spark, sf_dir):
    """Bars of the series above a floor of turnover: the universe that barriers are chosen on."""
    return research.liquid_sample(nation_days(spark, sf_dir), least_turnover=900_000.0).groupBy("symbol").agg(F.count("*").alias("bars"))


_REGIME_X = {"_t": sql.xrank("D_ema20_angle_deg", 252), "_v": sql.xrank("D_realvol_ratio_20_60", 252), "_loc": sql.xrank("D_pos_in_52w_range", 252)}
_REGIME_CASE = "CASE WHEN _t IS NULL THEN NULL WHEN _v >= 0.85 THEN 'vol_expansion' WHEN _v <= 0.15 THEN 'vol_compression' WHEN _t >= 0.8 THEN 'strong_uptrend' WHEN _t >= 0.6 THEN 'weak_uptrend' WHEN _t <= 0.2 THEN 'strong_downtrend' WHEN _t <= 0.4 THEN 'weak_downtrend' ELSE 'sideways' END"
_REGIME = sql.layered(sql.BARS_NATION, ["_t", "_v", "_loc", "_n"], extra=_REGIME_X)
_REGIME_INPUTS = ["D_ema20_angle_deg", "D_realvol_ratio_20_60", "D_pos_in_52w_range"]


def _regimes_of(bars):
    return research.regimes(FEATURES.with_columns(bars, _REGIME_INPUTS), *_REGIME_INPUTS)


@query("regimes", f"{_REGIME} SELECT symbol, session_date, {_REGIME_CASE} AS regime, round(_loc::DECIMAL(18, 12), 3)::DOUBLE AS regime_location_pct FROM x")
def _regimes(spark, sf_dir):
    return rounded(_regimes_of(nation_days(spark, sf_dir)).select("symbol", "session_date", "regime", "regime_location_pct"), 3)


_FWD = f"({_V} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
_KT = "coalesce(" + ", ".join(f"CASE WHEN h{i} / close - 1 >= 1.5 * latr THEN {i} END" for i in range(1, 6)) + ")"
_KS = "coalesce(" + ", ".join(f"CASE WHEN l{i} / close - 1 <= -(1.0 * latr) THEN {i} END" for i in range(1, 6)) + ")"
_OUTCOMES = f"""r AS (SELECT symbol, session_date, open, high, low, close, {_REGIME_CASE} AS regime FROM x),
o1 AS (SELECT *, CASE WHEN lag(close) OVER ({_V}) IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER ({_V})), abs(low - lag(close) OVER ({_V}))) END AS tr, {", ".join(f"lead(high, {i}) OVER ({_V}) AS h{i}, lead(low, {i}) OVER ({_V}) AS l{i}" for i in range(1, 6))},
  CASE WHEN count(high) OVER {_FWD} = 5 THEN max(high) OVER {_FWD} / close - 1 END AS label_mfe_5d, CASE WHEN count(low) OVER {_FWD} = 5 THEN min(low) OVER {_FWD} / close - 1 END AS label_mae_5d, lead(close, 5) OVER ({_V}) / close - 1 AS label_fwd_ret_5d FROM r),
o2 AS (SELECT *, CASE WHEN count(tr) OVER ({_V} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) >= 14 THEN avg(tr) OVER ({_V} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) END / close AS latr FROM o1),
o3 AS (SELECT *, {_KT} AS kt, {_KS} AS ks, h5 IS NOT NULL AND l5 IS NOT NULL AND latr IS NOT NULL AS known FROM o2),
o4 AS (SELECT symbol, session_date, regime, CASE WHEN label_mfe_5d IS NOT NULL THEN (label_mfe_5d >= 0.05)::INTEGER END AS label_touch, CASE WHEN known THEN (kt IS NOT NULL AND (ks IS NULL OR kt < ks))::INTEGER END AS label_tp_before_sl, label_fwd_ret_5d, label_mfe_5d, label_mae_5d, CASE WHEN known THEN kt END AS label_days_to_tp FROM o3)"""


def _rates_sql(names: list[str]) -> str:
    """Tables up to `pr`: n, and of each outcome its rate in the series' regime, in all, and the shrunk one."""
    known = ", ".join(f"lag({n}, 5) OVER ({_V}) AS k_{n}" for n in names)
    own = "(PARTITION BY symbol, regime ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    every = "(PARTITION BY regime ORDER BY session_date, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sums = ", ".join(f"count(k_{n}) OVER {own} AS n_{n}, coalesce(sum(k_{n}) OVER {own}, 0) AS s_{n}, sum(k_{n}) OVER {every} / nullif(count(k_{n}) OVER {every}, 0) AS g_{n}" for n in names)
    cols = ", ".join(f"s_{n} / nullif(n_{n}, 0) AS {n}__stock, g_{n} AS {n}__global, CASE WHEN first THEN NULL WHEN n_{n} = 0 THEN g_{n} ELSE (n_{n} / 5.0 * (s_{n} / n_{n}) + 50 * g_{n}) / (n_{n} / 5.0 + 50) END AS {n}__est" for n in names)
    lead = names[0]
    return f"""y1 AS (SELECT *, {known} FROM o4), y2 AS (SELECT *, row_number() OVER (PARTITION BY symbol, regime ORDER BY session_date) = 1 AS first, {sums} FROM y1 WHERE regime IS NOT NULL),
pr AS (SELECT symbol, session_date, regime, CASE WHEN NOT first THEN n_{lead} END AS n, {cols}, CASE WHEN NOT first THEN (n_{lead} / 5.0) / (n_{lead} / 5.0 + 50) END AS weight, CASE WHEN first OR n_{lead} / 5.0 < 5 THEN 'insufficient' WHEN n_{lead} / 5.0 < 20 THEN 'weak' WHEN n_{lead} / 5.0 < 60 THEN 'moderate' ELSE 'strong' END AS evidence FROM y2)"""


def _labelled(spark, sf_dir):
    x = _regimes_of(path_labels(base_labels(nation_days(spark, sf_dir))))
    return x.select("symbol", "session_date", "regime", *[F.col(c).cast("double").alias(c) for c in research.DIMENSIONS])


@query("personality", f"{_REGIME}, {_OUTCOMES}, {_rates_sql(['label_touch'])} SELECT symbol, session_date, regime, n, round(label_touch__stock, 6) + 0.0 AS stock_rate, round(label_touch__global, 6) + 0.0 AS global_rate, round(label_touch__est, 6) + 0.0 AS estimate, round(weight, 6) AS weight, evidence FROM pr")
def _personality(spark, sf_dir):
    return rounded(research.personality(_labelled(spark, sf_dir), "label_touch", "regime"))


_SIX = ["label_touch", "label_tp_before_sl", "label_fwd_ret_5d", "label_mfe_5d", "label_mae_5d", "label_days_to_tp"]


@query("personality_many", f"{_REGIME}, {_OUTCOMES}, {_rates_sql(_SIX)} SELECT symbol, session_date, regime, n, {', '.join(f'round({n}__{k}, 9) + 0.0 AS {n}__{k}' for n in _SIX for k in ('est', 'stock', 'global'))}, round(weight, 9) AS weight, evidence FROM pr")
def _many(spark, sf_dir):
    """Six outcomes by regime, side by side."""
    return rounded(research.personality_many(_labelled(spark, sf_dir), list(research.DIMENSIONS), "regime").drop("n_eff"), 9)


@query("regime_card", f"{_REGIME}, {_OUTCOMES}, {_rates_sql(['label_touch'])} SELECT symbol, session_date, regime, n, round(label_touch__est, 6) + 0.0 AS estimate, evidence FROM pr WHERE symbol = '3' AND session_date <= DATE '2000-06-01' ORDER BY session_date DESC LIMIT 1")
def _card(spark, sf_dir):
    p = research.personality(_labelled(spark, sf_dir), "label_touch", "regime").select("symbol", "session_date", "regime", "n", "estimate", "evidence")
    return rounded(research.card(p, "3", datetime.date(2000, 6, 1)))


# States and their edges.
_STATE = ["D_ema20_angle_deg", "D_realvol_20", "D_realvol_ratio_20_60", "D_rsi14", "D_adx14", "D_pos_in_52w_range", "D_drawdown_252", "D_dist_from_52wh", "D_bb_pctB_20", "D_donch_pos_20", "D_dvol_z20", "D_gap_pct"]
_SHARES = "[" + ", ".join(str(i / 1000) for i in range(1001)) + "]"
_STATES = f"""{sql.layered(sql.BARS_NATION, _STATE)}, st AS (SELECT symbol, session_date, {', '.join(_STATE)} FROM x WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _STATE)}), sn AS (SELECT session_date, row_number() OVER (ORDER BY session_date) - 1 AS pos FROM (SELECT DISTINCT session_date FROM st)),
e0 AS (SELECT min(session_date) AS epoch FROM st UNION SELECT make_date(y, 1, 1) FROM (SELECT unnest(range(1990, 2010)) AS y) WHERE make_date(y, 1, 1) BETWEEN (SELECT min(session_date) FROM st) AND (SELECT max(session_date) FROM st)),
ed AS (SELECT epoch, count(*) AS n, {', '.join(f'quantile_cont({c}, {_SHARES}) AS e_{c}' for c in _STATE)} FROM e0 JOIN st ON session_date < epoch GROUP BY 1 HAVING count(*) >= 5000)"""


def _memory(spark, sf_dir):
    """States of the daily series with their outcomes, and the edges of each epoch: built once, then asked."""
    bars = nation_days(spark, sf_dir)

    def build():
        return memory.states(FEATURES.with_columns(path_labels(base_labels(bars)), list(memory.STATE)))

    rows = kept(spark, "states", [bars], build)
    return rows, kept(spark, "edges", [rows], lambda: memory.quantile_edges(rows, list(memory.STATE), memory.epochs(rows)))


@query("pit_edges", f"{_STATES} SELECT epoch, n AS rows, {', '.join(f'round(list_sum(e_{c}), 2) + 0.0 AS {c}' for c in _STATE)} FROM ed", dates=("epoch",))
def _edges(spark, sf_dir):
    """The sum of the 1,001 edges of each of twelve columns, of each epoch with 5,000 earlier states."""
    _, e = _memory(spark, sf_dir)
    return rounded(e.select("epoch", "rows", *[F.aggregate(c, F.lit(0.0), lambda a, v: a + v).alias(c) for c in memory.STATE]), 2)


_PLACE = "least(len(list_filter(e_{c}, lambda v: v < {c})) / 1000.0, 1.0)::DOUBLE"


@query("pit_normalise", f"""{_STATES}, q AS (SELECT *, row_number() OVER (PARTITION BY symbol, session_date ORDER BY epoch DESC) AS r FROM st JOIN ed ON epoch <= session_date WHERE year(session_date) = 2000)
SELECT symbol, session_date, epoch, {', '.join(f'{_PLACE.format(c=c)} AS {c}' for c in _STATE)} FROM q WHERE r = 1""", dates=("session_date", "epoch"))
def _normalised(spark, sf_dir):
    """The states of a year on the edges that were known then."""
    rows, e = _memory(spark, sf_dir)
    return memory.normalise(rows.filter(F.year("session_date") == 2000), e, list(memory.STATE))


@query("analogue_pools", f"""{_STATES}, lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS r FROM st) WHERE r = 1), le AS (SELECT * FROM (SELECT lt.*, ed.*, row_number() OVER (PARTITION BY symbol ORDER BY epoch DESC) AS k FROM lt JOIN ed ON epoch <= session_date) WHERE k = 1),
qq AS (SELECT symbol AS q_symbol, le.session_date AS q_date, epoch, pos, {', '.join(f'{_PLACE.format(c=c)} AS q_{c}' for c in _STATE)} FROM le JOIN sn ON sn.session_date = le.session_date),
pp AS (SELECT st.symbol, st.session_date, sn.pos, epoch, {', '.join(f'{_PLACE.format(c=c)} AS {c}' for c in _STATE)} FROM st JOIN sn USING (session_date) JOIN (SELECT * FROM ed WHERE epoch IN (SELECT epoch FROM qq)) e ON true),
dd AS (SELECT q_symbol, q_date, sqrt({' + '.join(f'pow(q_{c} - {c}, 2)' for c in _STATE)}) AS d FROM qq JOIN pp ON pp.epoch = qq.epoch AND pp.pos <= qq.pos - 5 AND symbol <> q_symbol)
SELECT q_symbol, q_date, count(*) AS pool_size, round(median(d), 4) AS pool_median, round(quantile_cont(d, 0.01), 4) AS distance_cut FROM dd GROUP BY 1, 2 HAVING count(*) >= 20""", dates=("q_date",))
def _pools(spark, sf_dir):
    """Of each series' last state: its pool of other series' earlier states, their median distance, and the cut."""
    rows, e = _memory(spark, sf_dir)
    x = memory.nearest(rows, memory.latest(rows), list(memory.STATE), e)
    return rounded(x.groupBy("q_symbol", "q_date").agg(F.first("pool_size").alias("pool_size"), F.first("pool_median").alias("pool_median"), F.first("distance_cut").alias("distance_cut")), 4)


def _asked(spark, sf_dir, scope: str):
    rows, e = _memory(spark, sf_dir)
    return memory.nearest(rows, memory.latest(rows), list(memory.STATE), e, scope)


_NEIGHBOURS = ["q_symbol", "q_date", "rank", "symbol", "session_date", "distance", "close"]


@query("analogues_cross")
def _cross(spark, sf_dir):
    """For each series' last state, as where no session is named: the 200 nearest earlier states of other series, five
    sessions apart, of which those within the closest hundredth of the pool are close."""
    return _asked(spark, sf_dir, "cross").select(*_NEIGHBOURS)


@query("analogues_self")
def _self(spark, sf_dir):
    """The same among a series' own states."""
    return _asked(spark, sf_dir, "self").select(*_NEIGHBOURS)


@query("analogue_summary")
def _summary(spark, sf_dir):
    """What followed the close states, and how strong that evidence is, for both scopes apart."""
    both = [memory.evidence(_asked(spark, sf_dir, s)).withColumn("scope", F.lit(s)) for s in ("self", "cross")]
    return both[0].unionByName(both[1])


@query("evidence_features")
def _evidence(spark, sf_dir):
    """Analogue evidence of every fifth session: 100 of a spread of 60,000 earlier states, and 25 of a series' own."""
    rows, e = _memory(spark, sf_dir)
    return memory.evidence_features(rows, list(memory.STATE), e)


@query("evidence_audit")
def _evidence_audit(spark, sf_dir):
    """Seven counts of what may have gone wrong with them: all 0."""
    rows, e = _memory(spark, sf_dir)
    f = memory.evidence_features(rows, list(memory.STATE), e)
    days = nation_days(spark, sf_dir).select("symbol", "session_date")
    columns = [c for c in f.columns if c not in ("symbol", "session_date")]
    return memory.audit_evidence(f, days, panel.asof_attach(days, f, columns))


@query("knn_topk", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS v FROM embeddings), d AS (SELECT q.vec_id AS q_id, e.vec_id AS id, list_distance(q.v, e.v) AS distance FROM e q JOIN e ON q.vec_id % 20 = 0 AND e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, id)::INTEGER AS rank FROM d) SELECT q_id, id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10""", dates=())
def _knn(spark, sf_dir):
    """The stated query set, every id divisible by 20, against all vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return rounded(research.knn(v, v.filter("id % 20 = 0")))


# Audit of features.
_AUDIT = ["D_range_pct", "D_gap_pct", "D_dvol_z252", "D_body_ratio"]


@query("feature_hygiene", f"""{sql.layered(sql.BARS_BRAND, _AUDIT)}, u AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v FROM x" for c in _AUDIT)}),
s AS (SELECT feature, count(*) AS rows, avg((v IS NOT NULL)::INTEGER) AS coverage, count(DISTINCT v) AS n_unique, stddev_samp(v) AS std, quantile_cont(v, [0.01, 0.25, 0.75, 0.99]) AS q FROM u GROUP BY 1),
t AS (SELECT u.feature, count(*) FILTER (v < q[1] - 10 * (q[3] - q[2]) OR v > q[4] + 10 * (q[3] - q[2])) AS beyond FROM u JOIN s USING (feature) GROUP BY 1)
SELECT feature, round(coverage, 6) AS coverage, n_unique, round(std, 5) AS std, round(CASE WHEN q[3] - q[2] > 0 THEN beyond / rows ELSE 0 END, 6) AS tail_share, CASE WHEN coverage < 0.6 THEN 'sparse' WHEN n_unique <= 1 OR std < 1e-10 THEN 'constant' END AS fails FROM s JOIN t USING (feature)""", dates=())
def _hygiene(spark, sf_dir):
    return rounded(audit.hygiene(FEATURES.with_columns(brand_weeks(spark, sf_dir), _AUDIT), _AUDIT), 6, std=5)


_IC = ["D_range_pct", "D_body_ratio"]


def _ic_sql(source: str, by: str = "") -> str:
    """Table `ic`: mean rank correlation over sessions of each feature (and `by`) with the return of five bars."""
    u = " UNION ALL ".join(f"SELECT {by}'{c}' AS feature, session_date, {c}::DOUBLE AS v, f AS y FROM {source} WHERE {c} IS NOT NULL AND f IS NOT NULL" for c in _IC)
    rank = lambda v: f"rank() OVER (PARTITION BY {by}feature, session_date ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}feature, session_date, {v}) - 1) / 2.0"
    return f"""u AS ({u}), rk AS (SELECT {by}feature, session_date, v, {rank('v')} AS rv, {rank('y')} AS ry FROM u),
d AS (SELECT {by}feature, session_date, corr(rv, ry) AS ic FROM rk GROUP BY {by}feature, session_date HAVING count(*) >= 20 AND count(DISTINCT v) >= 3), ic AS (SELECT {by}feature, count(ic) AS sessions, avg(ic) AS ic, stddev_samp(ic) AS ic_std FROM d GROUP BY {by}feature)"""


_LABELLED = f"{sql.layered(sql.BARS_BRAND, _IC)}, l AS (SELECT *, lead(close, 5) OVER ({_V}) / close - 1 AS f FROM x)"


def _with_returns(spark, sf_dir):
    return base_labels(FEATURES.with_columns(brand_weeks(spark, sf_dir), _IC))


@query("rank_ic", f"{_LABELLED}, {_ic_sql('l')} SELECT feature, sessions, round(ic, 6) + 0.0 AS ic, round(ic_std, 6) AS ic_std FROM ic", dates=())
def _ic(spark, sf_dir):
    return rounded(audit.rank_ic(_with_returns(spark, sf_dir), _IC, "label_fwd_ret_5d"))


_ERA = "p AS (SELECT *, row_number() OVER (ORDER BY session_date, symbol) - 1 AS pos, count(*) OVER () AS n FROM l), le AS (SELECT *, greatest(1, (pos * 3 + n - 2) // (n - 1))::INTEGER AS era FROM p)"


@query("feature_stability", f"{_LABELLED}, {_ERA}, {_ic_sql('le', 'era, ')}, s AS (SELECT feature, max(ic) FILTER (era = 1) AS era1, max(ic) FILTER (era = 2) AS era2, max(ic) FILTER (era = 3) AS era3, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, sum(sign(ic)) AS sg, sum(abs(sign(ic))) AS sa FROM ic GROUP BY 1) SELECT feature, round(era1, 6) + 0.0 AS era1, round(era2, 6) + 0.0 AS era2, round(era3, 6) + 0.0 AS era3, round(ic_mean, 6) + 0.0 AS ic_mean, round(ic_std, 6) AS ic_std, sa > 0 AND abs(sg) = sa AS sign_stable FROM s", dates=())
def _stable(spark, sf_dir):
    return rounded(audit.stability(_with_returns(spark, sf_dir), _IC, "label_fwd_ret_5d"))


@query("feature_correlations", f"{sql.layered(sql.BARS_BRAND, _AUDIT)} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count({a} + {b}) AS n, round(corr({a}, {b}), 6) + 0.0 AS r FROM x HAVING count({a} + {b}) >= 200" for i, a in enumerate(_AUDIT) for b in _AUDIT[i + 1 :]), dates=())
def _correlations(spark, sf_dir):
    return rounded(audit.correlations(FEATURES.with_columns(brand_weeks(spark, sf_dir), _AUDIT), _AUDIT))


_RANK = "CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY session_date ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY session_date, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY session_date) END - 0.5"
_REPRESENTATIVES = {"location": "D_pos_in_52w_range", "momentum": "D_rsi14", "trend": "D_ema20_angle_deg", "volatility": "D_atr_pct", "volume": "D_dvol_z20"}
_PAIRS = [(a, b) for i, a in enumerate(_REPRESENTATIVES) for b in list(_REPRESENTATIVES)[i + 1 :]]


@query("interactions", f"{sql.layered(sql.BARS_BRAND, list(_REPRESENTATIVES.values()))}, r AS (SELECT symbol, session_date, {', '.join(f'{_RANK.format(c=c)} AS {k}' for k, c in _REPRESENTATIVES.items())} FROM x) SELECT symbol, session_date, {', '.join(f'round({a} * {b}, 8) + 0.0 AS ix_{a}_{b}' for a, b in _PAIRS)} FROM r")
def _interactions(spark, sf_dir):
    """Ten pairs of five categories."""
    x = FEATURES.with_columns(brand_weeks(spark, sf_dir), list(_REPRESENTATIVES.values())).select("symbol", "session_date", *_REPRESENTATIVES.values())
    out, names = audit.interactions(x)
    return rounded(out.select("symbol", "session_date", *names), 8)


_BASES = ["D_ema20", "D_ema50", "D_atr14", "D_rsi7", "D_rsi14", "D_realvol_20", "D_realvol_60", "D_obv", "D_macd"]


@query("derived_features", f"""{sql.layered(sql.BARS_BRAND, _BASES)} SELECT symbol, session_date, round((close - D_ema20) / nullif(D_atr14, 0), 5) + 0.0 AS dist_close_ema20_atr, round((close - D_ema50) / nullif(D_atr14, 0), 5) + 0.0 AS dist_close_ema50_atr, round((D_ema20 - D_ema50) / nullif(D_atr14, 0), 5) + 0.0 AS dist_ema20_ema50_atr,
round(D_rsi7 - D_rsi14, 5) + 0.0 AS diff_rsi7_rsi14, round(D_realvol_20 / nullif(D_realvol_60, 0), 5) + 0.0 AS ratio_rvol20_60, {', '.join(f'round((D_{c} - lag(D_{c}, {n}) OVER ({_V})) / nullif(D_atr14, 0), 5) + 0.0 AS {c}_slope{n}' for c, n in (('ema20', 3), ('ema20', 5), ('ema50', 10), ('rsi14', 5), ('obv', 5), ('macd', 5)))} FROM x""")
def _derived(spark, sf_dir):
    """All derived columns whose inputs exist."""
    out, names = audit.derive(FEATURES.with_columns(brand_weeks(spark, sf_dir), _BASES).select("symbol", "session_date", "close", *_BASES))
    return rounded(out.select("symbol", "session_date", *names), 5)


_CANDIDATES = [*memory.STATE, "D_atr_pct", "D_body_ratio", "D_cmf20", "D_macd_hist", "D_amihud_20", "D_intraday_ret_pct"]


def _modelled(spark, sf_dir, names):
    x = path_labels(base_labels(nation_days(spark, sf_dir)))
    return FEATURES.with_columns(x, list(dict.fromkeys(names)))


@query("feature_audit")
def _audited(spark, sf_dir):
    """Given, derived and crossed features with their status, three folds, ten shuffled columns a fold (no SQL can fit trees)."""
    x = _modelled(spark, sf_dir, [*_CANDIDATES, *_BASES])
    if x.select("session_date").distinct().count() < 60:
        raise ValueError("too few sessions to audit")
    return audit.audit(x, _CANDIDATES).select("feature", "kind", "coverage", "fails", "duplicate_of", "representative", "ic", "sign_stable", "delta_mean", "delta_min", "survival", "cut", "status")


@query("eras", f"SELECT greatest(1, (pos * 3 + n - 2) // (n - 1))::INTEGER AS era, count(*) AS rows, min(session_date) AS first FROM (SELECT session_date, row_number() OVER (ORDER BY session_date, symbol) - 1 AS pos, count(*) OVER () AS n FROM ({sql.BARS_BRAND})) GROUP BY 1", dates=("first",))
def _eras(spark, sf_dir):
    return research.eras(brand_weeks(spark, sf_dir)).groupBy("era").agg(F.count("*").alias("rows"), F.min("session_date").alias("first"))


# Metrics of scored rows.
_SCORED = f"s AS (SELECT symbol, session_date, CASE WHEN lead(close) OVER ({_V}) > close THEN 1 ELSE 0 END AS y, (close - low) / nullif(high - low, 0) AS score FROM ({sql.BARS_NATION})), sc AS (SELECT * FROM s WHERE score IS NOT NULL)"
_TOPS = "r AS (SELECT {by}y, row_number() OVER (PARTITION BY {by}session_date ORDER BY score DESC, symbol) AS r FROM {src}), t AS (SELECT unnest([1, 3, 5, 10]) AS top), a AS (SELECT {by}top, count(*) AS n, avg(y) AS rate FROM t JOIN r ON r <= top GROUP BY {by}top)"
_AUC = "k AS (SELECT {by}y, score, rank() OVER (PARTITION BY {part} ORDER BY score) + (count(*) OVER (PARTITION BY {part}, score) - 1) / 2.0 AS r, least(greatest(score, 1e-6), 1 - 1e-6) AS p FROM {src}), ck AS (SELECT {by}count(*) AS n, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc, avg(pow(p - y, 2)) AS brier, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS logloss, avg(y) AS base_rate FROM k GROUP BY {group})"
_DAILY = "dr AS (SELECT {by}session_date, y, rank() OVER (PARTITION BY {by}session_date ORDER BY score) + (count(*) OVER (PARTITION BY {by}session_date, score) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY {by}session_date ORDER BY y) + (count(*) OVER (PARTITION BY {by}session_date, y) - 1) / 2.0 AS ry FROM {src}), dc AS (SELECT {by}session_date, CASE WHEN stddev_pop(rs) * stddev_pop(ry) > 1e-12 THEN corr(rs, ry) END AS ic FROM dr GROUP BY {by}session_date HAVING count(*) >= 3 AND count(DISTINCT y) >= 2), dm AS (SELECT {by}count(ic) AS sessions, avg(ic) AS mean_ic, median(ic) AS median_ic FROM dc GROUP BY {group})"


def _scored(spark, sf_dir):
    b = nation_days(spark, sf_dir)
    x = b.select("symbol", "session_date", F.when(w.lead("close") > F.col("close"), 1).otherwise(0).alias("y"), w.ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")).alias("score"))
    return x.filter("score IS NOT NULL")


@query("daily_top_metrics", f"WITH {_SCORED}, {_TOPS.format(by='', src='sc')} SELECT top, n, round(rate, 6) AS rate, round(2 * sqrt(rate * (1 - rate) / n), 6) AS two_se, rate - 2 * sqrt(rate * (1 - rate) / n) > 0.424 AS clears FROM a", dates=())
def _top_metrics(spark, sf_dir):
    return rounded(research.top_n(_scored(spark, sf_dir)))


@query("classification_metrics", f"WITH {_SCORED}, {_AUC.format(by='', part='1', src='sc', group='()')} SELECT n, round(auc, 6) AS auc, round(brier, 6) AS brier, round(logloss, 6) AS logloss FROM ck", dates=())
def _classification(spark, sf_dir):
    return rounded(research.classification(_scored(spark, sf_dir)))


@query("daily_rank_correlation", f"WITH {_SCORED}, {_DAILY.format(by='', src='sc', group='()')} SELECT sessions, round(mean_ic, 6) + 0.0 AS mean_daily_spearman, round(median_ic, 6) + 0.0 AS median_daily_spearman FROM dm", dates=())
def _daily(spark, sf_dir):
    return rounded(research.daily_rank_correlation(_scored(spark, sf_dir)))


@query("fold_summary", f"""WITH {_SCORED}, f AS (SELECT *, (year(session_date) % 3)::INTEGER AS fold FROM sc), {_AUC.format(by='fold, ', part='fold', src='f', group='fold')}, {_TOPS.format(by='fold, ', src='f')}, {_DAILY.format(by='fold, ', src='f', group='fold')},
w AS (SELECT ck.fold, auc, brier, logloss, mean_ic, max(rate) FILTER (top = 1) AS t1, max(rate - 2 * sqrt(rate * (1 - rate) / a.n)) FILTER (top = 1) AS l1, max(rate) FILTER (top = 10) AS t10 FROM ck JOIN a USING (fold) JOIN dm USING (fold) GROUP BY ALL)
SELECT count(*) AS folds, round(avg(auc), 6) AS auc_mean, round(median(auc), 6) AS auc_median, round(min(auc), 6) AS auc_min, round(avg(brier), 6) AS brier_mean, round(avg(logloss), 6) AS logloss_mean, round(avg(mean_ic), 6) + 0.0 AS mean_daily_spearman_mean, round(avg(t1), 6) AS top1_realised_mean, round(min(l1), 6) AS top1_lower_2se_min, round(median(t10), 6) AS top10_realised_median, bool_and(t1 > 0.424) AS top1_all_folds_above_hurdle, bool_and(l1 > 0.424) AS top1_all_folds_clear_hurdle FROM w""", dates=())
def _folds(spark, sf_dir):
    """Metrics of three folds, summarised."""
    x = _scored(spark, sf_dir).withColumn("fold", (F.year("session_date") % 3).cast("int"))
    s = research.fold_summary(research.fold_metrics(x))
    names = ["folds", "auc_mean", "auc_median", "auc_min", "brier_mean", "logloss_mean", "mean_daily_spearman_mean", "top1_realised_mean", "top1_lower_2se_min", "top10_realised_median", "top1_all_folds_above_hurdle", "top1_all_folds_clear_hurdle"]
    return rounded(s.select(*names))


_FIVE = ["D_rsi14", "D_atr_pct", "D_ema20_angle_deg", "D_dvol_z20", "D_pos_in_52w_range"]


@query("model_tournament")
def _tournament(spark, sf_dir):
    """Seven experiments, three targets, five folds, with isotonic calibration (no SQL can fit them)."""
    return models.tournament(_modelled(spark, sf_dir, _FIVE), _FIVE)


@query("tournament_preflight")
def _preflight(spark, sf_dir):
    """Rows and base rates of each target and fold, before a long run."""
    return models.preflight(_modelled(spark, sf_dir, _FIVE), _FIVE)


@query("stratified_pool", f"WITH r AS (SELECT symbol, session_date, row_number() OVER (ORDER BY session_date, symbol) - 1 AS pos, count(*) OVER () AS n FROM ({sql.BARS_NATION})), k AS (SELECT DISTINCT floor(i * (SELECT any_value(n) FROM r) / 500.0)::BIGINT AS pos FROM range(500) t(i)) SELECT symbol, session_date FROM r SEMI JOIN k USING (pos)")
def _stratified(spark, sf_dir):
    return research.stratified(nation_days(spark, sf_dir).select("symbol", "session_date"), 500)
