"""Model tournament: experiments x targets x folds, fold-local preparation, calibration, resumable units.

Fits see a bounded sample (`FIT_ROWS`, whole sessions spread over the window), so many units are fitted side by side, a
task each; the models they give are small and score every row of the test windows.  For training on all rows of a
cluster, `fit`, `score` and `calibrate` are the same steps on MLlib.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.functions import learn
from meridion.operators import panel as panels
from meridion.operators import research

#: The targets, and what a rate must clear: of the scaled bracket a measured hurdle, of the others what pays
#: the stop and the cost.
COST = 0.0035
TARGETS = {
    "atr1p5_1p0": ("label_tp_before_sl", 0.424),
    "3p2": ("label_tp_before_sl_3p2", (0.02 + COST) / (0.03 + 0.02)),
    "5p3": ("label_tp_before_sl_5p3", (0.03 + COST) / (0.05 + 0.03)),
}
#: Least rows of a fit, of its calibration and of its test; the share of a window that calibrates.
LEAST_FIT, LEAST_CAL, LEAST_TEST, CALIBRATION = 1000, 200, 200, 0.25
#: Rows that a fit sees at most.
FIT_ROWS = 2_000_000
#: id -> (family, parameters).
EXPERIMENTS: dict[str, tuple[str, dict]] = {
    "boosted": ("boosted", {"rounds": 300, "depth": 5, "rate": 0.06, "least": 200, "ridge": 1.0}),
    "boosted_shallow": ("boosted", {"rounds": 500, "depth": 3, "rate": 0.04, "least": 150, "ridge": 2.0}),
    "boosted_small": ("boosted", {"rounds": 500, "depth": 4, "rate": 0.03, "least": 50, "ridge": 3.0}),
    "logistic": ("logistic", {"penalty": 4.0}),
    "random_trees": ("random_trees", {"trees": 350, "depth": 8, "least": 80, "share": 0.8}),
    "ranking": ("ranking", {"rounds": 500, "depth": 4, "rate": 0.03, "least": 50, "ridge": 3.0}),
    "ranking_shallow": ("ranking", {"rounds": 500, "depth": 3, "rate": 0.03, "least": 150, "ridge": 3.0}),
}
FAMILIES = ("boosted", "logistic", "random_trees", "ranking")


def train(family: str, parameters: dict, x: np.ndarray, y: np.ndarray, sessions: np.ndarray, seed: int):
    """A model of a family; trees take unknown values as they are, the logistic model the medians of its fit."""
    if family == "boosted":
        return learn.boosted(x, y, **parameters)
    if family == "logistic":
        return learn.Logistic(x, y, **parameters)
    if family == "random_trees":
        return learn.random_trees(x, y, seed=seed, **parameters)
    if family == "ranking":
        return learn.ranking_trees(x, y, sessions, **parameters)
    raise ValueError(f"no family {family}")


def raw_scores(family: str, model, x: np.ndarray) -> np.ndarray:
    s = model.scores(x)
    return learn.probabilities(s) if family in ("boosted", "logistic") else s


def unit_id(**contract) -> str:
    return hashlib.sha256(json.dumps(contract, sort_keys=True, default=str).encode()).hexdigest()[:16]


def content_hash(df: DataFrame) -> str:
    """Changes with any row; the order of rows doesn't matter."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{r.n}:{r.s}"


def fold_rows(panel: DataFrame, features: list[str], targets: dict = TARGETS, splits: int = 5, embargo: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows with fold, role, features and targets; the folds)."""
    f = panels.folds(panel, splits, embargo)
    roles = panels.fit_calibration(panel, f, 1 - CALIBRATION, embargo)
    columns = [F.col(t).cast("double").alias(f"y_{k}") for k, (t, _) in targets.items()]
    rows = panel.select("symbol", "session_date", *[F.col(c).cast("double").alias(c) for c in features], *columns)
    return rows.join(F.broadcast(roles), "session_date"), f


def _models(rows: DataFrame, features: list[str], units: list[tuple], seed: int, rows_most: int) -> DataFrame:
    """experiment, target, fold, model (pickled), note: a task fits a unit on the fold's sample."""
    size = rows.filter("role <> 'test'").count()
    sample = rows.filter("role <> 'test'")
    if size > rows_most:
        sample = panels.strided_sessions(sample, rows_most)
    unit = F.array(*[F.struct(F.lit(e).alias("e"), F.lit(t).alias("t"), F.lit(k).alias("k")) for e, t, k in units])
    of = F.filter(unit, lambda u: u["k"] == F.col("fold"))
    y = F.coalesce(*[F.when(F.col("u.t") == t, F.col(f"y_{t}")) for t in sorted({t for _, t, _ in units})])
    x = sample.select("*", F.explode(of).alias("u")).select("u.e", "u.t", "fold", "role", "session_date", "symbol", *features, y.alias("y")).filter("y IS NOT NULL")

    def one(p: pd.DataFrame) -> pd.DataFrame:
        e, t, fold = p["e"].iloc[0], p["t"].iloc[0], int(p["fold"].iloc[0])
        p = p.sort_values(["session_date", "symbol"], ignore_index=True)
        fit, cal = p[p["role"] == "fit"], p[p["role"] == "cal"]
        model, note = None, ""
        if len(fit) < LEAST_FIT or len(cal) < LEAST_CAL:
            note = f"{len(fit)} rows to fit, {len(cal)} to calibrate"
        elif fit["y"].nunique() < 2:
            note = "one class to fit"
        else:
            family, parameters = EXPERIMENTS[e]
            x = lambda d: d[features].to_numpy(np.float64)
            days = fit["session_date"].to_numpy().astype("datetime64[D]").astype(np.int64)
            m = train(family, parameters, x(fit), fit["y"].to_numpy(), days, seed)
            knots = learn.isotonic(raw_scores(family, m, x(cal)), cal["y"].to_numpy()) if cal["y"].nunique() > 1 else None
            model = pickle.dumps((family, m, knots))
        return pd.DataFrame([(e, t, fold, model, note)], columns=["experiment", "target", "fold", "model", "note"])

    return x.groupBy("e", "t", "fold").applyInPandas(one, "experiment string, target string, fold int, model binary, note string")


SCORES = "experiment string, target string, fold int, session_date date, symbol string, y double, score double, p_cal double"


def _scores(rows: DataFrame, features: list[str], fitted: list) -> DataFrame:
    """Scores of all test rows by all models of their fold."""
    shared = rows.sparkSession.sparkContext.broadcast([(r.experiment, r.target, r.fold, bytes(r.model)) for r in fitted])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [(e, t, k, *pickle.loads(m)) for e, t, k, m in shared.value]
        for p in parts:
            x = p[features].to_numpy(np.float64)
            for e, t, fold, family, model, knots in models:
                at = np.flatnonzero((p["fold"] == fold) & p[f"y_{t}"].notna())
                if len(at):
                    s = raw_scores(family, model, x[at])
                    yield pd.DataFrame({"experiment": e, "target": t, "fold": fold, "session_date": p["session_date"].iloc[at], "symbol": p["symbol"].iloc[at], "y": p[f"y_{t}"].iloc[at], "score": s, "p_cal": learn.calibrated(knots, s)})

    return rows.filter("role = 'test'").mapInPandas(run, SCORES)


def tournament(panel: DataFrame, features: list[str], path: str | None = None, experiments: list[str] | None = None, targets: dict = TARGETS, splits: int = 5, embargo: int = 5, seed: int = 42, hours: float | None = None, rows_most: int = FIT_ROWS, progress=lambda m: None) -> DataFrame:
    """experiment, target, fold, session_date, symbol, y, score, p_cal of the test sessions of every unit that could be fitted.

    With a path each experiment and target is written to its own folder, named by a hash of all that decides it (the
    panel's content too); a rerun reads the complete ones and writes the others again.  After `hours` no further unit
    is begun.
    """
    experiments = list(EXPERIMENTS) if experiments is None else experiments
    panels.assert_features(features, panel.columns)
    rows, folds = fold_rows(panel, features, targets, splits, embargo)
    numbers = sorted(r.fold for r in folds.select("fold").collect())
    spark = panel.sparkSession
    if not path:
        fitted = [r for r in _models(rows, features, [(e, t, k) for e in experiments for t in targets for k in numbers], seed, rows_most).collect() if r.model is not None]
        return _scores(rows, features, fitted)
    print_of = content_hash(panel.select("symbol", "session_date", *features, *[t for t, _ in targets.values()]))
    began, out = time.monotonic(), None
    for e in experiments:
        for t, (target, hurdle) in targets.items():
            unit = f"{path}/{e}-{t}-{unit_id(experiment=EXPERIMENTS[e], target=target, hurdle=hurdle, features=features, splits=splits, embargo=embargo, calibration=CALIBRATION, rows=rows_most, seed=seed, panel=print_of)}"
            if not complete(spark, unit):
                if hours is not None and time.monotonic() - began > 3600 * hours:
                    progress(f"{e} {t}: no time left")
                    continue
                fitted = _models(rows, features, [(e, t, k) for k in numbers], seed, rows_most).collect()
                for r in fitted:
                    progress(f"{e} {t} fold {r.fold}: {r.note or 'fitted'}")
                _scores(rows, features, [r for r in fitted if r.model is not None]).write.mode("overwrite").parquet(unit)
            got = spark.read.schema(SCORES).parquet(unit)
            out = got if out is None else out.unionByName(got)
    return spark.createDataFrame([], SCORES) if out is None else out


def complete(spark: SparkSession, folder: str) -> bool:
    """Whether a folder was written to its end; a half-written one has no mark of success and is written again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))


def preflight(panel: DataFrame, features: list[str], targets: dict = TARGETS, splits: int = 5) -> DataFrame:
    """A row a target and fold: rows to fit, calibrate and test, base rate, and whether that is enough; before a long run."""
    panels.assert_features(features, panel.columns)
    rows, _ = fold_rows(panel, features, targets, splits)
    out = None
    for t, (_, hurdle) in targets.items():
        y = F.col(f"y_{t}")
        n = lambda role: F.count_if((F.col("role") == role) & y.isNotNull())  # noqa: B023,E731
        one = rows.groupBy("fold").agg(n("fit").alias("fit"), n("cal").alias("cal"), n("test").alias("test"), F.avg(y).alias("base_rate"), F.count_distinct(y).alias("classes")).withColumns({"target": F.lit(t), "hurdle": F.lit(float(hurdle))})
        out = one if out is None else out.unionByName(one)
    return out.withColumn("ready", (F.col("fit") >= LEAST_FIT) & (F.col("cal") >= LEAST_CAL) & (F.col("test") >= LEAST_TEST) & (F.col("classes") == 2))


def report(scored: DataFrame, targets: dict = TARGETS) -> DataFrame:
    """A row an experiment and target: metrics of the folds summarised.  No winner is named."""
    out = None
    for r in scored.select("experiment", "target").distinct().orderBy("experiment", "target").collect():
        x = scored.filter((F.col("experiment") == r.experiment) & (F.col("target") == r.target)).withColumn("score", F.col("p_cal"))
        one = research.fold_summary(research.fold_metrics(x, targets[r.target][1]), targets[r.target][1]).withColumns({"experiment": F.lit(r.experiment), "target": F.lit(r.target)})
        out = one if out is None else out.unionByName(one)
    return out


# The same steps on MLlib, for training on all rows.
CLUSTER_FAMILIES = {
    "logistic": lambda seed: LogisticRegression(maxIter=50, regParam=0.01, standardization=True),
    "forest": lambda seed: RandomForestClassifier(numTrees=40, maxDepth=6, seed=seed),
    "boosting": lambda seed: GBTClassifier(maxIter=20, maxDepth=4, seed=seed),
}


def fit(train_rows: DataFrame, features: list[str], family: str, seed: int = 42):
    """Medians are learned from the rows of the fold alone."""
    filled = [f"{x}__m" for x in features]
    prepare = [Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features")]
    model = CLUSTER_FAMILIES[family](seed)
    model.setLabelCol("y").setFeaturesCol("features")
    return Pipeline(stages=[*prepare, model]).fit(train_rows)


def score(model, rows: DataFrame) -> DataFrame:
    out = model.transform(rows)
    keep = [x for x in ("session_date", "symbol", "y", "fold") if x in rows.columns]
    return out.select(*keep, vector_to_array("probability")[1].alias("score"))


def calibrate(calibration: DataFrame, scored: DataFrame) -> DataFrame:
    """Isotonic map of scores to rates; with one class left, scores are only clipped."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    if calibration.select("y").distinct().count() < 2:
        return scored.withColumn("p_cal", clip(F.col("score")))
    iso = IsotonicRegression(labelCol="y", featuresCol="score", predictionCol="p_cal").fit(calibration.select("y", "score"))
    return iso.transform(scored).withColumn("p_cal", clip(F.col("p_cal")))
