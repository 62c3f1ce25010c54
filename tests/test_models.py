import numpy as np
import pytest
from scenarios import business_days

from meridion.functions import learn
from meridion.operators import models
from pyspark.sql import functions as F

TARGETS = {"one": ("y1", 0.4), "two": ("y2", 0.5)}


def panel(spark, n=240, names=12, seed=42):
    r = np.random.default_rng(seed)
    rows = []
    for d in business_days(n):
        for k in range(names):
            a, b = r.normal(size=2)
            rows.append((f"S{k:03}", d, float(a), float(b) if r.random() < 0.9 else None, float(a + r.normal() > 0.5), float(r.random() < 0.5)))
    return spark.createDataFrame(rows, "symbol string, session_date date, f1 double, f2 double, y1 double, y2 double")


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(models, "EXPERIMENTS", {"boosted": ("boosted", {"rounds": 20, "depth": 3}), "logistic": ("logistic", {}), "random_trees": ("random_trees", {"trees": 15, "depth": 4, "least": 10}), "ranking": ("ranking", {"rounds": 15, "depth": 3})})
    monkeypatch.setattr(models, "LEAST_FIT", 100)
    monkeypatch.setattr(models, "LEAST_CAL", 50)


def test_every_family_learns():
    r = np.random.default_rng(0)
    x = r.normal(size=(6000, 4))
    y = (x[:, 0] + 0.7 * x[:, 1] + r.normal(size=6000) > 0.3).astype(float)
    x[::9, 2] = np.nan
    for family, parameters in (("boosted", {"rounds": 40}), ("logistic", {}), ("random_trees", {"trees": 40, "depth": 6}), ("ranking", {"rounds": 40})):
        m = models.train(family, parameters, x[:4000], y[:4000], np.arange(4000) // 25, 1)
        assert learn.auc(y[4000:], models.raw_scores(family, m, x[4000:])) > 0.75, family
    with pytest.raises(ValueError):
        models.train("none", {}, x, y, y, 0)


def test_isotonic_and_auc_by_hand():
    r = np.random.default_rng(1)
    s, y = np.round(r.random(300), 2), (r.random(300) < 0.5).astype(float)
    knots = learn.isotonic(s, y)
    fitted = learn.calibrated(knots, s)
    assert (np.diff(fitted[np.argsort(s, kind="stable")]) >= -1e-12).all() and fitted.mean() == pytest.approx(y.mean())
    # No increasing map is closer: pooled blocks have the mean of their rows.
    for v in np.unique(fitted):
        assert y[fitted == v].mean() == pytest.approx(v)
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a, p in zip(s, y) if p for b, q in zip(s, y) if not q]
    assert learn.auc(y, s) == pytest.approx(np.mean(pairs)) and np.isnan(learn.auc(np.ones(3), s[:3]))


def test_tournament_scores_every_unit(spark):
    df = panel(spark)
    got = models.tournament(df, ["f1", "f2"], targets=TARGETS, splits=3)
    rows = got.collect()
    assert {(r.experiment, r.target, r.fold) for r in rows} == {(e, t, k) for e in models.EXPERIMENTS for t in TARGETS for k in (1, 2, 3)}
    assert len(rows) == 4 * 2 * 3 * 60 * 12 and all(0 <= r.p_cal <= 1 for r in rows)
    one = [r for r in rows if r.experiment == "boosted" and r.target == "one"]
    assert learn.auc(np.array([r.y for r in one]), np.array([r.p_cal for r in one])) > 0.7
    report = {(r.experiment, r.target): r for r in models.report(got.filter("experiment = 'logistic'"), TARGETS).collect()}
    assert report["logistic", "one"].auc_mean > 0.7 > 0.6 > report["logistic", "two"].auc_mean and report["logistic", "one"].folds == 3
    ready = models.preflight(df, ["f1"], TARGETS, 3).collect()
    assert len(ready) == 6 and all(r.test == 720 for r in ready)


def test_a_broken_run_goes_on(spark, tmp_path):
    df, path, said = panel(spark, 200), f"file://{tmp_path}/t", []
    run = lambda **k: models.tournament(df, ["f1"], path, ["logistic"], TARGETS, 3, progress=said.append, **k)
    first = sorted(map(tuple, run().collect()))
    assert len(said) == 6
    units = sorted(tmp_path.glob("t/*"))
    assert len(units) == 2
    (units[0] / "_SUCCESS").unlink()  # half-written
    next(units[0].glob("part-*")).unlink()
    assert sorted(map(tuple, run().collect())) == first and len(said) == 9
    assert sorted(map(tuple, run().collect())) == first and len(said) == 9
    assert models.tournament(df.withColumn("f1", -F.col("f1")), ["f1"], path, ["logistic"], TARGETS, 3, hours=0.0).count() == 0  # another panel, no time
    with pytest.raises(ValueError):
        models.tournament(df, ["f9"], path)


def test_forest_on_the_cluster(spark):
    r = np.random.default_rng(3)
    rows = [(d, f"S{k}", float(x > 0), float(x)) for d in business_days(60) for k, x in enumerate(r.normal(size=4))]
    df = spark.createDataFrame(rows, "session_date date, symbol string, y double, x double")
    early = F.col("session_date") < F.lit(business_days(60)[40])
    m = models.fit(df.filter(early), ["x"], "forest")
    got = models.calibrate(models.score(m, df.filter(early)), models.score(m, df.filter(~early))).collect()
    assert len(got) == 80 and all((g.p_cal > 0.5) == (g.y == 1) for g in got if abs(g.score - 0.5) > 0.3)
