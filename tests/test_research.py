import datetime
import math
import random

import numpy as np
import pytest
from scenarios import business_days

from meridion.functions import learn
from meridion.functions import windows as w
from meridion.operators import audit, memory, panel, research
from meridion.streaming import bars as streams
from pyspark.sql import functions as F


def paths(spark, rows):
    return spark.createDataFrame(rows, "symbol string, run_hi array<double>, run_lo array<double>, fwd_ret double, atr_pct double")


def scan(spark, rows, targets=(0.05,), stops=(0.03,), **k):
    return research.barrier_scan(paths(spark, rows), targets, stops, **k).first()


def test_barriers_tell_the_order(spark):
    first = scan(spark, [("a", [0.06] * 5, [0.0, 0.0, 0.0, -0.04, -0.04], 0.0, 0.02)])
    last = scan(spark, [("b", [0.0, 0.0, 0.0, 0.06, 0.06], [-0.04] * 5, 0.0, 0.02)])
    assert (first.tp_first_lo, last.tp_first_lo, first.ambiguous, last.ambiguous) == (1.0, 0.0, 0.0, 0.0)


def test_a_tie_is_a_range(spark):
    r = scan(spark, [("a", [0.06] * 5, [-0.04] * 5, 0.0, 0.03)], cost=0.0)
    assert (r.tp_first_lo, r.tp_first_hi, r.ambiguous) == (0.0, 1.0, 1.0)
    assert r.pay_lo == pytest.approx(-0.03) and r.pay_hi == pytest.approx(0.05)


def test_what_is_unresolved_pays_its_return(spark):
    row = [("a", [0.01, 0.015, 0.02, 0.02, 0.02], [-0.005, -0.005, -0.01, -0.01, -0.01], 0.02, 0.03)]
    free, paid = scan(spark, row, cost=0.0), scan(spark, row, cost=0.0035)
    assert free.neither == 1.0 and free.pay_lo == pytest.approx(0.02) and paid.pay_lo == pytest.approx(0.0165)
    # What stays unresolved pays for part of the stop.
    assert free.breakeven == pytest.approx((0.03 - 0.02) / 0.08) and paid.breakeven == pytest.approx((0.0035 + 0.03 - 0.02) / 0.08)
    assert paid.lift_needed == pytest.approx(paid.breakeven - paid.tp_first_lo)


def test_barriers_tell_the_time_and_scale(spark):
    r = scan(spark, [("a", [0.06] * 5, [0.0] * 5, 0.0, 0.03), ("b", [0.0, 0.0, 0.0, 0.0, 0.06], [0.0] * 5, 0.0, 0.03)], cost=0.0)
    assert r.within_1d == 0.5 and r.within_3d == 0.5 and r.median_days == 3.0
    two = [("a", [0.05] * 5, [0.0] * 5, 0.0, 0.015), ("b", [0.05] * 5, [0.0] * 5, 0.0, 0.06), ("c", [0.05] * 5, [0.0] * 5, 0.0, None)]
    assert scan(spark, two).tp_touch == 1.0 and scan(spark, two).n == 3
    s = scan(spark, two, (1.0,), (1.0,), scaled=True)
    assert s.tp_touch == 0.5 and s.n == 2


def test_payoffs_are_those_of_the_median_levels(spark):
    rows = [("a", [0.2] * 5, [0.0] * 5, 0.0, 0.02), ("b", [0.0] * 5, [-0.5] * 5, 0.0, 0.04), ("c", [0.2] * 5, [0.0] * 5, 0.0, 0.12)]
    r = scan(spark, rows, (1.0,), (0.5,), scaled=True, cost=0.0)
    assert r.pay_lo == pytest.approx(2 / 3 * 0.04 - 1 / 3 * 0.02) and r.reward_risk == 2.0


def states(spark, n=260, symbols=8, seed=11, bump=None):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(symbols):
        x = r.normal(size=(n, 3))
        for i, d in enumerate(business_days(n)):
            v = x[i] if bump is None or i < bump else x[i] * 50
            rows.append((f"S{k}", d, i, *map(float, v), float(x[i, 0])))
    return spark.createDataFrame(rows, "symbol string, session_date date, session_pos long, a double, b double, c double, y double"), rows


def brute(rows, q, k, scope, table, steps, percentile, lag=5, apart=5):
    """One question at a time, as it would be asked by hand."""
    place = (lambda v: np.array(v, np.float32)) if table is None else (lambda v: np.array([np.searchsorted(table[j], v[j]) / steps for j in range(3)], np.float32).clip(0, 1))
    pool = [p for p in rows if p[2] <= q[2] - lag and ((p[0] == q[0]) == (scope == "self"))]
    d = np.sqrt(((np.stack([place(p[3:6]) for p in pool]) - place(q[3:6])) ** 2).sum(1)).astype(float)
    order = sorted(range(len(pool)), key=lambda i: (d[i], pool[i][0], pool[i][2]))[: 5 * k]
    taken = []
    for i in order:
        if all(pool[j][0] != pool[i][0] or abs(pool[j][2] - pool[i][2]) >= apart for j in taken):
            taken.append(i)
    cut = np.percentile(d, percentile)
    return [(pool[i][0], pool[i][2], d[i] <= cut) for i in taken[:k]], len(pool), np.median(d), cut


@pytest.mark.parametrize("scope,shard,placed", [("self", 1 << 16, True), ("cross", 1 << 16, True), ("cross", 300, True), ("cross", 300, False)])
def test_analogues(spark, scope, shard, placed):
    df, rows = states(spark)
    days = sorted({r[1] for r in rows})
    edges = memory.quantile_edges(df, list("abc"), [days[120], days[200]], steps=20, least=10) if placed else None
    table = {e.epoch: [np.array(e[c]) for c in "abc"] for e in edges.collect()} if placed else None
    q = df.filter("session_pos in (100, 150, 250) and symbol in ('S0', 'S3')")
    got = {}
    for r in memory.nearest(df, q, list("abc"), edges, scope, k=10, percentile=2.0, outcomes=("y",), shard=shard).orderBy("rank").collect():
        got.setdefault((r.q_symbol, r.q_date), []).append(r)
    for row in rows:
        if row[2] not in (100, 150, 250) or row[0] not in ("S0", "S3"):
            continue
        if placed and row[2] == 100:
            assert (row[0], row[1]) not in got  # before any epoch
            continue
        e = table[max(x for x in table if x <= row[1])] if placed else None
        want, n, median, cut = brute(rows, row, 10, scope, e, 20, 2.0)
        mine = got[(row[0], row[1])]
        assert [(r.symbol, r.session_pos, r.close) for r in mine] == want
        assert mine[0].pool_size == n and mine[0].pool_median == pytest.approx(median, rel=1e-6 if shard > 1000 else 0.02) and mine[0].distance_cut == pytest.approx(cut, rel=1e-5)


def test_edges_are_percentiles_of_what_was_known(spark):
    df, rows = states(spark)
    days = sorted({r[1] for r in rows})
    for e in memory.quantile_edges(df, list("abc"), [days[50], days[120]], steps=40, least=500).collect():
        assert e.epoch == days[120]  # the first has too few rows before it
        for j, c in enumerate("abc"):
            assert np.allclose(e[c], np.percentile([r[3 + j] for r in rows if r[1] < e.epoch], np.linspace(0, 100, 41)))


def test_the_future_cannot_change_a_past_query(spark):
    one, _ = states(spark)
    two, _ = states(spark, bump=200)
    q = lambda df: memory.nearest(df, df.filter("session_pos = 150 and symbol = 'S1'"), list("abc"), k=10, outcomes=()).orderBy("rank").collect()
    assert q(one) == q(two)
    edge = lambda df: memory.quantile_edges(df, ["a"], [datetime.date(2021, 6, 1)], steps=10, least=10).collect()
    assert edge(one) == edge(two)


def test_evidence_needs_all_three_parts(spark):
    rows = [("Q", datetime.date(2024, 1, 1), float(d), c, 100, 2.0, 1.0, 50, 10, float(y)) for d, c, y in [(0.5, True, 1), (0.5, True, 1), (0.9, False, 0)]]
    df = spark.createDataFrame(rows, "q_symbol string, q_date date, distance double, close boolean, pool_size long, pool_median double, distance_cut double, raw int, selected int, label_touch double")
    r = memory.evidence(df).first()
    assert (r.close, r.tightness, r.agreement, r.label_touch__n) == (2, 1.0, 1.0, 2) and r.evidence == round(2 / 60, 3)
    assert "2 close" in memory.evidence_text(r)


def test_evidence_features(spark, monkeypatch):
    df, rows = states(spark)
    df = df.withColumns({"label_tp_before_sl": (F.col("y") > 0).cast("double"), "label_fwd_ret_5d": F.col("y")})
    days = sorted({r[1] for r in rows})
    edges = memory.quantile_edges(df, list("abc"), [days[120]], steps=20, least=10)
    run = lambda: sorted(map(tuple, memory.evidence_features(df, list("abc"), edges, pool=1000, top=40).collect()))
    got = run()
    fields = memory.evidence_features(df, list("abc"), edges, pool=1000, top=40).columns
    assert len(fields) == 24 and {g[1] for g in got} == set(days[120::5]) and len(got) == 8 * 28
    monkeypatch.setattr(memory, "BROADCAST", 0)
    again = run()
    assert all(a == pytest.approx(b, rel=1e-9, nan_ok=True) if isinstance(a, float) and b is not None else a == b for x, y in zip(got, again) for a, b in zip(x, y))
    # One row by hand: the spread of the pool, the cross block, the own block.
    table = [np.array(edges.first()[c]) for c in "abc"]
    place = lambda v: np.array([np.searchsorted(table[j], v[j]) / 20 for j in range(3)], np.float32).clip(0, 1)
    q = next(r for r in rows if r[0] == "S2" and r[2] == 200)
    prior = sorted((r for r in rows if r[2] <= 195), key=lambda r: (r[2], r[0]))
    pool = [prior[i] for i in memory.spread(len(prior), 1000)]
    d = np.sqrt(((np.stack([place(p[3:6]) for p in pool]) - place(q[3:6])) ** 2).sum(1))
    other = [i for i in range(len(pool)) if pool[i][0] != "S2"]
    best = sorted(other, key=lambda i: (d[i], i))[:40]
    row = dict(zip(fields, next(g for g in got if g[0] == "S2" and g[1] == q[1])))
    assert row["cross_n"] == 40 and row["cross_tp_first"] == pytest.approx(np.mean([pool[i][6] > 0 for i in best])) and row["cross_ret5"] == pytest.approx(np.mean([pool[i][6] for i in best]))
    asked = [r for r in rows if r[2] == 200]
    every = np.concatenate([np.sqrt(((np.stack([place(p[3:6]) for p in pool]) - place(a[3:6])) ** 2).sum(1)) for a in asked])
    assert row["cross_similarity"] == pytest.approx(1 - d[best].astype(float).mean() / np.median(every), rel=1e-4)
    assert row["self_available"] == 1 and row["self_n"] == 10 and row["agreement"] == pytest.approx(1 - abs(row["self_tp_first"] - row["cross_tp_first"]))
    panel_rows = df.select("symbol", "session_date")
    from meridion.operators.panel import asof_attach

    f = memory.evidence_features(df, list("abc"), edges, pool=1000, top=40)
    sound = memory.audit_evidence(f, panel_rows, asof_attach(panel_rows, f, [c for c in f.columns if c not in ("symbol", "session_date")]))
    memory.assert_sound(sound)
    with pytest.raises(ValueError):
        memory.assert_sound(memory.audit_evidence(f.unionByName(f), panel_rows, panel_rows))
    with pytest.raises(ValueError):
        memory.evidence_features(df, list("abc"), edges, pool=10)


def test_memory_on_disk(spark, tmp_path):
    df, _ = states(spark, n=30, symbols=2)
    e = memory.quantile_edges(df, list("abc"), [datetime.date(2021, 1, 20)], steps=5, least=5)
    memory.write_memory(df, e, f"file://{tmp_path}/m")
    rows, edges = memory.read_memory(spark, f"file://{tmp_path}/m")
    assert rows.count() == 60 and edges.collect() == e.collect()


def test_personality_by_hand(spark):
    r = np.random.default_rng(1)
    rows = [(f"S{k}", d, "up" if r.random() < 0.6 else "down", float(r.random() < 0.4), float(r.normal())) for k in range(3) for d in business_days(80)]
    df = spark.createDataFrame(rows, "symbol string, session_date date, regime string, a double, b double")
    got = {(g.symbol, g.session_date): g for g in research.personality_many(df, ["a", "b"], "regime").collect()}
    days = business_days(80)
    known = {(s, days[i + 5]): v for s, d, _, *v in rows if (i := days.index(d)) + 5 < 80}
    for s, d, regime, *_ in rows:
        own = [known.get((s, x)) for t, x, g, *_ in rows if t == s and g == regime and x < d]
        every = [known.get((t, x)) for t, x, g, *_ in rows if g == regime and (x, t) < (d, s)]
        g = got[(s, d)]
        mine, all_ = ([v for v in x if v] for x in (own, every))
        assert g.n == (len(mine) if own else None)
        for j, c in enumerate("ab"):
            rate = np.mean([v[j] for v in all_]) if all_ else None
            assert g[f"{c}__global"] == (pytest.approx(rate) if all_ else None)
            if own and all_:
                n = len(mine) / 5
                assert g[f"{c}__est"] == pytest.approx((n * np.mean([v[j] for v in mine]) + 50 * rate) / (n + 50) if mine else rate)
        assert g.evidence == ("insufficient" if not own or len(mine) < 25 else "weak")
    p = research.personality_many(df.withColumnsRenamed({"a": "label_touch", "b": "label_fwd_ret_5d"}), ["label_touch", "label_fwd_ret_5d"], "regime")
    assert "P(+5% within 5d)" in research.card_text(p, None, "S1", days[-1]) and "no estimate" in research.card_text(p, None, "S1", datetime.date(2000, 1, 1))


def test_audit_on_planted_columns(spark):
    r = np.random.default_rng(31)
    rows = []
    for d in business_days(130):
        y = r.normal(size=24)
        for k in range(24):
            noise = float(r.normal())
            rows.append((f"S{k}", d, float(y[k] + r.normal() > 0), float(y[k]), noise, noise, float(noise + 0.2 * r.normal()), 3.0, noise if r.random() < 0.2 else None, float(r.normal())))
    names = ["SIGNAL", "NOISE", "COPY", "NEAR", "CONST", "SPARSE", "BASE"]
    df = spark.createDataFrame(rows, "symbol string, session_date date, label_tp_before_sl double, " + ", ".join(f"{n} double" for n in names))
    h = {x.feature: x.fails for x in audit.hygiene(df, names).collect()}
    assert h == {"SIGNAL": None, "NOISE": None, "COPY": None, "NEAR": None, "CONST": "constant", "SPARSE": "sparse", "BASE": None}
    got = {x.feature: x for x in audit.audit(df, names, base=("BASE",), rounds=30, splits=3, least=20).collect()}
    status = {k: v.status for k, v in got.items()}
    assert status["CONST"] == status["SPARSE"] == "REJECT_HYGIENE" and status["COPY"] == "DUPLICATE" and got["COPY"].duplicate_of == "NOISE"
    assert status["SIGNAL"] == "KEEP" and got["SIGNAL"].survival == 1.0 and got["SIGNAL"].sign_stable and got["SIGNAL"].delta_min > 0.1
    assert "REDUNDANT_GLOBAL" in (status["NOISE"], status["NEAR"]) and "KEEP" not in (status["NOISE"], status["NEAR"])
    assert all(x.cut >= audit.LEAST_GAIN for x in got.values())
    records, chosen = audit.incremental(df, ["BASE"], ["SIGNAL", "NOISE"], splits=2, mode="greedy", rounds=20)
    first = [x for x in records.collect() if x.step == 1 and x.feature == "SIGNAL"]
    assert len(first) == 2 and all(x.delta > 0.1 for x in first) and {x.fold for x in chosen.collect()} == {1, 2}
    with pytest.raises(ValueError):
        audit.load_approved(["a", "a"], ["a"])


def test_audit_sees_all_rows(spark, monkeypatch):
    # Sizes from which an audit or a fit would see a part of the rows, if there are any.
    monkeypatch.setattr(audit, "AUDIT_ROWS", 200, raising=False)
    monkeypatch.setattr(audit.incremental, "__defaults__", tuple(200 if d == 150_000 else d for d in audit.incremental.__defaults__))
    r = np.random.default_rng(5)
    rows = []
    for d in business_days(90):
        for k in range(22):
            a, b = float(r.normal()), float(r.normal())
            rows.append((f"S{k:02}", d, float(a + b + r.normal() > 0) if r.random() > 0.02 else None, a if r.random() > 0.1 else None, b, float(r.integers(0, 9))))
    df = spark.createDataFrame(rows, "symbol string, session_date date, label_tp_before_sl double, SIGNAL double, BASE double, STEPS double").repartition(5)
    names = ["SIGNAL", "BASE", "STEPS"]
    got = {x.feature: x for x in audit.audit(df, names, base=("BASE",), rounds=10, splits=2, least=15).collect()}
    assert [got[n].n_unique for n in names] == [len({x[i] for x in rows} - {None}) for i in (3, 4, 5)]
    records, _ = audit.incremental(df, ["BASE"], ["SIGNAL", "STEPS"], splits=2, rounds=10, least=15)
    records = {(x.fold, x.feature): x for x in records.collect()}
    assert len(records) == 2 * (2 + audit.SENTINELS)
    for f in panel.folds(df, 2).collect():
        part = lambda low, high, *at: np.array([[np.nan if x[i] is None else x[i] for i in at] for x in rows if x[2] is not None and low <= x[1] <= high])
        (train, y), (test, z) = ((part(low, high, 4, 3), part(low, high, 2)[:, 0]) for low, high in ((f.train_start, f.train_end), (f.test_start, f.test_end)))
        x = records[f.fold, "SIGNAL"]
        assert x.base_auc == pytest.approx(learn.auc(z, learn.boosted(train[:, :1], y, 10).scores(test[:, :1])), abs=1e-9)
        assert x.with_auc == pytest.approx(learn.auc(z, learn.boosted(train, y, 10).scores(test)), abs=1e-9)


def test_clusters_and_duplicates():
    pairs = [("a", "b", 0.9995), ("b", "c", 0.9), ("a", "c", 0.9), ("c", "d", -0.86), ("a", "d", 0.1), ("b", "d", None)]
    assert audit.duplicates(pairs, list("abcd")) == {"b": "a"}
    assert audit.clusters(pairs, {"a": 0.01, "b": 0.02, "c": -0.5, "d": 0.1}) == {"a": "c", "b": "c", "c": "c", "d": "c"}


def test_ranks_quantiles_and_totals(spark):
    r = np.random.default_rng(2)
    v = np.round(r.normal(size=700), 1)
    below, equal = w.earlier_counts(v)
    assert below.tolist() == [int((v[:i] < x).sum()) for i, x in enumerate(v)] and equal.tolist() == [int((v[:i] == x).sum()) for i, x in enumerate(v)]
    rows = [(f"g{i % 3}", float(x) if i % 11 else None) for i, x in enumerate(r.exponential(size=5000))]
    df = spark.createDataFrame(rows, "g string, x double")
    for shares in ([0.0, 0.01, 0.5, 0.99, 1.0], [i / 200 for i in range(201)]):
        for q in w.quantiles(df, ["g"], "x", shares).collect():
            known = [x for g, x in rows if g == q.g and x is not None]
            assert q.n == len(known) and np.allclose(q.q, np.quantile(known, shares))
    t = spark.createDataFrame([(float(i), int(i % 7)) for i in r.permutation(900)], "k double, n int")
    total = 0
    for x in w.running_total(t, "k", ["n"]).orderBy("k").collect():
        assert x.n_before == total
        total += x.n


def test_stream_upserts_and_late_corrections(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    one = spark.createDataFrame([("a", datetime.date(2024, 1, 1), 1.0), ("a", datetime.date(2024, 1, 2), 2.0)], "symbol string, session_date date, close double")
    streams.upsert(one, path)
    streams.upsert(one.filter("close = 2").withColumn("close", F.lit(5.0)), path)
    n, table = streams.latest(spark, path)
    assert n == 2 and sorted(r.close for r in table.collect()) == [1.0, 5.0]


def test_knn_takes_any_number_of_queries(spark):
    x = np.random.default_rng(5).normal(size=(4300, 3)).astype(np.float32)
    x[7] = x[8] = x[9]
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id long, v array<float>")
    got = {}
    for r in research.knn(v, v, k=3, block=1000, shard=1500).orderBy("rank").collect():
        got.setdefault(r.q_id, []).append(r.id)
    x = x.astype(np.float64)
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert got[i] == np.lexsort((np.arange(len(x)), d))[:3].tolist()


def _means(rows, k=5):
    """(event_id, mean) of each series in the order of ts and event_id."""
    out, held = [], {}
    for i, ts, kind, v in sorted(rows, key=lambda r: (r[1], r[0])):
        last = held[kind] = [*held.get(kind, []), v][-k:]
        out.append((i, round(sum(last) / k, 6) if len(last) == k and None not in last else None))
    return sorted(out)


def _events(spark, rows, path, parts):
    e = spark.createDataFrame([(i, i % 7, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=t), kind, v, "{}") for i, t, kind, v in rows], "event_id long, user_id long, ts timestamp, event_type string, value double, props string")
    e.repartition(parts).write.mode("append").parquet(path)


def test_moving_average_of_files_in_any_order(spark, tmp_path):
    from meridion.plans import catalog

    r = random.Random(5)
    rows = [(i, r.randrange(500), r.choice("aaaab"), None if i % 50 == 7 else float(r.randrange(100))) for i in range(1500)] + [(2000, 3, "few", 1.0)]
    _events(spark, rows, f"{tmp_path}/events.parquet", 3)
    got = catalog.queries()["stream_moving_average"](spark, str(tmp_path))
    assert sorted((x.event_id, x.mean) for x in got.collect()) == _means(rows)


def test_moving_average_goes_on_after_a_batch(spark, tmp_path):
    rows = [(i, i, "ab"[i % 2], float(i * i % 31)) for i in range(60)]
    for part in (rows[:3], rows[3:40], rows[40:]):
        _events(spark, part, f"{tmp_path}/events", 1)
        got = streams.moving_average(streams.read_events(spark, f"{tmp_path}/events", None), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((x.event_id, None if x.mean is None else round(x.mean, 6)) for x in got.collect()) == _means(rows)


def test_correlations_of_many_columns(spark):
    r = np.random.default_rng(3)
    n, width = 500, 60
    x = r.normal(size=(n, 1)) + r.normal(size=(n, width)) * r.uniform(0.01, 3, width) + 1e5 * r.integers(0, 2, width)
    x[:, 4] = 7.0
    gone = r.random((n, width)) < 0.1
    gone[300:, 5] = True
    gone[50:, 6] = True
    names = [f"f{i}" for i in range(width)]
    df = spark.createDataFrame([[None if g else float(v) for v, g in zip(a, b)] for a, b in zip(x, gone)], ", ".join(f"{c} double" for c in names)).repartition(3)
    df = df.withColumn("f7", F.when(F.col("f7").isNotNull() & (F.col("f0") > F.lit(float(np.sort(x[~gone[:, 0], 0])[-40]))), float("nan")).otherwise(F.col("f7")))
    got = audit.correlations(df, names)
    # The plan doesn't grow with the pairs: a whole panel's columns make thousands.
    assert len(got._jdf.queryExecution().analyzed().toJSON()) < 1_000_000
    got = {(p.a, p.b): (p.n, p.r) for p in got.collect()}
    for i in range(width):
        for j in range(i + 1, width):
            ok = ~gone[:, i] & ~gone[:, j]
            if 6 in (i, j):
                assert (names[i], names[j]) not in got
                continue
            count, value = got[names[i], names[j]]
            assert count == ok.sum()
            if 4 in (i, j):
                assert value is None
            elif 7 in (i, j):
                assert math.isnan(value)
            else:
                assert value == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-9)
