import datetime
import hashlib

import pytest
from scenarios import business_days, series
from pyspark.sql import functions as F

from meridion.operators import ingest, panel, quality
from meridion.sources import cache, files, settings

NAMES = ["D_rsi14", "D_sma20", "D_dollar_vol"]


@pytest.fixture(scope="module")
def universe(spark):
    rows = [r for k in range(6) for r in series(f"S{k}", 90, k)]
    return spark.createDataFrame(rows, "symbol string, session_date date, open double, high double, low double, close double, volume double").cache()


def build(b, **k):
    return panel.build_panel(b, NAMES, least_names=4, least_bars=30, **k)


@pytest.fixture(autouse=True)
def short_warmup(monkeypatch):
    import meridion.operators.features as fx

    monkeypatch.setattr(fx, "WARMUP", 20)


def test_a_rebuild_of_recent_sessions_equals_the_full_build(spark, universe):
    since = business_days(90)[70]
    full = build(universe, least_turnover=1.0).filter(F.col("session_date") >= F.lit(since)).orderBy("symbol", "session_date").collect()
    assert build(universe, least_turnover=1.0, since=since).orderBy("symbol", "session_date").collect() == full and len(full) == 120


def test_incremental_panel_on_disk(spark, universe, tmp_path):
    path = f"file://{tmp_path}/p"
    settings = {"names": NAMES, "least_names": 4, "least_bars": 30}
    cut = business_days(90)[80]
    assert panel.update_panel(universe.filter(F.col("session_date") < F.lit(cut)), path, **settings) == "full"
    assert panel.update_panel(universe, path, **settings) == "incremental"
    stored = spark.read.parquet(f"{path}/panel").drop("month").orderBy("symbol", "session_date").collect()
    assert [tuple(r) for r in stored] == [tuple(r) for r in build(universe).orderBy("symbol", "session_date").collect()]
    meta = panel.read_meta(spark, path)
    assert meta["mode"] == "incremental" and meta["rows"] == len(stored) and meta["symbols"] == 6 and meta["labels_pending"] == 30
    # Another universe: a full build, which leaves no row and no month of the old one.
    late = universe.filter(F.col("symbol").isin("S0", "S1", "S2", "S3") & (F.col("session_date") >= F.lit(business_days(90)[25])))
    assert panel.update_panel(late, path, **settings) == "full"
    stored = spark.read.parquet(f"{path}/panel")
    assert {r.symbol for r in stored.select("symbol").distinct().collect()} == {"S0", "S1", "S2", "S3"} and stored.count() == build(late).count()
    assert not set(panel.DROPPED) & set(stored.columns)


def test_liquidity_is_point_in_time(spark, bars):
    rows = [list(r) for r in series("DYING", 120, 1) + series("RISING", 120, 2)]
    for i, r in enumerate(rows):
        late = i % 120 >= 60
        r[6] = 1.0 if (r[0] == "DYING") == late else 1e6
    kept = panel.liquidity_floor(bars([tuple(r) for r in rows]), 1e6).groupBy("symbol").agg(F.min("session_date").alias("a"), F.max("session_date").alias("b")).collect()
    by = {r.symbol: r for r in kept}
    days = business_days(120)
    assert by["DYING"].b < days[110] and by["RISING"].a > days[60] and by["RISING"].b == days[-1]


def test_folds_and_embargo(spark, universe):
    f = panel.folds(universe, n=3).orderBy("fold").collect()
    days = business_days(90)
    assert [days.index(x.test_start) - days.index(x.train_end) for x in f] == [6, 6, 6]
    assert all(a.test_end < b.test_start for a, b in zip(f, f[1:])) and f[-1].test_end == days[-1]
    with pytest.raises(ValueError):
        panel.folds(universe, embargo=2)


def test_columns_with_a_role():
    assert panel.feature_columns(["symbol", "D_rsi14", "label_mfe_5d", "future_vol_10d", "ret_5d_close_pct", "_n", "X_rank_a"]) == ["D_rsi14", "X_rank_a"]
    with pytest.raises(ValueError):
        panel.assert_no_forward_columns(["D_a", "future_vol"])
    assert panel.build_signature(["a", "b"], floor=1) == panel.build_signature(["b", "a"], floor=1) != panel.build_signature(["a"], floor=1)
    assert panel.build_signature(["a"], floor=1) != panel.build_signature(["a"], floor=0)
    assert len(panel.CROSS_SECTION) == 21 and panel.universe_hash(["b", "a"]) == hashlib.sha256(b"a|b").hexdigest()[:16]


def test_asof_holds_backward_only(spark):
    p = spark.createDataFrame([("a", datetime.date(2024, 1, d)) for d in (1, 3, 5)] + [("b", datetime.date(2024, 1, 5))], "symbol string, session_date date")
    f = spark.createDataFrame([("a", datetime.date(2024, 1, 3), 7.0), ("a", datetime.date(2024, 1, 6), 9.0)], "symbol string, session_date date, x double")
    got = sorted((r.symbol, r.session_date.day, r.x) for r in panel.asof_attach(p, f, ["x"]).collect())
    assert got == [("a", 1, None), ("a", 3, 7.0), ("a", 5, 7.0), ("b", 5, None)]


def exchange():
    days = business_days(120)
    rows = []
    for k in range(14):
        keep = set(days) - {days[50]}
        if k == 0:
            keep -= set(days[60:70])
        if k == 1:
            keep -= {days[i] for i in (5, 15, 25, 35, 75)}
        if k == 2:
            keep = {d for d in keep if d >= days[80]}
        rows += [(f"S{k:02}", d, 10.0, 11.0, 9.0, 10.0, 100.0) for d in sorted(keep)]
    return days, rows


def meta_of(spark, rows, **more):
    n = {}
    for r in rows:
        n[r[0]] = n.get(r[0], 0) + 1
    return spark.createDataFrame([(k, more.get(k, {}).get("rows", v), more.get(k, {}).get("kind", "equity"), more.get(k, {}).get("exchange", "NSE"), more.get(k, {}).get("schema", "v")) for k, v in n.items()], "symbol string, rows long, series_kind string, exchange string, schema_version string")


def test_absences_and_gate(spark, bars):
    days, rows = exchange()
    b, published = bars(rows), spark.createDataFrame([(d,) for d in days], "session_date date")
    c = quality.build_calendar(b, None, published)
    assert c.source == "consensus" and c.trusted and c.counts == {"consensus": 119, "authoritative": 120}
    assert [tuple(r) for r in c.disagreements.collect()] == [(days[50], "authoritative", "consensus")]
    kinds = {}
    for r in quality.classify_absences(b, c.sessions).collect():
        kinds[(r.symbol, r.kind)] = kinds.get((r.symbol, r.kind), 0) + 1
    assert kinds == {("S00", "suspension"): 10, ("S01", "isolated"): 5}
    meta = meta_of(spark, rows, S03={"rows": 1}, S04={"schema": "old"})
    status = {r.symbol: (r.status, r.reasons) for r in quality.gate(b, c, meta, "v").collect()}
    assert status["S01"] == ("QUARANTINE", ["isolated absences"]) and status["S00"] == ("PASS", [])
    assert status["S03"][1] == ["rows differ from the metadata"] and status["S04"][1] == ["other schema"]
    assert {r.status for r in quality.gate(b, c).collect()} == {"QUARANTINE"}  # no metadata
    alone = quality.build_calendar(b)
    assert alone.source == "consensus" and not alone.trusted
    closed = quality.gate(b, alone, meta)
    assert closed.filter("status <> 'QUARANTINE'").count() == 0
    with pytest.raises(ValueError):
        quality.assert_ready(closed)
    blunt = {r.symbol: r.reasons for r in quality.gate(b, c, meta, classified=False).collect()}
    assert blunt["S00"] == ["missing sessions"]
    few = quality.build_calendar(bars([r for r in rows if r[0] < "S05"]), "S00")
    assert few.source == "reference" and not few.trusted and len(few.notes) == 3
    report = quality.gate_report(quality.gate(b, c, meta, "v")).first()
    assert (report.requested, report.quarantined, report.quarantine[0].symbol) == (14, 3, "S01")


def test_gate_of_futures(spark, bars):
    days, rows = exchange()
    flat = lambda s, keep: [(s, d, 10.0, 11.0, 9.0, 10.0, 100.0) for d in keep]
    rows = [r for r in rows if r[0] > "S01"] + flat("T0", days) + flat("CRUDE", days) + flat("GOLD", [d for i, d in enumerate(days) if i % 10 or not i or i > 110]) + flat("LONE", days)
    future = lambda e: {"kind": "futures", "exchange": e}
    meta = meta_of(spark, rows, CRUDE=future("MCX"), GOLD=future("MCX"), LONE=future("CDS"))
    published = spark.createDataFrame([(d,) for d in days], "session_date date")
    c = quality.build_calendar(bars(rows), None, published, meta.select("symbol", F.col("series_kind").alias("kind")))
    got = {r.symbol: (r.status, r.reasons, r.warnings) for r in quality.gate(bars(rows), c, meta).collect()}
    assert got["CRUDE"] == ("PASS", [], []) and got["GOLD"][1] == ["sessions that peers have"] and got["LONE"][1] == ["no peers to verify completeness"]
    kept = {r.symbol: (r.status, r.warnings) for r in quality.gate(bars(rows), c, meta, allow_unverified=True).collect()}
    assert kept["LONE"] == ("PASS_UNVERIFIED", ["no peers to verify completeness"])
    roll = bars(rows).withColumn("d_roll", F.when(F.col("symbol").isin("CRUDE", "T0"), 0).cast("tinyint"))
    got = {r.symbol: r.reasons for r in quality.gate(roll, c, meta).collect()}
    assert got["T0"] == ["roll marks on a series without contracts"] and "unknown roll" in got["GOLD"] and got["CRUDE"] == []
    suspects = spark.createDataFrame([("S05",)], "symbol string")
    assert {r.symbol: r.reasons for r in quality.gate(bars(rows), c, meta, suspects=suspects).collect()}["S05"] == ["split suspects"]
    silent = bars([r if r[0] != "S06" else (*r[:6], None) for r in rows])
    assert {r.symbol: r.reasons for r in quality.gate(silent, c, meta).collect()}["S06"] == ["no volume"]


def test_market_wide_outage(spark, bars):
    days, rows = exchange()
    out = [r for r in rows if not (r[1] == days[90] and int(r[0][1:]) < 6)]
    s = quality.consensus_sessions(bars(rows), share=0.5)
    got = quality.classify_absences(bars([r for r in rows if not (r[1] == days[90] and int(r[0][1:]) < 8)]), s).filter(F.col("session_date") == F.lit(days[90]))
    assert {r.kind for r in got.collect()} == {"market_wide"}
    assert {r.kind for r in quality.classify_absences(bars(out), s).filter(F.col("session_date") == F.lit(days[90])).collect()} == {"isolated"}


def test_orphans_splits_and_merge(spark, bars):
    old = series("O", 30, 1, start=datetime.date(2015, 1, 5)) + series("O", 300, 2)
    assert ingest.trim_orphans(bars(old)).count() == 300
    assert ingest.trim_orphans(bars(series("Q", 300, 1, start=datetime.date(2015, 1, 5)) + series("Q", 100, 2))).count() == 400
    def jump(ratio, volume, revert=False, wide=False):
        rows = [list(r) for r in series("S", 60, 3)]
        c = rows[29][5]
        for i, r in enumerate(rows):
            k = 1 / ratio if i >= 30 and not (revert and i > 31) else 1.0
            r[2:6] = [c * k, c * k * (1.3 if wide and i == 30 else 1.002), c * k * 0.998, c * k]
            r[6] = 100.0 * (volume if i >= 30 else 1.0)
        return [(g.session_date == rows[30][1], g.nearest_split, g.confidence) for g in ingest.split_suspects(bars([tuple(r) for r in rows])).collect()]

    assert jump(5.0, 5.0) == [(True, 5.0, "high")] and jump(5.0, 1.2) == [(True, 5.0, "medium")]
    assert jump(0.2, 0.2) == [(True, 5.0, "high")] and jump(0.2, 0.8) == [(True, 5.0, "medium")]  # a merger of shares, folded
    assert jump(20.0, 20.0) == [(True, 20.0, "high")] and jump(100.0, 100.0)[0][1] == 100.0 and jump(2.5, 2.5)[0][1] == 2.5 and jump(5 / 3, 2.0)[0][1] == pytest.approx(5 / 3)
    assert jump(1 / 1.41, 0.5)[0][1] == pytest.approx(7 / 5) and jump(7.0, 7.0) == [] and jump(1.3, 2.0) == []
    # A fall that is taken back isn't one; the way back, which lasts, looks like one.
    assert [at for at, *_ in jump(5.0, 5.0, revert=True)] == [False] and jump(2.0, 2.0, wide=True) == []
    a = series("M", 20, 4)
    new = [(s, d, o, h, l, c + 1, v) for s, d, o, h, l, c, v in a[15:]]
    merged = ingest.merge(ingest.merge(bars(a), bars(new)), bars(new)).orderBy("session_date").collect()
    assert len(merged) == 20 and merged[-1].close == a[-1][5] + 1 and merged[0].close == a[0][5]
    twice = bars([a[3], (*a[3][:5], 999.0, a[3][6])])
    assert {r.close for r in ingest.merge(bars(a), twice).filter(F.col("session_date") == F.lit(a[3][1])).collect()} == {999.0}
    stamped = twice.withColumn("ingested_at", F.when(F.col("close") == 999.0, 1).otherwise(2))
    assert {r.close for r in ingest.merge(bars(a), stamped).filter(F.col("session_date") == F.lit(a[3][1])).collect()} == {a[3][5]}


def test_reconciliation(spark, bars):
    theirs, ours = [], []
    for k, name in enumerate(("CLEAN", "SPLITMISS", "BADPRINT", "GAPPY", "NOISY", "ABSENT", "SHORT")):
        rows = series(name, 500, k)
        ours += [r for i, r in enumerate(rows) if not (name == "GAPPY" and 100 <= i < 120)]
        for i, (s, d, o, h, l, c, v) in enumerate(rows):
            f = 3.7 if name == "CLEAN" else 0.2 if name == "SPLITMISS" and i >= 300 else 1 / 1.2 if name == "BADPRINT" and i == 400 else 1.01 if name == "NOISY" and i % 2 else 1.0
            if name != "ABSENT" and (name != "SHORT" or i > 480):
                theirs.append((s, d, o, h, l, c * f, v * 2))
    asked = spark.createDataFrame([(s,) for s in ("CLEAN", "SPLITMISS", "BADPRINT", "GAPPY", "NOISY", "ABSENT", "SHORT", "NOBODY")], "symbol string")
    got = {r.symbol: r for r in ingest.reconcile(bars(ours), bars(theirs), asked).collect()}
    assert {k: r.status for k, r in got.items()} == {"CLEAN": "OK", "SPLITMISS": "CORPORATE_ACTION", "BADPRINT": "CORPORATE_ACTION", "GAPPY": "MISSING_SESSIONS", "NOISY": "MISMATCH", "ABSENT": "NO_REFERENCE_DATA", "SHORT": "TOO_LITTLE_OVERLAP", "NOBODY": "NOT_CACHED"}
    assert got["GAPPY"].missing_from_ours == 20 and got["SPLITMISS"].corporate_action_suspects[0].date == business_days(500)[300]
    assert got["BADPRINT"].worst_days[0].date in business_days(500)[400:402] and got["CLEAN"].median_volume_ratio == 0.5
    failed = spark.createDataFrame([("CLEAN", "timeout")], "symbol string, error string")
    assert ingest.reconcile(bars(ours), bars(theirs), asked, errors=failed).filter("symbol = 'CLEAN'").first().status == "SOURCE_ERROR"
    s = ingest.reconcile_summary(ingest.reconcile(bars(ours), bars(theirs), asked)).first()
    assert s.symbols_checked == 8 and s.by_status["OK"] == 1 and s.symbols_with_suspects == ["BADPRINT", "SPLITMISS"]
    assert ingest.sample_symbols(asked, 3, 1).collect() == ingest.sample_symbols(asked.repartition(3), 3, 1).collect()


def test_refresh_tells_what_to_do(spark, bars):
    a, b, c = series("SAME", 60, 1), series("NEW", 60, 2), [list(r) for r in series("SPLIT", 60, 3)]
    for i, r in enumerate(c):
        r[2:6] = [50.0, 50.1, 49.9, 50.0]
    late = [(r[0], r[1], *(x / 5 for x in r[2:6]), r[6] * 5) for r in c[50:]]
    new = bars(a[50:] + b[50:] + late).withColumn("kind", F.lit("equity"))
    merged, actions = ingest.refresh(bars(a + b[:55] + [tuple(r) for r in c[:50]]), new)
    assert {r.symbol: r.action for r in actions.collect()} == {"SAME": "unchanged", "NEW": "write", "SPLIT": "refetch"} and merged.count() == 180
    assert {r.action for r in ingest.refresh(bars([tuple(r) for r in c[:50]]), bars(late).withColumn("kind", F.lit("futures")))[1].collect()} == {"write"}


VENDOR = """
import datetime

def bars(symbol, start, end):
    yield datetime.date.fromisoformat(start), 1.0, 2.0, 0.5, float("nan") if symbol == "B" else 1.5, 10.0
"""


def test_vendor_source(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("vendor") / "sample_vendor.py"
    path.write_text(VENDOR)
    spark.sparkContext.addPyFile(str(path))
    got = files.fetch(spark, ["A", "B"], "2020-01-01", "2020-01-10", "sample_vendor:bars", days=4, rate=1000).collect()
    assert sorted((r.symbol, r.session_date.day, r.close) for r in got if r.symbol == "A") == [("A", 1, 1.5), ("A", 5, 1.5), ("A", 9, 1.5)]
    assert all(r.close is None for r in got if r.symbol == "B")


FLAKY = """
import datetime, time
from meridion.sources.files import StaleInstrument
calls = {}

def token(symbol):
    calls[symbol] = calls.get(symbol, 0) + 1
    return f"{symbol}-{calls[symbol]}"

def bars(token, start, end):
    if token.endswith("-1"):
        raise StaleInstrument(token)
    yield datetime.date.fromisoformat(start), 1.0, 2.0, 0.5, time.time(), 10.0
"""


def test_tasks_share_one_rate_and_resolve_again(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("vendor") / "flaky_vendor.py"
    path.write_text(FLAKY)
    spark.sparkContext.addPyFile(str(path))
    reader = files._VendorReader({"symbols": "A,B,C,D,E", "start": "2020-01-01", "end": "2020-01-08", "days": "4", "rate": "6", "tasks": "3"})
    parts = reader.partitions()
    assert [len(p.slices) for p in parts] == [4, 3, 3] and all(p.rate == 2.0 for p in parts)
    got = files.fetch(spark, ["A", "B", "C"], "2020-01-01", "2020-01-12", "flaky_vendor:bars", resolver="flaky_vendor:token", days=4, rate=10, tasks=1, without_volume="B").collect()
    assert len(got) == 9 and all((r.volume is None) == (r.symbol == "B") for r in got)
    at = sorted(r.close for r in got)
    assert at[-1] - at[0] >= 0.7  # nine calls and three refused ones, ten a second


def test_rate_limit_and_retry():
    now = [0.0]
    b = files.TokenBucket(2.0, 1.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        b.take()
    assert now[0] == pytest.approx(2.0)
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert files.with_retry(flaky, sleep=lambda s: None) == "ok" and len(tries) == 3


def test_symbols_from_text(spark, tmp_path):
    (tmp_path / "s.txt").write_text("Symbol\nABC, def\tABC\n\x00xyz  q\nDEF\n")
    assert [r.symbol for r in files.symbols_from_text(spark, f"file://{tmp_path}/s.txt").collect()] == ["ABC", "def", "xyz q"]
    (tmp_path / "t.csv").write_text("name,kind\nINFY,a\n infy ,b\nTCS\n\n")
    assert [r.symbol for r in files.symbols_from_text(spark, f"file://{tmp_path}/t.csv").collect()] == ["INFY", "TCS"]


def test_frame_cache_drops_the_oldest(spark):
    c = files.FrameCache(2)
    a, b = c.get("a", lambda: spark.range(3)), c.get("b", lambda: spark.range(4))
    assert c.get("a", lambda: None) is a
    c.get("c", lambda: spark.range(5))
    assert set(c.held) == {"a", "c"} and not b.is_cached


def test_sinks(spark, tmp_path):
    p = f"file://{tmp_path}"
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    files.append_csv(one, f"{p}/c")
    files.append_csv(one, f"{p}/c")
    assert spark.read.option("header", "true").csv(f"{p}/c").count() == 2
    files.append_log(one, f"{p}/l")
    files.append_log(one, f"{p}/l")
    assert [r.k for r in files.read_sidecars(spark, f"{p}/l", "k string, v int").collect()] == ["a", "a"]
    files.write_report(spark, {"b": 1}, f"{p}/r")
    files.write_report(spark, {"b": 2}, f"{p}/r")
    assert spark.read.text(f"{p}/r").collect()[0][0] == '{"b": 2}'
    pred = spark.createDataFrame([("e", 1, 0.5), ("e", 2, 0.6)], "experiment string, fold int, score double")
    files.write_predictions(pred, f"{p}/s")
    files.write_predictions(pred.filter("fold = 2").withColumn("score", F.lit(0.9)), f"{p}/s")
    assert sorted(r.score for r in spark.read.parquet(f"{p}/s").collect()) == [0.5, 0.9]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.json").write_text("{broken")
    assert files.read_sidecars(spark, f"{p}/m", "rows long").collect()[0].rows is None


def test_settings(monkeypatch):
    monkeypatch.setenv("CACHE_DAILY_ROOT", "/r")
    monkeypatch.setenv("CACHE_HISTORY_ANCHOR", "2015-01-01")
    monkeypatch.setenv("CACHE_REFETCH_TAIL_DAYS", "9")
    s = settings.Settings.from_env(tasks=5)
    assert (s.root, s.history_anchor, s.refetch_tail_days, s.tasks) == ("/r", datetime.date(2015, 1, 1), 9, 5) and s.with_updates(root="/q").root == "/q"
    monkeypatch.setenv("CACHE_HISTORY_ANCHOR", "soon")
    assert settings.Settings.from_env().history_anchor is None
    monkeypatch.delenv("CACHE_DAILY_ROOT")
    with pytest.raises(ValueError):
        settings.Settings.from_env()
    names = {x.name: x for x in settings.outside_series()}
    assert len(names) == 21 and names["GOLD"].lag_sessions == 1 and names["NIFTY50"].lag_sessions == 0 and not names["INDIAVIX"].has_volume


MARKET = """
import datetime

def bars(symbol, start, end):
    a, b = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end)
    seed = sum(map(ord, symbol))
    while a <= b:
        if a.weekday() < 5 and not (symbol == "LATE" and a < datetime.date(2024, 2, 1)):
            p = 50 + seed % 7 + (a.toordinal() * seed % 97) / 100
            yield a, p, p * 1.01, p * 0.99, p * 1.002, 1000.0
        a += datetime.timedelta(days=1)
"""


def test_a_cache_is_built_and_kept_up(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cache")
    (folder / "whole_vendor.py").write_text(MARKET)
    spark.sparkContext.addPyFile(str(folder / "whole_vendor.py"))
    names = [f"S{k:02}" for k in range(12)] + ["LATE"]
    listed = {"NSE": [{"instrument_token": i + 1, "tradingsymbol": n, "segment": "NSE", "instrument_type": "EQ"} for i, n in enumerate([*names, "NIFTY 50"])], "BSE": [], "MCX": [{"instrument_token": 900, "tradingsymbol": "GOLD24AUG", "name": "GOLD", "instrument_type": "FUT", "expiry": datetime.date(2024, 8, 5)}]}
    asked = []
    master = files.InstrumentMaster(spark, lambda e: asked.append(e) or listed[e])
    s, said = settings.Settings(f"file://{folder}/c", calls_per_second=1e6), []
    outside = [x for x in settings.outside_series() if x.name in ("NIFTY50", "GOLD")]
    go = lambda end, now, **k: cache.update(spark, s, [*names, "S00x"], outside, master, "whole_vendor:bars", datetime.date(2024, 1, 1), end, now, progress=said.append, **k)
    rep = {r.symbol: r for r in go(datetime.date(2024, 3, 29), "2024-03-28 18:00:00").collect()}
    assert len(rep) == 15 and not any(r.stale for r in rep.values() if r.symbol != "GOLD") and "S00x" not in rep
    assert rep["S01"].last == datetime.date(2024, 3, 28) and rep["GOLD"].last == datetime.date(2024, 3, 27)  # its session is still on
    assert any("unresolved: S00x" in x for x in said) and spark.read.json(f"file://{folder}/c/unresolved").first().suggestions == ["S00"]
    bars = cache.stored_bars(spark, s.root)
    meta = {r.symbol: r for r in cache.stored_meta(spark, s.root).collect()}
    assert meta["LATE"].first == datetime.date(2024, 2, 1) and meta["GOLD"].lag_sessions == 1 and meta["GOLD"].tradingsymbol == "GOLD24AUG" and bars.filter("symbol = 'NIFTY50' AND volume IS NOT NULL").count() == 0
    n = bars.count()
    go(datetime.date(2024, 4, 5), "2024-04-05 23:59:00")
    again = cache.stored_bars(spark, s.root)
    assert again.count() == n + 14 * 6 + 7 and again.groupBy("symbol", "session_date").count().filter("count > 1").count() == 0 and sorted(set(asked)) == ["BSE", "MCX", "NSE"] and len(asked) == 3
    with pytest.raises(LookupError):
        go(datetime.date(2024, 9, 2), "2024-09-02 18:00:00")  # the contract is gone


def test_completed_session_of_a_column(spark):
    t = spark.createDataFrame([("2024-03-05 15:44:59",), ("2024-03-05 15:45:00",), ("2024-03-01 00:00:00",), (None,)], "t string")
    got = [str(r.day) for r in t.select(ingest.completed_session(F.to_timestamp("t"), "15:30").alias("day")).collect()]
    assert got == ["2024-03-04", "2024-03-05", "2024-02-29", "None"]
