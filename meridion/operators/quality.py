"""Calendar by consensus, absences, and the gate every series passes before it meets others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The share of live series that makes a session, and the series it takes to vote; the share of absent
#: ones that makes a date market-wide; the run of sessions that makes a suspension.
LEAST_SHARE, LEAST_LIVE, MARKET_WIDE, SUSPENSION = 0.60, 10, 0.50, 5
#: Futures on an exchange that can vouch for each other; missing sessions and sessions behind that pass.
LEAST_PEERS, MOST_ISOLATED, MOST_STALE = 2, 3, 1
EPSILON = 1e-9
#: Columns that each kind of series must have.
REQUIRED = {"equity": ("open", "high", "low", "close", "volume"), "index": ("open", "high", "low", "close"), "futures": ("open", "high", "low", "close", "volume")}


def spans(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("session_date").alias("first"), F.max("session_date").alias("last"))


def live_counts(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """For each of the dates (and those on which a series begins or ends): series whose span covers it.

    Coverage is a running sum of starts and ends over dates, not a range join of dates with spans.
    """
    s = spans(bars)
    starts = s.select(F.col("first").alias("session_date"), F.lit(1).alias("a"), F.lit(0).alias("z"))
    ends = s.select(F.col("last").alias("session_date"), F.lit(0).alias("a"), F.lit(1).alias("z"))
    none = dates.select("session_date", F.lit(0).alias("a"), F.lit(0).alias("z"))
    x = starts.unionByName(ends).unionByName(none).groupBy("session_date").agg(F.sum("a").alias("a"), F.sum("z").alias("z"))
    along = Window.orderBy("session_date")
    live = F.sum("a").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce(F.sum("z").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.select("session_date", live.alias("live"))


def live_and_present(bars: DataFrame) -> DataFrame:
    """For each date of a bar: series that traded, and series whose span covers it."""
    present = bars.groupBy("session_date").agg(F.count_distinct("symbol").alias("present"))
    return present.join(live_counts(bars, present), "session_date")


def consensus_sessions(bars: DataFrame, share: float = LEAST_SHARE, least: int = LEAST_LIVE) -> DataFrame:
    """Dates on which enough of the live series traded; none where fewer than `least` series can vote."""
    voters = bars.agg(F.count_distinct("symbol").alias("_voters"))
    x = live_and_present(bars).join(F.broadcast(voters)).filter((F.col("_voters") >= least) & (F.col("present") / F.col("live") >= share))
    return x.select("session_date", "present", "live", (F.row_number().over(Window.orderBy("session_date")) - 1).alias("session_pos"))


@dataclass(frozen=True)
class Calendar:
    """Sessions (session_date, session_pos), the source they come from, whether another source bears them out, how many
    sessions each source has, and the dates on which sources disagree (date, has, lacks)."""

    sessions: DataFrame
    source: str
    trusted: bool
    counts: dict[str, int]
    disagreements: DataFrame
    notes: tuple[str, ...]


def build_calendar(bars: DataFrame, reference: str | None = None, published: DataFrame | None = None, kinds: DataFrame | None = None) -> Calendar:
    """The consensus of equities and indices, else the published calendar, else the reference series' own sessions.

    It is trusted if it is the consensus and at least one other source exists.  Sources are compared where their spans
    overlap.  A source is as long as a calendar, some thousand dates, which the driver holds.
    """
    home = bars
    if kinds is not None:
        home = bars.join(kinds.filter(~F.col("kind").isin("equity", "index")).select("symbol"), "symbol", "left_anti")
    sources = {"consensus": consensus_sessions(home).select("session_date")}
    if published is not None:
        sources["authoritative"] = published.select("session_date").distinct()
    if reference is not None:
        sources["reference"] = bars.filter(F.col("symbol") == reference).select("session_date").distinct()
    days = {k: sorted(r[0] for r in v.collect()) for k, v in sources.items()}
    there = [k for k in ("consensus", "authoritative", "reference") if days.get(k)]
    notes = []
    if "consensus" not in there:
        notes.append(f"no consensus: it takes {LEAST_LIVE} series")
    if there[:1] == ["reference"]:
        notes.append("single source: a gap of the reference hides gaps everywhere else")
    source = there[0] if there else "none"
    differ = []
    for a, b in (("authoritative", "consensus"), ("authoritative", "reference"), ("consensus", "reference")):
        if a in there and b in there:
            lo, hi = max(days[a][0], days[b][0]), min(days[a][-1], days[b][-1])
            one, two = ({d for d in days[k] if lo <= d <= hi} for k in (a, b))
            differ += [(d, a, b) for d in sorted(one - two)] + [(d, b, a) for d in sorted(two - one)]
    trusted = source == "consensus" and len(there) >= 2
    if not trusted:
        notes.append("untrusted: it takes a consensus and one independent source")
    spark = bars.sparkSession
    sessions = spark.createDataFrame([(d, i) for i, d in enumerate(days.get(source, []))], "session_date date, session_pos int")
    return Calendar(sessions, source, trusted, {k: len(v) for k, v in days.items()}, spark.createDataFrame(differ, "session_date date, has string, lacks string"), tuple(notes))


def calendar_report(consensus: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Per other source: sessions only one of the two has, inside the span both cover."""
    out = None
    for name, other in others.items():
        a, b = consensus.select("session_date"), other.select("session_date").distinct()
        lo = a.agg(F.min("session_date").alias("a0"), F.max("session_date").alias("a1"))
        hi = b.agg(F.min("session_date").alias("b0"), F.max("session_date").alias("b1"))
        both = lo.join(hi).select(F.greatest("a0", "b0").alias("lo"), F.least("a1", "b1").alias("hi"))
        inside = lambda x: x.join(F.broadcast(both), F.col("session_date").between(F.col("lo"), F.col("hi"))).select("session_date")  # noqa: B023,E731
        only_a, only_b = inside(a).subtract(inside(b)), inside(b).subtract(inside(a))
        row = only_a.agg(F.count("*").alias("only_consensus")).join(only_b.agg(F.count("*").alias("only_other"))).select(F.lit(name).alias("source"), "only_consensus", "only_other")
        out = row if out is None else out.unionAll(row)
    return out


def reference_sessions(spark, first: str, last: str, holidays: DataFrame | None = None) -> DataFrame:
    """Business days without the holidays."""
    days = spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}')) AS session_date").filter("weekday(session_date) < 5")
    return days if holidays is None else days.join(holidays.select("session_date"), "session_date", "left_anti")


def absences(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions inside a series' span that it lacks, with their position.

    The dates of bars are numbered by the sessions around them, in a window over calendar days only.  What lies between
    the numbers of two bars is expanded, so only missing sessions are produced and nothing is joined over ranges.
    """
    pos = sessions.select("session_date", "session_pos")
    dates = bars.select("session_date").distinct().join(pos, "session_date", "full")
    upto = F.coalesce(F.max("session_pos").over(Window.orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)), F.lit(-1))
    dates = dates.select("session_date", upto.alias("_upto"), F.when(F.col("session_pos").isNotNull(), 1).otherwise(0).alias("_on"))
    x = bars.select("symbol", "session_date").join(F.broadcast(dates), "session_date")
    x = x.withColumn("_from", F.lag("_upto").over(Window.partitionBy("symbol").orderBy("session_date")) + 1).withColumn("_to", F.col("_upto") - F.col("_on"))
    gone = x.filter("_from <= _to").select("symbol", F.explode(F.sequence("_from", "_to")).alias("session_pos"))
    return gone.join(F.broadcast(pos), "session_pos").select("symbol", "session_date", "session_pos")


def classify_absences(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """market_wide where half of the live series are absent, else suspension (a run of five) or isolated."""
    gone = absences(bars, sessions)
    live = live_counts(bars, sessions)
    gone = gone.withColumn("_absent", F.count("*").over(Window.partitionBy("session_date"))).join(F.broadcast(live), "session_date")
    gone = gone.withColumn("wide", F.col("_absent") / F.col("live") >= MARKET_WIDE)
    own = Window.partitionBy("symbol", "wide").orderBy("session_pos")
    gone = gone.withColumn("_run", F.col("session_pos") - F.row_number().over(own))
    length = F.count("*").over(Window.partitionBy("symbol", "wide", "_run"))
    kind = F.when(F.col("wide"), "market_wide").when(length >= SUSPENSION, "suspension").otherwise("isolated")
    return gone.select("symbol", "session_date", "session_pos", kind.alias("kind"))


def gap_runs(gone: DataFrame, days: int = 4) -> DataFrame:
    """Missing dates joined to runs when at most `days` calendar days apart."""
    w = Window.partitionBy("symbol").orderBy("session_date")
    new = F.when(F.datediff("session_date", F.lag("session_date").over(w)) <= days, 0).otherwise(1)
    g = gone.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return g.groupBy("symbol", "_run").agg(F.min("session_date").alias("first"), F.max("session_date").alias("last"), F.count("*").alias("missing")).drop("_run")


def summarise_gaps(gone: DataFrame, most: int = 5) -> DataFrame:
    """symbol, missing_sessions, missing_runs: the first runs as texts (first..last), and how many more there are."""
    text = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat(F.col("first").cast("string"), F.lit(".."), F.col("last").cast("string")))
    r = gap_runs(gone).groupBy("symbol").agg(F.sum("missing").alias("missing_sessions"), F.count("*").alias("_n"), F.array_sort(F.collect_list(F.struct("first", text.alias("t")))).alias("_r"))
    shown = F.transform(F.slice("_r", 1, most), lambda x: x["t"])
    more = F.when(F.col("_n") > most, F.array(F.concat(F.lit("+"), (F.col("_n") - most).cast("string"), F.lit(" more runs")))).otherwise(F.array().cast("array<string>"))
    return r.select("symbol", "missing_sessions", F.concat(shown, more).alias("missing_runs"))


def violations(bars: DataFrame) -> DataFrame:
    """Census of each series: nulls, impossible prices, bad volume, repeated sessions."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    bad = (h < l) | (c > h + EPSILON) | (c < l - EPSILON) | (o > h + EPSILON) | (o < l - EPSILON)
    return bars.groupBy("symbol").agg(
        F.count("*").alias("rows"), F.min("session_date").alias("first"), F.max("session_date").alias("last"),
        F.count_if(o.isNull() | h.isNull() | l.isNull() | c.isNull()).alias("null_prices"), F.count_if(c <= 0).alias("nonpositive"),
        F.count_if(bad).alias("ohlc_violations"), F.count_if(F.col("volume").isNull()).alias("null_volume"), F.count_if(F.col("volume") < 0).alias("negative_volume"), F.count_if(F.col("volume") == 0).alias("zero_volume"),
        (F.count("*") - F.count_distinct("session_date")).alias("repeated"),
    )


def gate(bars: DataFrame, calendar: Calendar | None, meta: DataFrame | None = None, schema_version: str | None = None, suspects: DataFrame | None = None, classified: bool = True, allow_unverified: bool = False) -> DataFrame:
    """One row a series: complete, valid, consistent, verified, status, reasons and warnings.  What can't be known fails.

    `meta` has symbol and any of rows, series_kind, exchange, schema_version, built_at and changed_at (times of the
    metadata and of the bars), corporate_action_suspects; series of it without bars aren't cached.  `suspects` are rows
    of unresolved splits (default: those of the metadata).  Absences are told apart by the universe unless `classified`
    is off; then every missing session counts.  Futures are measured against the other futures of their exchange.
    """
    v = violations(bars)
    have = set(meta.columns) if meta is not None else set()
    known = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t)
    if meta is not None:
        m = meta.select("symbol", F.lit(True).alias("_meta"), F.coalesce(known("series_kind", "string"), F.lit("equity")).alias("kind"), F.coalesce(known("exchange", "string"), F.lit("UNKNOWN")).alias("exchange"), known("rows", "long").alias("meta_rows"), known("schema_version", "string").alias("_schema"), known("built_at", "timestamp").alias("_built"), known("changed_at", "timestamp").alias("_changed"), (F.size(F.col("corporate_action_suspects")) if "corporate_action_suspects" in have else F.lit(0)).alias("_noted"))
        v = v.join(m, "symbol", "full")
    else:
        empty = {"_meta": "boolean", "exchange": "string", "meta_rows": "long", "_schema": "string", "_built": "timestamp", "_changed": "timestamp", "_noted": "int"}
        v = v.withColumn("kind", F.lit("equity")).withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    v = v.na.fill("equity", ["kind"])
    trusted = calendar is not None and calendar.trusted
    numbers = {"stale_sessions": "long", "missing_sessions": "long", "isolated": "long", "suspension": "long", "market_wide": "long", "peer_missing": "long"}
    if trusted:
        home = bars.join(v.filter(F.col("kind") != "futures").select("symbol"), "symbol", "left_semi")
        if classified:
            one = classify_absences(home, calendar.sessions).groupBy("symbol").agg(F.count("*").alias("missing_sessions"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("isolated", "suspension", "market_wide")])
        else:
            one = absences(home, calendar.sessions).groupBy("symbol").agg(F.count("*").alias("missing_sessions"), F.count("*").alias("isolated"), F.lit(0).alias("suspension"), F.lit(0).alias("market_wide"))
        v = v.join(one, "symbol", "left").na.fill(0, ["missing_sessions", "isolated", "suspension", "market_wide"])
        v = v.join(_behind(v, calendar.sessions), "symbol", "left")
        v = v.join(_missing_of_peers(bars, v.select("symbol", "kind", "exchange")), "symbol", "left") if meta is not None else v.withColumn("peer_missing", F.lit(None).cast("long"))
    else:
        v = v.withColumns({c: F.lit(None).cast(t) for c, t in numbers.items()})
    if suspects is not None:
        v = v.join(suspects.groupBy("symbol").agg(F.count("*").alias("split_suspects")), "symbol", "left").na.fill(0, ["split_suspects"])
    else:
        v = v.withColumn("split_suspects", F.greatest(F.coalesce("_noted", F.lit(0)), F.lit(0)))
    roll = "d_roll" in bars.columns
    if roll:
        v = v.join(bars.groupBy("symbol").agg(F.count("*").alias("_bars"), F.count("d_roll").alias("_rolls")), "symbol", "left")
    futures, absent = F.col("kind") == "futures", F.col("rows").isNull()
    lacks = F.lit(False)
    for kind, columns in REQUIRED.items():
        if any(c not in bars.columns for c in columns):
            lacks = lacks | (F.col("kind") == kind)
    no_peers = futures & F.col("peer_missing").isNull()
    no_volume = F.coalesce(F.col("null_volume") == F.col("rows"), F.lit(True))
    complete = [
        F.when(absent, "not cached"), F.when(~absent & F.lit(not trusted), "no trusted calendar"), F.when(F.col("stale_sessions") > MOST_STALE, "stale"),
        F.when(~futures & (F.col("isolated") > MOST_ISOLATED), "isolated absences" if classified else "missing sessions"),
        F.when(F.lit(trusted and not allow_unverified) & ~absent & no_peers, "no peers to verify completeness"), F.when(futures & (F.col("peer_missing") > MOST_ISOLATED), "sessions that peers have"),
    ]
    valid = [
        F.when(F.col("null_prices") > 0, "null prices"), F.when(F.col("nonpositive") > 0, "nonpositive prices"), F.when(F.col("ohlc_violations") > 0, "impossible bars"),
        F.when((F.col("kind") != "index") & ~absent & no_volume, "no volume"), F.when((F.col("kind") != "index") & (F.col("negative_volume") > 0), "negative volume"),
    ]
    consistent = [
        F.when(~absent & lacks, "missing columns"), F.when(F.col("repeated") > 0, "repeated sessions"), F.when(F.col("split_suspects") > 0, "split suspects"),
        *([F.when(~futures & (F.col("_rolls") > 0), "roll marks on a series without contracts"), F.when(futures & (F.col("_rolls") < F.col("_bars")), "unknown roll")] if roll else []),
    ]
    late = F.col("_built").cast("double") < F.col("_changed").cast("double") - 1
    verified = [F.lit("no metadata")] if meta is None else [
        F.when(F.col("_meta").isNull(), "no metadata"), F.when(~absent & (F.col("meta_rows") != F.col("rows")), "rows differ from the metadata"),
        *([F.when(F.col("_meta") & ~F.col("_schema").eqNullSafe(F.lit(schema_version)), "other schema")] if schema_version is not None else []), F.when(~absent & late, "changed after its metadata"),
    ]
    parts = {"complete": complete, "valid": valid, "consistent": consistent, "verified": verified}
    out = v.withColumns({f"_{k}": F.array_compact(F.array(*x)) if x else F.array().cast("array<string>") for k, x in parts.items()})
    warnings = F.array_compact(F.array(F.when(F.lit(trusted and allow_unverified) & ~absent & no_peers, "no peers to verify completeness")))
    out = out.select("*", *[(F.size(f"_{k}") == 0).alias(k) for k in parts], F.concat(*[F.col(f"_{k}") for k in parts]).alias("reasons"), warnings.alias("warnings"))
    status = F.when(F.size("reasons") > 0, "QUARANTINE").when(F.size("warnings") > 0, "PASS_UNVERIFIED").otherwise("PASS")
    return out.withColumn("status", status).drop(*[c for c in out.columns if c.startswith("_")])


def _behind(spans_of: DataFrame, sessions: DataFrame) -> DataFrame:
    """How many sessions come after the last bar of each series: last bars are merged into the sessions' order."""
    days = sessions.select("session_date", F.lit(1).alias("_s"), F.lit(None).cast("string").alias("symbol"))
    days = days.unionByName(spans_of.filter("last IS NOT NULL").select(F.col("last").alias("session_date"), F.lit(0).alias("_s"), "symbol"))
    counts = days.groupBy("session_date").agg(F.sum("_s").alias("_s"))
    after = F.coalesce(F.sum("_s").over(Window.orderBy("session_date").rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    ranked = counts.select("session_date", after.alias("stale_sessions"))
    return spans_of.select("symbol", F.col("last").alias("session_date")).join(F.broadcast(ranked), "session_date").select("symbol", "stale_sessions")


def _missing_of_peers(bars: DataFrame, kinds: DataFrame) -> DataFrame:
    """For each futures series with a peer: sessions of its exchange, inside its span, that it lacks."""
    meta = kinds.filter("kind = 'futures'").select("symbol", F.lit("futures").alias("series_kind"), "exchange")
    peers = peer_sessions(bars, meta)
    own = bars.select("symbol", "session_date").distinct().join(meta.select("symbol", "exchange"), "symbol")
    span = own.groupBy("symbol", "exchange").agg(F.min("session_date").alias("_a"), F.max("session_date").alias("_b"), F.count("*").alias("_own"))
    # Each exchange's sessions are numbered once; a span's count is the difference of two numbers, so nothing is compared.
    along = Window.partitionBy("exchange").orderBy("session_date")
    numbered = peers.select("exchange", "session_date", F.row_number().over(along).alias("_pos"))
    a = span.join(numbered.select("exchange", F.col("session_date").alias("_a"), F.col("_pos").alias("_from")), ["exchange", "_a"])
    b = a.join(numbered.select("exchange", F.col("session_date").alias("_b"), F.col("_pos").alias("_to")), ["exchange", "_b"])
    return b.select("symbol", (F.col("_to") - F.col("_from") + 1 - F.col("_own")).cast("long").alias("peer_missing"))


def assert_ready(gated: DataFrame, allow_partial: bool = False) -> DataFrame:
    """Series that pass; raises if any is quarantined, unless partial panels are allowed."""
    if not allow_partial and (bad := [f"{r.symbol}: {'; '.join(r.reasons)}" for r in gated.filter("status = 'QUARANTINE'").select("symbol", "reasons").orderBy("symbol").limit(25).collect()]):
        raise ValueError(f"quarantined: {bad}")
    return gated.filter("status <> 'QUARANTINE'").select("symbol")


def gate_report(gated: DataFrame) -> DataFrame:
    """One row: how many series were asked for, passed, passed unverified, and were quarantined, with the reasons of each."""
    bad = F.col("status") == "QUARANTINE"
    why = F.struct("symbol", "reasons")
    return gated.agg(F.count("*").alias("requested"), F.count_if(~bad).alias("allowed"), F.count_if(F.col("status") == "PASS_UNVERIFIED").alias("unverified"), F.count_if(bad).alias("quarantined"), F.array_sort(F.collect_list(F.when(bad, why))).alias("quarantine"))


def peer_sessions(bars: DataFrame, meta: DataFrame, least: int = LEAST_PEERS) -> DataFrame:
    """Union of sessions of each exchange with at least two futures."""
    f = bars.join(meta.filter("series_kind = 'futures'").select("symbol", "exchange"), "symbol")
    enough = f.groupBy("exchange").agg(F.count_distinct("symbol").alias("n")).filter(F.col("n") >= least).select("exchange")
    return f.join(enough, "exchange", "left_semi").select("exchange", "session_date").distinct()


def symbols(bars: DataFrame) -> DataFrame:
    """Every stored series, in order."""
    return bars.select("symbol").distinct().orderBy("symbol")
