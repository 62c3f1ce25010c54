"""Merging, orphans, splits, rolls, reconciliation and liquidity of raw bars."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridion.functions import windows as w
from meridion.functions.scalars import close_matches, normalise_symbol

#: Price ratios of usual splits and bonuses, in the order they are tried.
SPLITS = (2.0, 2.5, 3.0, 4.0, 5.0, 10.0, 20.0, 100.0, 1.5, 1.25, 1.2, 4.0 / 3.0, 5.0 / 3.0, 5.0 / 2.0, 7.0 / 5.0, 3.0 / 2.0)
#: Floors of daily turnover, and the quantiles of a report.
TURNOVER_FLOORS = (0.0, 1e5, 5e5, 1e6, 2.5e6, 5e6, 1e7, 2.5e7, 5e7, 1e8)
TURNOVER_QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
#: What counts as a disagreement of two vendors.
RETURN_TOLERANCE, MOST_MISMATCHES, ACTION_SIZE, SEVERE, MOST_MISSING, LEAST_COMMON = 0.005, 0.01, 0.15, 0.05, 3, 30


def merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by symbol and session: a new bar replaces the old one, which makes refetched tails idempotent.

    Of several bars of one batch the one with the largest `ingested_at` stays, where there is such a column; of those
    (and without it) the one with the largest values, so that a rerun keeps the same one.
    """
    both = old.withColumn("_prio", F.lit(0)).unionByName(new.withColumn("_prio", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("symbol", "session_date", "_prio", "ingested_at")]
    order = [F.desc("_prio"), *([F.desc_nulls_last("ingested_at")] if "ingested_at" in both.columns else []), *[F.desc_nulls_last(c) for c in rest]]
    last = Window.partitionBy("symbol", "session_date").orderBy(*order)
    return both.withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_prio", "_rank")


def fetch_plan(spans: DataFrame, start: datetime.date, end: datetime.date, tail_days: int = 7, only_stale: bool = False) -> DataFrame:
    """What an incremental run has to fetch: (symbol, why, fetch_from, fetch_to), a row for each range.

    `spans` has symbol, first, last (null: nothing stored) and lag_sessions, and may have an `end` of each.  A series without bars is fetched whole.
    One that begins too late gets its beginning; one that is behind, or whose last bars may have been provisional
    because its session ends after the exchange's, gets its last days again.
    """
    since = F.lit(start).cast("date")
    until = F.least(F.col("end"), F.lit(end).cast("date")) if "end" in spans.columns else F.lit(end).cast("date")
    stored, behind = F.col("last").isNotNull(), F.col("last") < until
    skip = stored & ~behind if only_stale else F.lit(False)
    old = F.lit(False) if only_stale else F.col("lag_sessions") > 0
    ranges = F.array(
        F.when(~stored, F.struct(F.lit("all").alias("why"), since.alias("fetch_from"), until.alias("fetch_to"))),
        F.when(stored & ~skip & (F.col("first") > since), F.struct(F.lit("beginning").alias("why"), since.alias("fetch_from"), F.date_sub("first", 1).alias("fetch_to"))),
        F.when(stored & ~skip & (behind | old), F.struct(F.lit("tail").alias("why"), F.greatest(F.date_sub("last", tail_days), since).alias("fetch_from"), until.alias("fetch_to"))),
    )
    return spans.select("symbol", F.explode(F.array_compact(ranges)).alias("r")).select("symbol", "r.*").filter("fetch_from <= fetch_to")


def refresh(old: DataFrame, new: DataFrame, splits_of: tuple[str, ...] = ("equity",)) -> tuple[DataFrame, DataFrame]:
    """(merged bars, a row a fetched symbol: symbol, action, suspects).

    action is `refetch` where the merged series shows an unadjusted split (old and new bars aren't on one basis, so the
    whole series must come again), `unchanged` where the fetched bars say what was stored, else `write`.  `new` may
    have a column `kind`; splits are only looked for in kinds of `splits_of`.
    """
    bars = new.drop("kind")
    merged = merge(old, bars)
    touched = new.select("symbol", *(["kind"] if "kind" in new.columns else [])).distinct()
    scanned = touched.filter(F.col("kind").isin(*splits_of)).select("symbol") if "kind" in new.columns else touched
    hits = split_suspects(merged.join(scanned, "symbol", "left_semi")).groupBy("symbol").agg(F.count("*").alias("suspects"))
    rest = [c for c in bars.columns if c not in ("symbol", "session_date", "ingested_at") and c in old.columns]
    same = F.lit(True)
    for c in rest:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}"))
    pairs = bars.alias("n").join(old.alias("o"), ["symbol", "session_date"], "left")
    changed = pairs.groupBy("symbol").agg(F.count_if(~same | F.col("o.close").isNull() & F.col("n.close").isNotNull()).alias("changed"))
    out = touched.select("symbol").distinct().join(hits, "symbol", "left").join(changed, "symbol", "left").na.fill(0, ["suspects", "changed"])
    return merged, out.select("symbol", F.when(F.col("suspects") > 0, "refetch").when(F.col("changed") == 0, "unchanged").otherwise("write").alias("action"), "suspects")


def trim_orphans(bars: DataFrame, gap_days: int = 365, least: int = 252) -> DataFrame:
    """Drops what lies before the last gap of a year that still leaves `least` bars."""
    n = F.row_number().over(w.series())
    total = F.count("*").over(Window.partitionBy("symbol"))
    x = bars.withColumns({"_n": n, "_total": total, "_gap": F.datediff("session_date", F.lag("session_date").over(w.series()))})
    starts = F.when((F.col("_gap") >= gap_days) & (F.col("_total") - F.col("_n") + 1 >= least), F.col("_n"))
    x = x.withColumn("_start", F.coalesce(F.max(starts).over(Window.partitionBy("symbol")), F.lit(1)))
    return x.filter("_n >= _start").drop("_n", "_total", "_gap", "_start")


def split_suspects(bars: DataFrame, least_move: float = 0.30, tolerance: float = 0.04) -> DataFrame:
    """Jumps that look like unadjusted splits: a usual ratio, a calm session, and a level that holds.

    The ratio is folded to at least 1 before it is compared.  An unknown range counts as calm, and unknown or no volume
    before the jump as consistent.
    """
    frame = w.series().rowsBetween(0, 4)
    x = bars.select("symbol", "session_date", "high", "low", "close", "volume", w.lag("close").alias("prev_close"), w.median(F.col("close")).over(frame).alias("_level"), w.lag("volume").alias("_pv"))
    x = x.withColumn("ratio", w.ratio("prev_close", "close")).withColumn("move", F.abs(w.ratio("close", "prev_close") - 1))
    folded = F.when(F.col("ratio") >= 1, F.col("ratio")).otherwise(w.ratio(F.lit(1.0), "ratio"))
    near = F.filter(F.array(*[F.lit(s) for s in SPLITS]), lambda s: F.abs(folded - s) / s <= tolerance)
    x = x.withColumn("nearest_split", F.when(F.size(near) > 0, near[0]))
    calm = ~F.coalesce(w.ratio(F.col("high") - F.col("low"), "close") > 0.5 * F.col("move"), F.lit(False))
    holds = ~F.coalesce(F.abs(w.ratio("_level", "close") - 1) > 0.5 * F.col("move"), F.lit(False))
    x = x.filter((F.col("move") >= least_move) & (F.col("ratio") > 0) & F.col("nearest_split").isNotNull() & calm & holds)
    grown = F.when(F.col("_pv") > 0, F.col("volume") / F.col("_pv"))
    consistent = F.coalesce(F.when(F.col("close") < F.col("prev_close"), grown > 1.3).otherwise(grown < 0.77), F.lit(True))
    return x.select("symbol", "session_date", "prev_close", "close", "ratio", "nearest_split", (F.col("move") * 100).alias("move_pct"), consistent.alias("volume_consistent"), F.when(consistent, "high").otherwise("medium").alias("confidence"))


def roll_calendar(observed: DataFrame) -> DataFrame:
    """Append-only expiries: the first observation of each stays."""
    return observed.groupBy("series", "expiry").agg(F.min_by("tradingsymbol", F.struct("observed_on", "tradingsymbol")).alias("tradingsymbol"), F.min("observed_on").alias("observed_on"))


def roll_marks(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """d_roll: 1 on the first session after an expiry, 0 on others, null before the first known expiry (or without any).

    Expiries are merged into the sessions' order, so no session is compared with every expiry.
    """
    e = calendar.select(F.col("series").alias("symbol"), F.col("expiry").alias("session_date"), F.lit(1).alias("_e"))
    both = bars.select("symbol", "session_date").withColumn("_e", F.lit(0)).unionByName(e)
    order = Window.partitionBy("symbol").orderBy("session_date", "_e")
    marked = both.withColumn("_since", F.lag("_e").over(order)).withColumn("_known", F.min(F.when(F.col("_e") == 1, F.col("session_date"))).over(Window.partitionBy("symbol")))
    # An expiry on a session's own date sorts after it, so it marks the next session.
    roll = F.when(F.col("_since") == 1, 1).when(F.col("session_date") >= F.col("_known"), 0).cast("tinyint")
    return bars.join(marked.filter("_e = 0").select("symbol", "session_date", roll.alias("d_roll")), ["symbol", "session_date"])


def front_month(instruments: DataFrame, today, names: list[str] | None = None) -> DataFrame:
    """The nearest contract of each name that has not expired; raises if one of `names` has none."""
    live = instruments.filter((F.upper("instrument_type") == "FUT") & (F.col("expiry") >= F.lit(today)))
    out = live.groupBy(F.upper("name").alias("name")).agg(F.min_by("tradingsymbol", F.struct("expiry", "tradingsymbol")).alias("tradingsymbol"), F.min("expiry").alias("expiry"))
    if names is not None:
        wanted = [n.upper() for n in names]
        out = out.filter(F.col("name").isin(wanted))
        if gone := set(wanted) - {r.name for r in out.select("name").collect()}:
            raise LookupError(f"no live contract for {sorted(gone)}")
    return out


def reconcile(ours: DataFrame, theirs: DataFrame, symbols: DataFrame | None = None, days: int = 750, tolerance: float = RETURN_TOLERANCE, errors: DataFrame | None = None) -> DataFrame:
    """Compares the returns of two vendors on common sessions; levels may differ by any factor.

    Only the last `days` days of a stored series are compared.  `symbols` names what was asked for (default: what is
    stored), `errors` has symbol and error of sources that failed.  Missing sessions come before anything else; a
    corporate action is a severe jump in a series that else agrees.
    """
    asked = (ours.select("symbol") if symbols is None else symbols.select("symbol")).distinct()
    span = ours.groupBy("symbol").agg(F.max("session_date").alias("_end"), F.min("session_date").alias("_begin")).withColumn("_start", F.greatest("_begin", F.date_sub("_end", days)))
    inside = F.col("session_date").between(F.col("_start"), F.col("_end"))
    r = lambda df, n: df.select("symbol", "session_date", F.col("close").alias(f"c_{n}"), F.col("volume").alias(f"v_{n}"), F.lit(True).alias(f"in_{n}")).join(span.select("symbol", "_start", "_end"), "symbol").filter(inside).drop("_start", "_end")
    both = r(ours, "a").join(r(theirs, "b"), ["symbol", "session_date"], "full")
    common = F.col("in_a") & F.col("in_b")
    pairs = both.filter(common).withColumns({"_ra": w.ratio("c_a", w.lag("c_a")) - 1, "_rb": w.ratio("c_b", w.lag("c_b")) - 1}).withColumn("diff", F.abs(F.col("_ra") - F.col("_rb")))
    day = F.struct(F.col("session_date").alias("date"), F.col("diff").alias("return_diff"))
    stats = pairs.groupBy("symbol").agg(
        F.count("*").alias("overlap_days"), F.count("diff").alias("compared_returns"), F.count_if(F.col("diff") > tolerance).alias("mismatches"), F.max("diff").alias("max_return_diff"),
        F.count_if(F.col("diff") > ACTION_SIZE).alias("_actions"), w.median(w.ratio("v_a", "v_b")).alias("median_volume_ratio"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("diff") > ACTION_SIZE, day))), 1, 5).alias("corporate_action_suspects"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(F.col("diff").isNotNull(), F.struct((-F.col("diff")).alias("d"), F.col("session_date").alias("day"))))), 1, 5), lambda x: F.struct(x["day"].alias("date"), (-x["d"]).alias("return_diff"))).alias("worst_days"),
    )
    first5 = lambda c: F.slice(F.array_sort(F.collect_list(F.when(c, F.col("session_date")))), 1, 5)
    mine, other = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    counts = both.groupBy("symbol").agg(F.count_if(mine).alias("_ours"), F.count_if(other).alias("_theirs"), F.count_if(~mine).alias("missing_from_ours"), F.count_if(~other).alias("missing_from_theirs"), first5(~mine).alias("sessions_missing_from_ours"), first5(~other).alias("sessions_missing_from_theirs"))
    x = asked.join(counts, "symbol", "left").join(stats, "symbol", "left").na.fill(0, ["overlap_days", "compared_returns", "mismatches"])
    x = x.join(errors.select("symbol", "error"), "symbol", "left") if errors is not None else x.withColumn("error", F.lit(None).cast("string"))
    n, rate, worst = F.col("compared_returns"), w.ratio(F.col("mismatches").cast("double"), F.col("compared_returns").cast("double")), F.col("max_return_diff")
    absent = F.col("missing_from_ours") > MOST_MISSING
    reasons = F.array_compact(F.array(
        F.when(n == 0, "no comparable returns"), F.when(rate > MOST_MISMATCHES, "mismatch rate"), F.when(worst > SEVERE, "worst day"), F.when(absent, "sessions absent"),
    ))
    status = (
        F.when(F.coalesce("_ours", F.lit(0)) == 0, "NOT_CACHED").when(F.col("error").isNotNull(), "SOURCE_ERROR").when(F.col("_theirs") == 0, "NO_REFERENCE_DATA")
        .when(F.col("overlap_days") < LEAST_COMMON, "TOO_LITTLE_OVERLAP").when(F.size(reasons) == 0, "OK").when(absent, "MISSING_SESSIONS")
        .when((F.col("_actions") > 0) & (worst > SEVERE) & (rate <= MOST_MISMATCHES), "CORPORATE_ACTION").otherwise("MISMATCH")
    )
    return x.withColumns({"mismatch_rate": F.round(rate, 5), "reasons": reasons, "status": status}).drop("_ours", "_theirs", "_actions")


def sample_symbols(symbols: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n symbols in an order that the seed alone decides."""
    return symbols.select("symbol").distinct().orderBy(F.xxhash64("symbol", F.lit(seed)), "symbol").limit(n)


def reconcile_summary(results: DataFrame) -> DataFrame:
    """One row: symbols checked, how many of each status, median mismatch rate of the compared ones, and the suspects."""
    compared = F.col("status").isin("OK", "MISMATCH", "MISSING_SESSIONS")
    by = results.groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"))
    one = results.agg(F.count("*").alias("symbols_checked"), F.round(w.median(F.when(compared, F.col("mismatch_rate"))), 5).alias("median_mismatch_rate"), F.array_sort(F.collect_list(F.when(F.size("corporate_action_suspects") > 0, F.col("symbol")))).alias("symbols_with_suspects"))
    return one.join(by)


def turnover(bars: DataFrame, window: int = 60, as_of: datetime.date | None = None) -> DataFrame:
    """Median turnover of the last `window` bars up to a date, of each series that has half as many by then."""
    known = bars if as_of is None else bars.filter(F.col("session_date") <= F.lit(as_of))
    last = Window.partitionBy("symbol").orderBy(F.desc("session_date"))
    x = known.select("symbol", "session_date", (F.col("close") * F.col("volume")).alias("_t"), F.row_number().over(last).alias("_r"), F.count("*").over(Window.partitionBy("symbol")).alias("sessions"))
    out = x.filter((F.col("_r") <= window) & (F.col("sessions") >= window // 2)).groupBy("symbol").agg(w.median(F.col("_t")).alias("median_turnover"), F.first("sessions").alias("sessions"), F.max("session_date").alias("last"))
    return out.filter("median_turnover IS NOT NULL")


def floor_table(bars: DataFrame, floors=TURNOVER_FLOORS, as_of: datetime.date | None = None) -> DataFrame:
    """How many series reach each floor, and their share: one pass over the series, a sum for each floor."""
    t = turnover(bars, as_of=as_of)
    counts = t.agg(F.count("*").alias("all"), *[F.count_if(F.col("median_turnover") >= f).alias(f"f{i}") for i, f in enumerate(floors)])
    return counts.select("all", F.explode(F.array(*[F.struct(F.lit(float(f)).alias("floor"), F.col(f"f{i}").alias("series")) for i, f in enumerate(floors)])).alias("x")).select("x.*", w.ratio(F.col("x.series").cast("double"), F.col("all").cast("double")).alias("share"))


def turnover_quantiles(turnovers: DataFrame, quantiles=TURNOVER_QUANTILES) -> DataFrame:
    q = turnovers.agg(F.percentile("median_turnover", F.lit(list(quantiles))).alias("q"))
    return q.select(F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in quantiles]).alias("quantile"), F.col("q").alias("median_turnover"))).alias("x")).select("x.*")


def thinnest(turnovers: DataFrame, n: int = 10) -> DataFrame:
    return turnovers.orderBy("median_turnover", "symbol").limit(n)


def coverage(bars: DataFrame, kinds: DataFrame | None = None, asked: DataFrame | None = None, sessions: DataFrame | None = None, suspects: DataFrame | None = None) -> DataFrame:
    """A row a series that was asked for: rows, span, whether it is current, its gaps and split suspects.

    The session that should be reached is the last of any equity (of any series without equities); other series may be
    ahead of it.  Gaps are measured for equities and indices only, whose calendar `sessions` is.  Series without bars
    are stale, with 0 rows.
    """
    from meridion.operators import quality

    s = bars.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("session_date").alias("first"), F.max("session_date").alias("last"))
    s = s if asked is None else asked.select("symbol").distinct().join(s, "symbol", "left").na.fill(0, ["rows"])
    s = s.join(kinds.select("symbol", "kind"), "symbol", "left").na.fill("equity", ["kind"]) if kinds is not None else s.withColumn("kind", F.lit("equity"))
    top = s.agg(F.coalesce(F.max(F.when(F.col("kind") == "equity", F.col("last"))), F.max("last")).alias("expected_last"))
    s = s.join(F.broadcast(top))
    if sessions is not None:
        gone = quality.absences(bars, sessions)
        runs = quality.summarise_gaps(gone)
        s = s.join(runs, "symbol", "left")
        nse = F.col("kind").isin("equity", "index")
        s = s.withColumns({"missing_sessions": F.when(nse, F.coalesce("missing_sessions", F.lit(0))), "missing_runs": F.when(nse, F.col("missing_runs"))})
    if suspects is not None:
        s = s.join(suspects.groupBy("symbol").agg(F.count("*").alias("split_suspects")), "symbol", "left").na.fill(0, ["split_suspects"])
    stale = F.col("last").isNull() | (F.col("last") < F.col("expected_last"))
    return s.withColumns({"days_behind": F.datediff("expected_last", "last"), "stale": stale})


def completed_session(now: str | Column, session_end: str, grace_minutes: int = 15) -> Column:
    """Today once the session has closed and the grace has passed, otherwise yesterday; of a text or of a column."""
    at = F.to_timestamp(F.lit(now) if isinstance(now, str) else now)
    close = F.to_timestamp(F.concat(F.date_format(at, "yyyy-MM-dd"), F.lit(f" {session_end}:00"))) + F.expr(f"INTERVAL {grace_minutes} MINUTES")
    return F.when(at >= close, F.to_date(at)).otherwise(F.date_sub(F.to_date(at), 1))


def resolve_symbols(wanted: DataFrame, master: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """symbol -> instrument_token.  The first of these that the master knows: the override's name, that name with -EQ, its
    normalised form; the symbol, the symbol with -EQ, its normalised form.

    Of rows with one name the cash series of the two exchanges beats other instruments of theirs, those beat the rest,
    and then the first row wins: by `position` where the master has it, else by token.  Unresolved names keep a null.
    """
    home = F.upper("segment").startswith("NSE") | F.upper("segment").startswith("BSE")
    score = F.when(home & (F.upper("instrument_type") == "EQ"), 2).when(home, 1).otherwise(0)
    at = F.col("position") if "position" in master.columns else F.col("instrument_token")
    m = master.filter("instrument_token IS NOT NULL AND instrument_token <> 0 AND coalesce(tradingsymbol, '') <> ''")
    m = m.select(F.upper("tradingsymbol").alias("_name"), normalise_symbol(F.col("tradingsymbol")).alias("_base"), "instrument_token", F.struct(score.alias("s"), (-at).alias("p")).alias("_o"))
    names = m.groupBy("_name").agg(F.max_by("instrument_token", "_o").alias("_t"))
    bases = m.groupBy("_base").agg(F.max_by("instrument_token", "_o").alias("_t"))
    x = wanted.select("symbol").distinct().withColumn("_norm", normalise_symbol(F.col("symbol")))
    if overrides is not None:
        x = x.join(overrides.select(normalise_symbol(F.col("symbol")).alias("_norm"), F.upper("tradingsymbol").alias("_want")).dropDuplicates(["_norm"]), "_norm", "left")
    else:
        x = x.withColumn("_want", F.lit(None).cast("string"))
    tries = [(names, F.col("_want")), (names, F.concat("_want", F.lit("-EQ"))), (bases, F.when(F.col("_want").isNotNull(), normalise_symbol(F.col("_want")))), (names, F.upper("symbol")), (names, F.concat(F.upper("symbol"), F.lit("-EQ"))), (bases, F.col("_norm"))]
    for i, (known, key) in enumerate(tries):
        k, v = known.columns
        x = x.join(known.select(F.col(k).alias(f"_k{i}"), F.col(v).alias(f"_t{i}")), key == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    return x.select("symbol", F.coalesce(*[F.col(f"_t{i}") for i in range(len(tries))]).alias("instrument_token"))


def unresolved(resolved: DataFrame, master: DataFrame) -> DataFrame:
    """The names that were not found, each with up to five close ones of the master."""
    names = sorted(r[0] for r in master.select(F.upper("tradingsymbol")).filter("tradingsymbol IS NOT NULL").distinct().collect())
    gone = resolved.filter("instrument_token IS NULL").select("symbol", F.upper("symbol").alias("_key"))
    return close_matches(gone, "_key", names).drop("_key")
