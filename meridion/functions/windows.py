"""Window primitives over one series (symbol, session_date) and over one session's cross-section.

Every frame is in rows, so each builder is a plain Catalyst window expression; a plan that uses many of
them shuffles and sorts once by symbol.  None looks past the current row except `forward`.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

KEY, TIME = "symbol", "session_date"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def series() -> WindowSpec:
    return Window.partitionBy(KEY).orderBy(TIME)


def last_rows(k: int) -> WindowSpec:
    """The current row and the k-1 before it."""
    return series().rowsBetween(-(k - 1), 0)


def prior_rows(k: int) -> WindowSpec:
    """The k rows before the current one."""
    return series().rowsBetween(-k, -1)


def so_far() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, -1)


def forward(k: int) -> WindowSpec:
    """The k rows after the current one; for labels only."""
    return series().rowsBetween(1, k)


def session() -> WindowSpec:
    return Window.partitionBy(TIME)


def lag(x, n: int = 1) -> Column:
    return F.lag(col(x), n).over(series())


def lead(x, n: int = 1) -> Column:
    return F.lead(col(x), n).over(series())


def framed(aggregate, x, frame: WindowSpec, least: int) -> Column:
    """An aggregate over a frame that is null until the frame has `least` values."""
    x = col(x)
    return F.when(F.count(x).over(frame) >= least, aggregate(x).over(frame))


def roll(aggregate, x, k: int, least: int | None = None) -> Column:
    return framed(aggregate, x, last_rows(k), k if least is None else least)


def prior(aggregate, x, k: int, least: int | None = None) -> Column:
    return framed(aggregate, x, prior_rows(k), k if least is None else least)


def ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0.0)))


def zscore(x, k: int) -> Column:
    return ratio(col(x) - roll(F.avg, x, k), roll(F.stddev_samp, x, k))


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def slope(x, k: int) -> Column:
    """Least-squares slope over the last k rows against their position; needs the row number `_n`."""
    frame = last_rows(k)
    return F.when(F.count(col(x)).over(frame) >= k, F.regr_slope(col(x), F.col("_n")).over(frame))


def _paired(x, y) -> tuple[Column, Column]:
    x, y = col(x), col(y)
    return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)


def rolling_corr(x, y, k: int, least: int | None = None) -> Column:
    """Pearson correlation of the pairs in the last k rows; null where either side is constant."""
    x, y = _paired(x, y)
    frame = last_rows(k)
    spread = F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame)
    return F.when(F.count(x).over(frame) >= (least or k), F.try_divide(F.covar_pop(x, y).over(frame), F.when(spread > 1e-12, spread)))


def rolling_cov(x, y, k: int, least: int | None = None) -> Column:
    x, y = _paired(x, y)
    frame = last_rows(k)
    return F.when(F.count(x).over(frame) >= max(2, least or k), F.covar_samp(x, y).over(frame))


def skew(x, k: int) -> Column:
    """Bias-corrected skewness of the last k values; 0 for a constant window."""
    frame, x = last_rows(k), col(x)
    n = F.count(x).over(frame).cast("double")
    raw = F.skewness(x).over(frame) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= k, F.coalesce(raw, F.lit(0.0)))


def kurt(x, k: int) -> Column:
    """Bias-corrected excess kurtosis of the last k values; -3 for a constant window."""
    frame, x = last_rows(k), col(x)
    n = F.count(x).over(frame).cast("double")
    raw = ((n + 1) * F.kurtosis(x).over(frame) + 6) * (n - 1) / ((n - 2) * (n - 3))
    return F.when(n >= k, F.coalesce(raw, F.lit(-3.0)))


def cumulative(aggregate, x) -> Column:
    """Running aggregate, null on rows where x is null."""
    x = col(x)
    return F.when(x.isNotNull(), aggregate(x).over(so_far()))


class Ewm:
    """Exponentially weighted mean y = (1 - a) y + a x, seeded with the first value.

    It takes three steps because windows don't nest: `mark` (the seed's place), `term` (weighted and scaled
    values), `value`.  Rows are dealt into blocks so long that what lies more than a block back weighs less
    than double precision shows; inside a block the sum is a scaled prefix sum, so neither the exponent nor
    the length of a series is limited.  Needs the row number `_n`; nulls are allowed before the seed only.
    """

    def __init__(self, x: str, alpha: float, least: int):
        self.x, self.alpha, self.least = x, alpha, least
        self.q = 1.0 - alpha
        self.block = max(8, math.ceil(41 / -math.log(self.q)))

    def place(self) -> Column:
        return F.pmod(F.col("_n"), F.lit(self.block)).cast("double")

    def number(self) -> Column:
        return F.floor(F.col("_n") / F.lit(self.block))

    def term(self) -> Column:
        seed = F.count(F.col(self.x)).over(so_far()) == 1
        return F.when(seed, F.col(self.x)).otherwise(F.lit(self.alpha) * F.col(self.x)) * F.pow(F.lit(1 / self.q), self.place())

    def value(self, term: str) -> Column:
        inside = Window.partitionBy(KEY, self.number()).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
        older = Window.partitionBy(KEY).orderBy(self.number()).rangeBetween(-1, -1)
        total = F.sum(term).over(inside) + F.coalesce(F.sum(term).over(older), F.lit(0.0)) * F.lit(self.q**self.block)
        ready = F.count(F.col(self.x)).over(so_far()) >= self.least
        return F.when(ready & F.col(self.x).isNotNull(), F.pow(F.lit(self.q), self.place()) * total)


def last_rank(x, frame: WindowSpec, least: int) -> Column:
    """Average-tie percentile rank of the current value among the frame's values."""
    x = col(x)
    values = F.collect_list(x).over(frame)
    n = F.size(values)
    below = F.size(F.filter(values, lambda v: v < x))
    equal = F.size(F.filter(values, lambda v: v == x))
    return F.when(x.isNotNull() & (n >= least), (below + (equal + 1) / 2) / n)


def earlier_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value, how many before it are smaller and how many are equal: blocks are merged two by two, so the work
    is n log^2 n for a series of n."""
    n = len(values)
    distinct, r = np.unique(values, return_inverse=True)
    m, at = len(distinct), np.arange(n)
    below, equal = np.zeros(n, np.int64), np.zeros(n, np.int64)
    size = 1
    while size < n:
        pair, right = at // (2 * size), (at // size) % 2 == 1
        left = np.sort(pair[~right] * m + r[~right])
        asked = pair[right] * m + r[right]
        low = np.searchsorted(left, asked, "left")
        below[right] += low - np.searchsorted(left, pair[right] * m, "left")
        equal[right] += np.searchsorted(left, asked, "right") - low
        size *= 2
    return below, equal


def expanding_ranks(df: DataFrame, columns: dict[str, str], least: int = 60) -> DataFrame:
    """Adds, for each (new name: column), the average-tie percentile rank of a value among those of its series so far.

    Order statistics of a growing frame have no window function; a list of the frame for each row would be quadratic.
    A task holds one series at a time.
    """
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema], *[T.StructField(n, T.DoubleType()) for n in columns]])
    names = df.columns

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(TIME)
        for name, x in columns.items():
            v = t.column(names.index(x)).to_numpy().astype(float)
            there = np.flatnonzero(~np.isnan(v))
            below, equal = earlier_counts(v[there])
            n = np.arange(1, len(there) + 1)
            rank = np.full(len(v), np.nan)
            rank[there] = np.where(n >= least, (below + (equal + 2) / 2) / n, np.nan)
            t = t.append_column(name, pa.array(rank, pa.float64(), from_pandas=True))
        return t

    return df.groupBy(KEY).applyInArrow(run, schema)


def ts_rank(x, k: int, least: int | None = None) -> Column:
    return last_rank(x, last_rows(k), k if least is None else least)


def run_group(flag) -> Column:
    """Number of the run of consecutive true flags a row is in (first step of `streak`)."""
    return F.sum(F.when(F.coalesce(col(flag), F.lit(False)), 0).otherwise(1)).over(so_far())


def streak(flag, group: str) -> Column:
    """Length of the current run of true flags; 0 on other rows."""
    w = Window.partitionBy(KEY, group).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.when(F.coalesce(col(flag), F.lit(False)), 1).otherwise(0)).over(w).cast("int")


def days_since(flag) -> Column:
    """Rows since the flag was last true; 0 before it ever was."""
    at = F.max(F.when(F.coalesce(col(flag), F.lit(False)), F.col("_n"))).over(so_far())
    return F.coalesce(F.col("_n") - at, F.lit(0)).cast("int")


def flag(condition: Column) -> Column:
    """1 or 0; unknown is 0."""
    return F.when(condition, 1).otherwise(0).cast("int")


def clip(x, low: float, high: float) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def session_rank(x) -> Column:
    """Average-tie percentile rank within the session: halfway between the first and the last place of equal values."""
    x = col(x)
    w = Window.partitionBy(TIME).orderBy(x.asc_nulls_last())
    return F.when(x.isNotNull(), (F.rank().over(w) + F.count(x).over(w)) / 2 / F.count(x).over(session()))


def session_z(x, limit: float = 5.0) -> Column:
    x = col(x)
    return clip(ratio(x - F.avg(x).over(session()), F.stddev_samp(x).over(session())), -limit, limit)


def week_end(day="session_date") -> Column:
    """The Friday that ends the week of a day (Saturday to Friday)."""
    return F.next_day(F.date_sub(col(day), 1), "FRI")


def month_start(day="session_date") -> Column:
    return F.trunc(col(day), "MM")


def positions(df: DataFrame, out: str = "_pos", total: str | None = None) -> DataFrame:
    """Adds the place of each row in the order of (session, symbol), from 0.

    Places come from counts of sessions: the only window without a partition runs over sessions.
    """
    by = df.groupBy(TIME).agg(F.count("*").alias("_c"))
    along = Window.orderBy(TIME).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.select(TIME, F.coalesce(F.sum("_c").over(along), F.lit(0)).alias("_before"), *([F.sum("_c").over(whole).alias(total)] if total else []))
    x = df.join(F.broadcast(by), TIME).withColumn(out, F.col("_before") + F.row_number().over(Window.partitionBy(TIME).orderBy(KEY)) - 1)
    return x.drop("_before")


#: Ranges that values are dealt to before they are sorted: so many times as many.
RANGES = 16


def _ranges(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds `_range`, the place of a value among sketched quantiles of its group: ranges hold about as many rows each.
    The place is found in two steps, among every sixteenth edge and then among those between two of them."""
    n = RANGES * RANGES
    edges = df.groupBy(*by).agg(F.percentile_approx(value, F.lit([i / n for i in range(1, n)]), F.lit(8 * n)).alias("_edges"))
    edges = edges.withColumn("_heads", F.transform(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda i: F.element_at("_edges", i * RANGES)))
    x = df.join(F.broadcast(edges), by) if by else df.join(F.broadcast(edges))
    x = x.withColumn("_head", F.size(F.filter("_heads", lambda e: e < F.col(value))))
    rest = F.slice("_edges", F.col("_head") * RANGES + 1, RANGES - 1)
    return x.withColumn("_range", F.col("_head") * RANGES + F.size(F.filter(rest, lambda e: e < F.col(value)))).drop("_edges", "_heads", "_head")


def running_total(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Adds <value>_before, the sum over all rows with a smaller (distinct) key: ranges of keys are summed alone, and only
    the totals of ranges along all of them."""
    x = _ranges(df, [], key)
    along = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy("_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    base = base.select("_range", *[F.coalesce(F.sum(f"_t_{v}").over(along), F.lit(0)).alias(f"_b_{v}") for v in values])
    inner = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(F.broadcast(base), "_range").withColumns({f"{v}_before": F.coalesce(F.sum(v).over(inner), F.lit(0)) + F.col(f"_b_{v}") for v in values})
    return x.drop("_range", *[f"_b_{v}" for v in values])


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, n, q: exact quantiles (linear between neighbours) of the values of each group, nulls left out.

    A value's place is its place in its range plus the rows of the ranges below, so no task sorts a whole group; only the
    places that the shares ask for are gathered.
    """
    x = _ranges(df.select(*by, value).filter(F.col(value).isNotNull()), by, value)
    counts = x.groupBy(*by, "_range").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*by)
    counts = counts.select(*by, "_range", F.coalesce(F.sum("_c").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(group).alias("n"))
    x = x.join(F.broadcast(counts), [*by, "_range"])
    x = x.withColumn("_at", F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_range").orderBy(value)) - 1)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor((F.col("n") - 1) * F.lit(s)), F.ceil((F.col("n") - 1) * F.lit(s))) for s in sorted(set(shares))]))) if len(shares) <= 64 else None
    if wanted is not None:
        x = x.filter(F.array_contains(wanted, F.col("_at")))
    else:
        # Many even shares: a place is asked for if a share lies within a place of it, in whole numbers.
        k = len(shares) - 1
        over = F.pmod(F.col("_at") * k, F.greatest(F.col("n") - 1, F.lit(1)))
        x = x.filter((over < k) | (F.col("n") - 1 - over < k))
    g = x.groupBy(*by).agg(F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.col("_at").cast("long"), F.col(value).cast("double")))).alias("_m"))
    place = lambda s: (F.col("n") - 1) * s
    low = lambda s: F.col("_m")[F.floor(place(s)).cast("long")]
    high = lambda s: F.col("_m")[F.ceil(place(s)).cast("long")]
    q = F.transform(F.array(*[F.lit(s) for s in shares]), lambda s: low(s) + (place(s) - F.floor(place(s))) * (high(s) - low(s)))
    return g.select(*by, "n", q.alias("q"))
