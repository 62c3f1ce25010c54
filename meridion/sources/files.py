"""Other inputs and outputs: symbol lists, sidecars, a rate-limited vendor source, reports."""

from __future__ import annotations

import datetime
import importlib
import json
import random
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from meridion.functions.scalars import sanitize_symbol
from meridion.sources.bars import clean

#: Days of one vendor call at most, and calls a second.
MOST_DAYS, CALLS = 1999, 3.0


def symbols_from_text(spark: SparkSession, path: str) -> DataFrame:
    """Names from CSV, text or Excel files; of names that differ in case only the first stays.

    A table gives its first column (a workbook's below its header).  A text whose lines have more fields than the first
    is no table: all its parts between commas, tabs and line ends are names.
    """
    if path.lower().endswith((".xls", ".xlsx")):
        import pandas as pd

        book = pd.read_excel(path.removeprefix("file://"))
        names = [str(x) for x in book[book.columns[0]].dropna().tolist()] if len(book.columns) else []
        parts = spark.createDataFrame(list(enumerate(names)), "_line long, raw string").withColumn("_pos", F.lit(0))
    else:
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("_line"), "value").filter("trim(value) <> ''")
        lines = lines.withColumn("_fields", F.split("value", ","))
        head = lines.agg(F.min_by(F.size("_fields"), "_line").alias("first"), F.max(F.size("_fields")).alias("most")).first()
        cut = F.array(F.col("_fields")[0]) if (head.first or 0) >= (head.most or 0) else F.split("value", "[,\t]")
        parts = lines.select("_line", F.posexplode(cut).alias("_pos", "raw"))
    s = parts.withColumn("symbol", sanitize_symbol(F.col("raw"))).filter("symbol IS NOT NULL")
    first = Window.partitionBy(F.lower("symbol")).orderBy("_line", "_pos")
    return s.withColumn("_r", F.row_number().over(first)).filter("_r = 1").select("symbol", "_line", "_pos").orderBy("_line", "_pos").select("symbol")


def read_sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON metadata; broken files give rows of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", "true").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(report, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """One folder for each experiment and fold, so that a unit can be written again on its own."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("experiment", "fold").parquet(path)


class TokenBucket:
    """At most `rate` calls a second, with bursts of `burst`."""

    def __init__(self, rate: float, burst: float = 1.0, clock: Callable = time.monotonic, sleep: Callable = time.sleep):
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.held, self.at = burst, clock()

    def take(self) -> None:
        while True:
            now = self.clock()
            self.held = min(self.burst, self.held + (now - self.at) * self.rate)
            self.at = now
            if self.held >= 1 - 1e-9:
                self.held -= 1
                return
            self.sleep((1 - self.held) / self.rate)


def with_retry(call: Callable, attempts: int = 6, sleep: Callable = time.sleep, limited: Callable = lambda e: False, base: float = 0.45):
    """Backs off faster for rate limits (2.2^n, 15 s at most) than for other errors (1.8^n and jitter, 8 s)."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n == attempts - 1:
                raise
            sleep(min(15.0, base * 2.2**n) if limited(e) else min(8.0, base * 1.8**n + random.random() * base / 2))


class StaleInstrument(Exception):
    """A vendor's answer to an identifier that is no longer valid: it is resolved again, once."""


class _Share(InputPartition):
    """Slices that one task fetches, and its share of the rate."""

    def __init__(self, slices: list[tuple[str, str, str]], rate: float):
        self.slices, self.rate = slices, rate


def date_slices(start: str, end: str, days: int = MOST_DAYS) -> Iterator[tuple[str, str]]:
    a, b = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end)
    while a <= b:
        stop = min(b, a + datetime.timedelta(days=days - 1))
        yield a.isoformat(), stop.isoformat()
        a = stop + datetime.timedelta(days=1)


def _named(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class VendorSource(DataSource):
    """Bars of a vendor, fetched by a bounded number of tasks that share one rate.

    Options: symbols (comma separated), start and end, or ranges (JSON of [symbol, start, end]); fetcher
    (module:function that takes symbol or identifier, start, end and yields (date, open, high, low, close, volume));
    resolver (module:function from a symbol to its identifier), called again where the fetcher raises StaleInstrument;
    without_volume (comma separated symbols whose volume is unknown, whatever the vendor says); rate (calls a second of
    all tasks together), tasks, days (of one call).
    """

    @classmethod
    def name(cls) -> str:
        return "meridion_vendor"

    def schema(self) -> str:
        return "symbol string, session_date date, open double, high double, low double, close double, volume double"

    def reader(self, schema):
        return _VendorReader(self.options)


class _VendorReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        o = self.options
        ranges = json.loads(o["ranges"]) if "ranges" in o else [(s.strip(), o["start"], o["end"]) for s in o["symbols"].split(",")]
        slices = [(s, a, b) for s, start, end in ranges for a, b in date_slices(start, end, int(o.get("days", MOST_DAYS)))]
        tasks = max(1, min(int(o.get("tasks", 3)), len(slices)))
        rate = float(o.get("rate", CALLS)) / tasks
        return [_Share(slices[i::tasks], rate) for i in range(tasks)]

    def read(self, part):
        fetch, bucket, known = _named(self.options["fetcher"]), TokenBucket(part.rate), {}
        resolve = _named(self.options["resolver"]) if "resolver" in self.options else (lambda s: s)
        silent = {s.strip() for s in self.options.get("without_volume", "").split(",")}
        for symbol, start, end in part.slices:

            def call():
                bucket.take()
                if symbol not in known:  # noqa: B023
                    known[symbol] = resolve(symbol)  # noqa: B023
                try:
                    return list(fetch(known[symbol], start, end))  # noqa: B023
                except StaleInstrument:
                    known[symbol] = resolve(symbol)  # noqa: B023
                    bucket.take()
                    return list(fetch(known[symbol], start, end))  # noqa: B023

            for row in with_retry(call, limited=lambda e: any(x in str(e).lower() for x in ("too many", "rate", "429"))):
                yield (symbol, *row[:5], None) if symbol in silent else (symbol, *row)


def fetch(spark: SparkSession, symbols: list[str], start: str, end: str, fetcher: str, **options) -> DataFrame:
    return fetch_ranges(spark, [(s, start, end) for s in symbols], fetcher, **options)


def fetch_ranges(spark: SparkSession, ranges: list[tuple[str, str, str]], fetcher: str, **options) -> DataFrame:
    spark.dataSource.register(VendorSource)
    reader = spark.read.format("meridion_vendor").options(ranges=json.dumps(ranges), fetcher=fetcher, **{k: str(v) for k, v in options.items()})
    return clean(reader.load())


class InstrumentMaster:
    """The instruments of each exchange as DataFrames, asked for once a session: `fetcher` gives rows (dicts) of an exchange."""

    SCHEMA = "instrument_token long, tradingsymbol string, name string, segment string, instrument_type string, exchange string, expiry date, position long"

    def __init__(self, spark: SparkSession, fetcher: Callable[[str], list[dict]]):
        self.spark, self.fetcher, self.held = spark, fetcher, {}

    def exchange(self, name: str) -> DataFrame:
        if name not in self.held:
            fields = [f.split()[0] for f in self.SCHEMA.split(", ")]
            rows = [{**dict.fromkeys(fields), **{k: v for k, v in r.items() if k in fields}, "exchange": name, "position": i} for i, r in enumerate(self.fetcher(name))]
            self.held[name] = self.spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], self.SCHEMA).persist()
        return self.held[name]

    def exchanges(self, *names: str) -> DataFrame:
        out = self.exchange(names[0])
        for n in names[1:]:
            out = out.unionByName(self.exchange(n))
        # Rows keep the order of the exchanges named, then their own.
        order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
        return out.withColumn("position", order[F.col("exchange")].cast("long") * F.lit(1 << 40) + F.col("position"))


class FrameCache:
    """Persisted DataFrames by key; the one used longest ago goes where there are too many."""

    def __init__(self, most: int = 256):
        self.most, self.held = max(1, most), OrderedDict()

    def get(self, key, build: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.held:
            self.held[key] = build().persist()
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)[1].unpersist()
        return self.held[key]
