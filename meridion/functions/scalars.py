"""Scalar helpers as Catalyst expressions."""

from __future__ import annotations

import datetime
import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings dropped from names, words that head a column of names, characters that names can't have, and
#: date formats tried in turn.
SUFFIXES = ("-EQ", "-BE", "-BZ", "-BL", "-SM", "-GS", "-GB")
HEADERS = ("symbol", "symbols", "ticker", "tickers", "scrip", "scrips", "name")
ILLEGAL = '<>:"/\n?*'
FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy")


def sanitize_symbol(x: Column) -> Column:
    """White space collapsed, then illegal characters out; null for empty cells and header words."""
    s = F.regexp_replace(F.regexp_replace(x, "\\x00", ""), "^\\uFEFF+", "")
    s = F.trim(F.regexp_replace(s, "\\s+", " "))
    s = F.regexp_replace(s, '[<>:"/\\n?*]', "")
    return F.when((s != "") & ~F.lower(F.trim(s)).isin(*HEADERS), s)


def normalise_symbol(x: Column) -> Column:
    """Upper case without the known endings, each dropped once in their order; letters and digits only."""
    # The endings are tried in their order, so on a name that has several they stand in reverse.
    ends = "".join(f"({e})?" for e in reversed(SUFFIXES))
    s = F.regexp_replace(F.trim(F.upper(F.coalesce(x, F.lit("")))), f"{ends}$", "")
    return F.regexp_replace(s, "[^\\p{L}\\p{N}]", "")


def parse_date(x: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The first format that reads the text; days and months may have one digit."""
    t = F.trim(x)
    loose = lambda f: f.replace("dd", "d").replace("MM", "M")
    return F.coalesce(*[F.to_date(F.try_to_timestamp(t, F.lit(loose(f)))) for f in formats])


def requested_range(start: Column, end: Column, today: Column) -> tuple[Column, Column]:
    """Swapped where reversed, and not beyond today."""
    return F.least(F.least(start, end), today), F.least(F.greatest(start, end), today)


def checked_range(start: datetime.date, end: datetime.date, today: datetime.date) -> tuple[datetime.date, datetime.date, list[str]]:
    """The range of a request, and a note for each end that had to be moved to today."""
    start, end = min(start, end), max(start, end)
    notes = [f"{what} {day.isoformat()} moved to {today.isoformat()}" for what, day in (("end", end), ("start", start)) if day > today]
    return min(start, today), min(end, today), notes


def map_true_false(x: Column) -> Column:
    """true / false texts as 1 / 0; anything else is null."""
    s = F.lower(F.trim(x.cast("string")))
    return F.when(s == "true", 1).when(s == "false", 0).cast("tinyint")


def true_false_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns that hold nothing but true, false, nan and blanks become 1 / 0 (unknown: 0); others stay as they are."""
    kept = ("true", "false", "nan", "none", "")
    odd = df.agg(*[F.count_if(~F.coalesce(F.lower(F.trim(F.col(c))), F.lit("")).isin(*kept)).alias(c) for c in columns]).first()
    flags = [c for c in columns if not odd[c]]
    return df.withColumns({c: F.coalesce(map_true_false(F.col(c)), F.lit(0)).cast("int") for c in flags}) if flags else df


def close_matches(rows: DataFrame, column: str, names: list[str], out: str = "suggestions", n: int = 5, cutoff: float = 0.77) -> DataFrame:
    """Adds up to n of the names whose matching-block ratio with the column reaches the cutoff, best first.

    The names are a master's (some hundred thousand at most) and go to each task; each distinct text is compared once.
    """
    schema = f"_of string, {out} array<string>"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"_of": p["_of"], out: [difflib.get_close_matches(x, names, n, cutoff) for x in p["_of"]]})

    found = rows.select(F.col(column).alias("_of")).filter("_of IS NOT NULL").distinct().mapInPandas(run, schema)
    return rows.join(found, F.col(column) == F.col("_of"), "left").drop("_of")


def lag_sessions(session_end: Column, close: str = "15:30") -> Column:
    """1 for a series whose session ends after the exchange's close (compared as texts), else 0."""
    return F.when(session_end > close, 1).otherwise(0)
