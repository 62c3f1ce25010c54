"""A registry of derived columns that are built in layers.

A column is a function of other columns; `c(name)` inside it both refers to a column and records the
dependency.  `with_columns` finds what is needed for the wanted names, sorts it into layers (a window
expression can't contain another), and adds each layer in one select, and all expanding ranks of a layer in
one step more.  Columns nobody asked for are never built, so a narrow query has a narrow plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridion.functions.windows import expanding_ranks

_asked: list[set[str]] = []


def c(name: str) -> Column:
    if _asked:
        _asked[-1].add(name)
    return F.col(name)


class Registry(dict):
    """name -> builder; `lookback` and `why` feed the feature contract."""

    def __init__(self):
        super().__init__()
        self.notes: dict[str, tuple[int, str]] = {}
        self.ranks: dict[str, str] = {}

    def add(self, name: str, builder: Callable[[], Column], lookback: int = 1, why: str = "") -> None:
        if name in self:
            raise ValueError(f"{name} is defined twice")
        self[name] = builder
        self.notes[name] = (lookback, why)

    def add_rank(self, name: str, of: str, lookback: int = 60, why: str = "") -> None:
        """The rank of a column's value among those of its series so far."""
        self.add(name, lambda: c(of), lookback, why)
        self.ranks[name] = of

    def __call__(self, name: str, lookback: int = 1, why: str = ""):
        def keep(builder):
            self.add(name, builder, lookback, why)
            return builder

        return keep

    def layers(self, wanted: Iterable[str], given: Iterable[str]) -> list[list[tuple[str, Column]]]:
        level: dict[str, int] = dict.fromkeys(given, 0)
        built: dict[str, Column] = {}

        def visit(name: str, above: tuple[str, ...]) -> int:
            if name in level:
                return level[name]
            if name in above:
                raise ValueError(f"{name} depends on itself")
            if name not in self:
                raise KeyError(f"no column {name}")
            _asked.append(set())
            built[name] = self[name]()
            needs = _asked.pop()
            level[name] = 1 + max((visit(n, (*above, name)) for n in sorted(needs)), default=0)
            return level[name]

        for w in wanted:
            visit(w, ())
        top = max((level[n] for n in built), default=0)
        return [[(n, built[n]) for n in sorted(built) if level[n] == k] for k in range(1, top + 1)]

    def with_columns(self, df: DataFrame, wanted: Iterable[str]) -> DataFrame:
        for layer in self.layers(wanted, df.columns):
            plain = [x.alias(n) for n, x in layer if n not in self.ranks]
            df = df.select("*", *plain) if plain else df
            if ranks := {n: self.ranks[n] for n, _ in layer if n in self.ranks}:
                df = expanding_ranks(df, ranks)
        return df
