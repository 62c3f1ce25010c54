"""Every query with SQL gives the same rows in DuckDB on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from meridion.plans import catalog  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return bool(v)
    return round(float(v), 6) if isinstance(v, (int, float)) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


#: Queries without SQL: what their rows must be like on the smallest tables, too short for states of a year.
PLAIN = {
    "closest_names": lambda r: len(r) == 25 and all(x.closest[0] == x.name[:-1] for x in r), "seeded_sample": lambda r: len(r) == 10, "source_leaks": lambda r: r == [],
    "lookahead_lint": lambda r: {x.column for x in r} == {"label_mfe_5d", "label_mae_5d", "label_fwd_ret_5d", "label_touch"} or len(r) > 3,
    "contract": lambda r: len(r) > 150 and all(x.hypothesis and not x.uses_future for x in r), "unresolved_symbols": lambda r: len(r) > 0 and all(x.suggestions[0] == x.symbol[:-4].upper() for x in r if x.suggestions),
    "analogues_cross": lambda r: r == [], "analogues_self": lambda r: r == [], "analogue_summary": lambda r: r == [], "evidence_features": lambda r: r == [],
    "evidence_audit": lambda r: len(r) == 1, "tournament_preflight": lambda r: len(r) == 15 and not any(x.ready for x in r), "model_tournament": lambda r: r == [],
}
#: Takes minutes on any table; its parts are tested on planted columns.
LONG = {"feature_audit"}


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - LONG))
def test_rows_without_sql(spark, name):
    assert PLAIN[name](catalog.queries()[name](spark, DATA).collect())


def test_entry_without_the_corpus_subpackage(monkeypatch):
    import importlib

    import __spark_entry__ as e

    real = importlib.import_module

    def gone(name, *a):
        if name.startswith("meridion.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", gone)
    assert e._llm() is None and "flagship_top5" in e.queries() and not any(k.startswith("op") for k in e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
