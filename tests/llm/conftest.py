import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table from (doc_id, text[, lang, source]) rows, with extra columns of clashing names."""

    def make(rows, parts=3, written=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(parts) if full else spark.createDataFrame([], DOCS)
        from meridion.llm.common import materialise

        from pyspark.sql import functions as F

        for name in ("uid", "size", "sha", "_size", "_epochs", "_part", "_take", "_row_uid", "c0", "c1", "rank"):
            df = df.withColumn(name, F.lit(f"own {name}"))
        # Rows of a shuffle have no order of their own: operators must not count on one.
        return materialise(df, "fixture") if written else df


    return make
