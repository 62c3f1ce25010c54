"""Mix sources to target weights (operator 10): hash-random keys, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridion.llm.common import UID, fields, join_small, materialise, numbered, prefix_sums, stable, table, whole_rows

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of characters other than space and tab..carriage return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Target words for each (source, source_size): water filling with the cap `most` x size.

    Sources by code point, null last, get the repeating weights.  A source is capped while the level
    (rest of the budget / rest of the weights) lifts it over its cap; in order of cap / weight the capped
    ones come first, so running sums settle it without iteration: the first level that caps nothing, the highest of those, is final.  One row a source: the windows
    without a partition hold as many rows as there are sources, whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = [F.col("cap") / F.col("w"), F.col("source").isNull(), F.encode("source", "utf-8")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("rest", F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("rest") / F.sum("w").over(after))
    s = s.withColumn("full", F.col("level") * F.col("w") >= F.col("cap"))
    s = s.withColumn("final", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("final") * F.col("w")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """One row a document: row uid, doc_id, source, size, source_size, target, taken.

    Documents of a source are ordered by a digest of doc_id (ties of repeated or null ids by row).  Whole
    epochs are taken first; the rest of the target, rounded to a word, is cut from the front of that
    order, so at most one document of a source is cut within.  Null text has size 0, null is a source of
    its own, an empty table gives no rows; other columns are ignored.
    """
    d = fields(stable(docs), doc_id="long", source="string", text="string").select(UID, "doc_id", "source", n_words(F.col("text")).alias("size"))
    d = d.withColumn("key", F.concat(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lpad(F.hex(UID), 16, "0")))
    d = materialise(d, "sizes")  # texts are counted once
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    plan = targets(sizes.drop("n"), weights, share, most)
    placed = prefix_sums(d, ["source"], "key", "size", rows)
    a, p = placed.alias("a"), plan.alias("p")
    out = join_small(a, p, F.col("a.source").eqNullSafe(F.col("p.source")), "inner", sizes.count())
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    cut = F.round(F.col("target")).cast("long") - epochs * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), cut - F.col("before")))
    return out.select(
        f"a.{UID}", "a.doc_id", "a.source", "a.size", "p.source_size", "p.target",
        (epochs * F.col("size") + part).alias("taken"), epochs.alias("epochs"), part.alias("part"),
    )


def mix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, production parameters."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of documents: a row for every epoch, and a last one cut after its words.

    Columns of any names pass through.
    A text that is cut (one of a source at most) keeps its first `part` words, joined by single spaces.
    """
    docs = stable(docs)
    m = mix(docs).filter("taken > 0").select(UID, "size", "epochs", "part")
    text = f"c{docs.columns.index('text')}"
    d = numbered(docs).withColumn(text, F.col(text).cast("string")).join(m, UID)
    copies = F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("take", F.explode(copies))
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("take").cast("int")), " ")
    d = d.withColumn(text, F.when(F.col("take") < F.col("size"), head).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        i = docs.columns.index("n_chars")
        d = d.withColumn(f"c{i}", F.length(text).cast(docs.schema[i].dataType))
    return whole_rows(d, docs)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN level * w >= cap THEN cap ELSE max(CASE WHEN level * w < cap THEN level END) OVER () * w END AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, round(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM p
"""
