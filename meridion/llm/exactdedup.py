"""Exact dedup (operator 8): Golomb-coded fingerprint exchange, duplicate bitmaps, byte verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.llm.common import UID, fields, join_small, materialise, rows_without, stable, table

#: Rows whose fingerprints one sender codes together; bounds a block whatever the size of a partition.
BLOCK_ROWS = 32_768


def golomb_encode(values: np.ndarray) -> tuple[int, bytes]:
    """Sorted uint64 values as Golomb-Rice codes of their gaps: (bits of the remainder, coded bytes)."""
    if not len(values):
        return 0, b""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = max(1.0, float(values[-1]) / len(values))
    k = max(0, min(63, int(np.log2(mean * 0.69 + 1))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    stops = np.cumsum(quotient + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 1
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    low = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return k, np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def golomb_decode(k: int, n: int, coded: bytes) -> np.ndarray:
    """The n values of golomb_encode."""
    if not n:
        return np.empty(0, np.uint64)
    tail = -(-n * k // 8)
    raw = np.frombuffer(coded, np.uint8)
    stops = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]))[:n]
    quotient = np.diff(stops, prepend=-1) - 1
    gaps = quotient.astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(raw[len(raw) - tail :])[: n * k].reshape(n, k)
        for column in range(k):
            gaps |= low[:, column].astype(np.uint64) << np.uint64(k - 1 - column)
    return np.cumsum(gaps, dtype=np.uint64)


def _blocks(owners: int):
    width = -(-(1 << 64) // owners)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_uid, held_fp, n = [], [], 0

        def flush():
            uid, fp = np.concatenate(held_uid), np.concatenate(held_fp)
            order = np.argsort(fp, kind="stable")
            uid, fp = uid[order], fp[order]
            # Equal fingerprints of a block are sent once, with a mark: an owner gets no more for a text than blocks.
            first = np.flatnonzero(np.diff(fp, prepend=fp[0] ^ np.uint64(1)) != 0)
            times = np.diff(np.append(first, len(fp)))
            one = fp[first]
            owner = (one // np.uint64(width)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(owner, prepend=-1))
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(one)]):
                k, coded = golomb_encode(one[a:b] - np.uint64(int(owner[a]) * width))
                mine = uid[first[a] : first[b] if b < len(first) else len(uid)]
                rows.append((int(owner[a]), int(mine.min()), k, int(b - a), coded, np.packbits(times[a:b] > 1).tobytes(), times[a:b].astype("<u4").tobytes(), mine.astype("<i8").tobytes()))
            return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=BLOCK.names), schema=BLOCK, preserve_index=False)

        for b in batches:
            uid = np.asarray(b.column(0))
            fp = np.asarray(b.column(1)).view(np.uint64)
            for i in range(0, len(uid), BLOCK_ROWS):
                held_uid.append(uid[i : i + BLOCK_ROWS])
                held_fp.append(fp[i : i + BLOCK_ROWS])
                n += len(held_uid[-1])
                if n >= BLOCK_ROWS:
                    yield flush()
                    held_uid, held_fp, n = [], [], 0
        if n:
            yield flush()

    return send


BLOCK = pa.schema([("owner", pa.int64()), ("block", pa.int64()), ("k", pa.int32()), ("n", pa.int32()), ("coded", pa.binary()), ("again", pa.binary()), ("times", pa.binary()), ("uids", pa.binary())])
BLOCK_DDL = "owner long, block long, k int, n int, coded binary, again binary, times binary, uids binary"


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8))[:n].astype(bool)


def _own(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner decodes its blocks and answers each with a bitmap of the values that occur twice in it or in another."""
    parts = [golomb_decode(int(k), int(n), c) for k, n, c in zip(pdf["k"], pdf["n"], pdf["coded"])]
    again = [_bits(a, int(n)) for a, n in zip(pdf["again"], pdf["n"])]
    every = np.sort(np.concatenate(parts))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    out = []
    for owner, block, p, hit in zip(pdf["owner"], pdf["block"], parts, again):
        if len(twice):
            at = np.searchsorted(twice, p)
            hit = hit | ((at < len(twice)) & (twice[np.minimum(at, len(twice) - 1)] == p))
        if hit.any():
            out.append((owner, block, np.packbits(hit).tobytes()))
    return pd.DataFrame(out, columns=["owner", "block", "bitmap"])


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [np.empty(0, np.int64)]
        for uids, times, bitmap in zip(*(b.column(i).to_pylist() for i in range(3))):
            t = np.frombuffer(times, "<u4")
            got.append(np.frombuffer(uids, "<i8")[np.repeat(_bits(bitmap, len(t)), t)])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got))], names=[UID])


def duplicate_uids(prints: DataFrame, rows: int) -> DataFrame:
    """Uids of the rows of (uid, fp) whose fingerprint occurs more than once."""
    owners = max(16, -(-rows // 250_000))
    blocks = materialise(prints.select(UID, "fp").mapInArrow(_blocks(owners), BLOCK_DDL), "golomb")
    answers = blocks.select("owner", "block", "k", "n", "coded", "again").groupBy("owner").applyInPandas(_own, "owner long, block long, bitmap binary")
    return blocks.select("owner", "block", "times", "uids").join(answers, ["owner", "block"]).select("uids", "times", "bitmap").mapInArrow(_suspects, f"{UID} long")


def groups(docs: DataFrame) -> DataFrame:
    """One row a document: row uid, doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; texts are compared unchanged, byte by byte.  Of equal texts the row with
    the largest doc_id stays (null ids are smallest; of rows with that same id, the first one read).
    Repeated rows are members like any other.  An empty table gives no rows.  Other columns are ignored.
    """
    d = fields(stable(docs), doc_id="long", text="string").select(UID, "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sha = F.sha2(F.col("text").cast("binary"), 256)
    f = materialise(d.select(UID, "doc_id", F.unhex(sha).alias("sha"), F.xxhash64("text").alias("fp")), "prints")
    suspects = materialise(duplicate_uids(f, f.count()), "suspects")
    texts = join_small(d, suspects, UID, "left_semi").withColumn("rank", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    # Grouping by the text itself is the byte comparison; partial sums leave one row a text and task.
    met = texts.groupBy(F.unhex(sha).alias("sha"), "text").agg(F.max("rank").alias("top"), F.count("*").alias("group_size"), F.count("doc_id").alias("ids"))
    met = materialise(met.filter("group_size > 1").drop("text"), "groups")
    members = join_small(join_small(f, suspects, UID, "left_semi"), met, "sha", "inner").withColumn("rank", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    first = members.filter("rank = top").groupBy("sha").agg(F.min(UID).alias("_first"))
    met = met.join(first, "sha").select(F.col("sha").alias("_sha"), F.when(F.col("ids") > 0, F.col("top")).alias("_top"), "_first", "group_size")
    out = join_small(f, met, F.col("sha") == F.col("_sha"), "left")
    return out.select(
        UID, "doc_id", F.when(F.col("_sha").isNull(), F.col("doc_id")).otherwise(F.col("_top")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("_sha").isNull() | (F.col(UID) == F.col("_first"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents")).drop(UID)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows that stay, in the columns of the input."""
    docs = stable(docs)
    return rows_without(docs, materialise(groups(docs).filter("not kept").select(UID), "dropped"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
