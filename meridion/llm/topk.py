"""Exact top-k by inner product (operator 7): impact-ordered, score-at-a-time, rescored exactly.

A shard's components are quantised to impacts, the component divided by a step and rounded, and are processed in the
order of descending impact: the components of a band of impacts, of a tile of vectors and a tile of queries, are added
to the tile's accumulators as one product.  Between bands the norms of what is still unprocessed bound every score from
both sides (Cauchy-Schwarz).  A query's floor is the k-th best score that it has met, or in its first tile what the
bounds prove; a vector whose bound is below the floor is out, and a query goes on to the next band only while too many
of the tile's vectors are left.  What is left is rescored exactly, and raises the floor.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridion.llm.common import UID, fields, materialise, stable, table

K = 20
SCALE = 64
EVERY = 20
SHARD_ROWS = 1 << 19
QUERY_ROWS = 1 << 15
#: Impacts of the largest component, and accumulators that a task holds at a time (they stay in a core's cache),
#: and possible members rescored at a time.
LEVELS = 32
CELLS = 1 << 19
PAIRS = 1 << 16
#: Bounds are looked at where so much of the norms is unprocessed, and at the end.
SHARES = (1 / 8, 1 / 64)


class ImpactIndex:
    """A shard's vectors by quantised impact; its rows come in the order that settles equal scores."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        n, self.width = vectors.shape
        top = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))
        self.step = max(1, top // LEVELS)
        # Sums of products are exact in single precision below 2**24, and in double precision below 2**53.
        most = top * top * max(1, self.width)
        self.real = np.float32 if most < 1 << 24 else np.float64
        self.kind = self.real if most < 1 << 53 else np.int64 if most < 1 << 62 else object
        self.queries_at = max(1, min(256, math.isqrt(CELLS) // 2))
        self.rows_at = max(1, CELLS // self.queries_at)
        # Of each impact, what it leaves unprocessed when it is processed and when it isn't.
        levels = top // self.step + 2
        done, open_, longest = np.zeros(levels), np.zeros(levels), 0.0
        for i in range(0, n, self.rows_at):
            x = vectors[i : i + self.rows_at].astype(np.float64)
            level = np.rint(x / self.step)
            impact = np.abs(level).astype(np.int64).ravel()
            done += np.bincount(impact, ((x - level * self.step) ** 2).ravel(), levels)
            open_ += np.bincount(impact, (x**2).ravel(), levels)
            longest = max(longest, float((x**2).sum(1).max(initial=0)))
        self.longest = math.sqrt(longest)
        # rest[t]: the share of the norms that is left once the impacts above t are processed.
        rest = np.sqrt((np.cumsum(open_) + done.sum() - np.cumsum(done)) / max(open_.sum(), 1e-300))
        self.looks = sorted({0, *(int(np.searchsorted(rest, share, side="right")) - 1 for share in SHARES if rest[0] <= share)}, reverse=True)

    def bands(self, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For rows i to j, by descending impact: the components of a band, and beside them by how much the norm of
        what is unprocessed changes; and that norm."""
        x = self.vectors[i:j].astype(np.float64)
        level = np.rint(x / self.step)
        impact, level, above, before = np.abs(level), level * self.step, np.inf, 0.0
        for least in self.looks:
            m = np.empty((j - i, self.width + 1), self.real)
            m[:, :-1] = np.where((impact > least) & (impact <= above), level, 0)
            rest = np.sqrt((np.where(impact > least, x - level, x) ** 2).sum(1)) * (1 + 1e-6)
            m[:, -1] = rest - before
            yield m, rest
            above, before = least, rest

    def possible(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) that bounds leave in the running; own[i] is the query's row here or -1."""
        found = [x[:2] for x in self._rescored(queries, own, k, [])]
        return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found) if found else ((), ())))

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) of the k best of each query, equal scores by row."""
        tops: list[_Best] = []
        for _ in self._rescored(queries, own, k, tops):
            pass
        for t in tops:
            t.settle()
        return tuple(np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*((t.a + i * self.queries_at, t.b, t.score) for i, t in enumerate(tops))) if tops else ((), (), ())))

    def _rescored(self, queries: np.ndarray, own: np.ndarray, k: int, tops: list[_Best]) -> Iterator[tuple[np.ndarray, ...]]:
        """(query, vector, exact score) of the pairs that are left, tile by tile; `tops` holds the best of each tile of
        queries."""
        step, tiles = self.queries_at, []
        for i in range(0, len(queries), step):
            q = queries[i : i + step]
            norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
            tiles.append((i, q, norm, np.ascontiguousarray(np.concatenate([q.T.astype(self.real), norm[None].astype(self.real)]))))
            tops.append(_Best(len(q), k))
        # Rounding of the products and of the bounds is kept on the safe side.
        slip = 8 * (self.width + 2) * float(np.finfo(self.real).eps) * self.longest
        for r in range(0, len(self.vectors), self.rows_at):
            e = min(r + self.rows_at, len(self.vectors))
            ahead, bands = self.bands(r, e), []
            for (i, q, norm, right), top in zip(tiles, tops):
                todo, high, margin = np.arange(len(q)), None, slip * norm + 1e-3
                for look in range(len(self.looks)):
                    if look == len(bands):
                        bands.append(next(ahead))
                    part, rest = bands[look]
                    some = right if len(todo) == len(q) else right[:, todo]
                    if high is None:
                        high = part @ some
                    else:
                        high += part @ some
                    floor = top.floor[todo]
                    if len(new := np.flatnonzero(np.isneginf(floor))):
                        floor[new] = _proved(high[:, new], rest, norm[todo[new]], k) - margin[todo[new]]
                    bound = (floor - margin[todo]).astype(self.real)
                    hit = high >= bound
                    if look + 1 < len(self.looks) and np.count_nonzero(hit) > 2 * k * len(todo):
                        go = np.count_nonzero(hit, axis=0) > 8 * k
                        pick = np.flatnonzero(~go)
                        b, a = np.nonzero(hit[:, pick])
                        left = (todo[pick[a]], b)
                        todo, high = todo[go], np.ascontiguousarray(high[:, go])
                    else:
                        b, a = _nonzero(hit)
                        left, todo = (todo[a], b), todo[:0]
                    a, b = left[0], left[1] + r
                    other = own[i + a] != b
                    a, b = a[other], b[other]
                    score = self.rescore(q, a, b)
                    yield a + i, b, score
                    top.add(a, b, score)
                    if not len(todo):
                        break

    def rescore(self, queries: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        parts = [np.empty(0, np.int64)]
        for i in range(0, len(a), PAIRS):
            x, y = queries[a[i : i + PAIRS]].astype(self.kind), self.vectors[b[i : i + PAIRS]].astype(self.kind)
            parts.append((np.einsum("ij,ij->i", x, y) if self.kind is not object else (x * y).sum(1)).astype(np.int64))
        return np.concatenate(parts)


class _Best:
    """The k best of a tile of queries: (a, b, score), and those that have come since; floor: the k-th best score."""

    def __init__(self, queries: int, k: int):
        self.k, self.queries, self.new, self.parts = k, queries, 0, []
        self.a, self.b, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.floor = np.full(queries, -np.inf)

    def add(self, a: np.ndarray, b: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.floor[a]
        self.parts.append((a[keep], b[keep], score[keep]))
        self.new += int(np.count_nonzero(keep))
        if self.new > self.queries * self.k or np.isneginf(self.floor).any():
            self.settle()

    def settle(self) -> None:
        a, b, score = (np.concatenate(x) for x in zip((self.a, self.b, self.score), *self.parts))
        order = np.lexsort((b, -score, a))
        a, b, score = a[order], b[order], score[order]
        nth = np.arange(len(a)) - np.searchsorted(a, a)
        self.a, self.b, self.score = (x[nth < self.k] for x in (a, b, score))
        last = nth == self.k - 1
        # A double below the score, where it can't hold it.
        self.floor[a[last]] = np.nextafter(score[last].astype(np.float64), -np.inf)
        self.new, self.parts = 0, []


def _proved(high: np.ndarray, rest: np.ndarray, norm: np.ndarray, k: int) -> np.ndarray:
    """What k + 1 of the rows reach by their bounds, one of each of several runs of rows; one may be the query's own."""
    n, m = high.shape
    run = n // (4 * (k + 1)) or 1
    runs = n // run
    if runs < k + 1:
        return np.full(m, -np.inf)
    best = high[: runs * run].reshape(runs, run, m).max(1) - 2 * rest[: runs * run].reshape(runs, run).max(1)[:, None] * norm
    return np.partition(best, runs - k - 1, axis=0)[runs - k - 1]


def _nonzero(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix with few hits, eight cells at a time."""
    n, m = hit.shape
    if m % 8 or not hit.flags.c_contiguous:
        return np.nonzero(hit)
    at = np.flatnonzero(hit.view(np.uint64))
    k, j = np.nonzero(hit.reshape(-1, 8)[at])
    return np.divmod(at[k] * 8 + j, m)


def _matrix(t: pa.Table, name: str) -> np.ndarray:
    flat = t.column(name).combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else pa.concat_arrays(flat.chunks)
    return np.asarray(flat.flatten()).reshape(t.num_rows, -1)


FOUND = pa.schema([("query_uid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("uid", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "query_uid long, query_id long, vec_id long, uid long, score long"


def _search(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return FOUND.empty_table()
        # Equal scores go by id (null last), then by row: the order of the index's rows.
        vectors = vectors.take(pc.sort_indices(vectors, [("vec_id", "ascending"), ("uid", "ascending")], null_placement="at_end"))
        v, q = _matrix(vectors, "v"), _matrix(queries, "v")
        uid = np.asarray(vectors.column("uid"))
        order = np.argsort(uid)
        quid, qid = np.asarray(queries.column("uid")), np.asarray(queries.column("vec_id"))
        at = np.minimum(np.searchsorted(uid[order], quid), len(uid) - 1)
        own = np.where(uid[order][at] == quid, order[at], -1)
        a, b, score = ImpactIndex(v).best(q, own, k)
        return pa.Table.from_arrays([pa.array(quid[a]), pa.array(qid[a]), vectors.column("vec_id").take(pa.array(b)).combine_chunks(), pa.array(uid[b]), pa.array(score)], schema=FOUND)

    return run


def search(embeddings: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by `every`.

    Components become floor(scale * x).  Rows whose vector is null or holds a null or non-finite component
    take no part; shorter vectors count as filled up with zeros; a row without an id is no query and comes
    last among equal scores.  Repeated ids are rows of their own: each is a query, and finds the others.
    Blocks of queries meet blocks of vectors (the stated query set against all rows); every block size is
    bounded, and a query's k best of each block are merged.
    """
    e = fields(stable(embeddings), vec_id="long", embedding="array<double>").select(F.col(UID).alias("uid"), "vec_id", F.col("embedding").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    e = materialise(e.filter(F.col("x").isNotNull() & finite).select("uid", "vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v")), "vectors")
    is_query = F.col("vec_id") % every == 0
    n, nq, width, low, high = e.agg(F.count("*"), F.count(F.when(is_query, 1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    # The narrowest type that holds the components: vectors are what is moved.
    most = max(-(low or 0) - 1, high or 0)
    kind = next(t for t, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 64)) if most < 1 << bits)
    v = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(max(1, width)) - F.size("v"))).cast(f"array<{kind}>")
    e = e.withColumn("v", v)
    # Of equal vectors only the first can be among the k best of any query (one of them may be the query itself).
    copies = Window.partitionBy("print", "v").orderBy(F.asc_nulls_last("vec_id"), "uid")
    firsts = e.withColumn("print", F.xxhash64("v")).withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= k + 1).select("uid", "vec_id", "v")
    shards = max(1, -(-n // SHARD_ROWS), min(4, -(-n // 1024)))
    blocks = max(1, -(-nq // QUERY_ROWS), min(8, -(-nq // 256)))
    place = lambda parts, seed: F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(parts))
    v = firsts.withColumn("shard", place(shards, 1)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = e.filter(is_query).withColumn("block", place(blocks, 2).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    found = v.groupBy("shard", "block").cogroup(q.groupBy("shard", "block")).applyInArrow(_search(k), FOUND_DDL)
    w = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "uid")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
