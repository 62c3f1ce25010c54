"""N-gram Jaccard join (operator 2): a MinHash LSH forest, then exact verification.

Each tree labels a document with DEPTH minima of a byte each, and its sorted labels are a prefix trie: documents under
one node are candidates.  Prefixes are shortened level by level, from the whole label, until the recall at the threshold
reaches the target.  That recall is measured on the pairs found so far whose sketches say that they are close to the
threshold: in how many trees do they share a node?  A level only looks at nodes in which subtrees meet.  Within a node
the signatures link documents to a spanning forest (no pairs are listed); over the components of those links, every
pair's Jaccard similarity is computed from the shingles themselves, in blocks, and only counts and a spanning forest of
true links leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.llm.common import UID, doc_order, fields, join_small, materialise, release, rows_without, small_batches, stable, table
from meridion.llm.numtext import gram_hashes, mix, slabs, stretches, utf8, word_hashes, words

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.9999
#: Minima of each tree that are compared when documents are linked, and the share of equal ones that links two: over five
#: standard deviations below what a pair at the threshold shows.
SKETCH = 4
LINK = 0.6
#: Recall is measured on pairs whose signatures agree by the threshold to so much more, and on so many pairs at least;
#: on fewer, it is what independent minima give.
NEAR, MEASURED = 0.06, 100
#: Documents of a node in a part, and of a component in a block; shingles in a block; bytes cut into shingles at a time.
NODE_ROWS = 4096
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 21
STRETCH = 1 << 22
_CHUNK = 2048


def share_of_trees(found: float, trees: int = TREES) -> float:
    """The share of trees that pairs meet in, from the mean number `found` over pairs that met at least once."""
    low, high = 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if trees * p / max(1e-300, 1 - (1 - p) ** trees) < found else (low, p)
    return (low + high) / 2


def recall_at(threshold: float, depth: int, trees: int = TREES, pairs: int = 0, found: float = 0.0, similarity: float = 0.0) -> float:
    """Recall of prefixes of `depth` for pairs at the threshold: measured on `pairs` pairs of a mean `similarity`, which
    met in `found` trees on average, or for too few pairs what independent minima give."""
    p = threshold**depth if pairs < MEASURED else share_of_trees(found, trees) * min(1.0, (threshold / similarity) ** depth)
    return 1 - (1 - p) ** trees


_MULTIPLIERS = np.random.default_rng(20240301).integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles of all rows, sorted within a row; first of each row).  A row of fewer words has
    its whole sequence as its one shingle, a row without words none."""
    if len(offsets) == 2 and len(data) > STRETCH:
        got = _long_shingles(data, size)
        return got, np.array([0, len(got)])
    starts, ends, rows = words(data, offsets)
    h = word_hashes(data, starts, ends)
    grams = gram_hashes(h, size)
    row = np.searchsorted(rows, np.arange(len(grams)), side="right") - 1
    ok = np.arange(len(grams)) + size <= rows[row + 1] if len(grams) else np.empty(0, bool)
    n = np.diff(rows)
    short = np.flatnonzero((n > 0) & (n < size))
    lone = np.array([_lone(h[rows[r] : rows[r + 1]]) for r in short], np.uint64)
    row, grams = np.concatenate([row[ok], short]), np.concatenate([grams[ok], lone])
    order = np.lexsort((grams, row))
    row, grams = row[order], grams[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
    return grams[new], np.searchsorted(row[new], np.arange(len(offsets)))


def _lone(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little")


def _long_shingles(data: np.ndarray, size: int) -> np.ndarray:
    """The shingles of one long text, cut at white space into stretches that share their outer words."""
    held, parts = np.empty(0, np.uint64), [np.empty(0, np.uint64)]
    for i, j in stretches(data, STRETCH):
        starts, ends, _ = words(data[i:j], np.array([0, j - i]))
        h = np.concatenate([held, word_hashes(data[i:j], starts, ends)])
        parts.append(np.unique(gram_hashes(h, size)))
        held = h[len(h) - min(len(h), size - 1) :]
    whole = np.unique(np.concatenate(parts))
    return whole if len(whole) or not len(held) else np.array([_lone(held)], np.uint64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        data, offsets = utf8(b.column(2))
        size = np.zeros(b.num_rows, np.int64)
        digests, labels = [b""] * b.num_rows, [None] * b.num_rows
        for i, j in slabs(offsets, 1 << 20):
            s, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            size[i:j] = np.diff(first)
            some = np.flatnonzero(size[i:j])
            if not len(some):
                continue
            x = (s >> np.uint64(32)).astype(np.uint32)
            minima = np.empty((len(some), TREES * DEPTH), np.uint32)
            for d in range(TREES * DEPTH):
                minima[:, d] = np.minimum.reduceat(x * _MULTIPLIERS[d], first[some])
            flat = mix(minima.astype(np.uint64)).astype(np.uint8).view(">u8").astype(np.int64)
            for r, at in enumerate(some.tolist()):
                digests[i + at] = hashlib.blake2b(s[first[at] : first[at + 1]].tobytes(), digest_size=16).digest()
                labels[i + at] = flat[r]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(digests, pa.binary()), pa.array(labels, pa.list_(pa.int64()))], names=[UID, "doc_id", "n", "digest", "labels"])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that are sorted by their first `keys` columns: (rows, start of each group)."""
    release()
    held: list[pa.RecordBatch] = []

    def starts(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        if t.num_rows > 1:
            new[1:] = False
            for c in range(keys):
                x = t.column(c).to_numpy()
                new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        if held and not any(b.column(c)[b.num_rows - 1] != held[0].column(c)[0] for c in range(keys)):
            held.append(b)
            continue
        t = pa.Table.from_batches([*held, b]).combine_chunks()
        at = starts(t)
        if len(at) > 1:
            yield t.slice(0, at[-1]), at[:-1]
            held = t.slice(at[-1]).combine_chunks().to_batches()
        else:
            held = t.to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, starts(t)


def _spanning(n: int, similar) -> np.ndarray:
    """Roots of the components of an implicit graph; similar(i, others) are booleans."""
    root = np.full(n, -1)
    left = np.arange(n)
    while len(left):
        seed, queue = left[0], [left[0]]
        root[seed], left = seed, left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = similar(i, left)
            found, left = left[hit], left[~hit]
            root[found] = seed
            queue.extend(found.tolist())
    return root


EDGE_DDL = "a long, b long, trees int, equal int"
EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("trees", pa.int32()), ("equal", pa.int32())])


def _link(depth: int):
    """Rows (tree, node, i, j, label, uid, labels): links within a part of a node, or between two parts.  A link also says in
    how many trees its ends share a node of this depth, and how many of their minima are equal."""
    shift = np.uint64(8 * (DEPTH - depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in _groups(batches, 4):
            uid = np.asarray(t.column(5).combine_chunks())
            lists = t.column(6).combine_chunks()
            lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
            labels = np.asarray(lists.flatten()).astype(">i8").view(np.uint8).reshape(len(uid), TREES, DEPTH)
            sketch = np.ascontiguousarray(labels[:, :, DEPTH - SKETCH :]).reshape(len(uid), -1)
            enough = int(np.ceil(LINK * sketch.shape[1]))
            size = np.diff(np.append(first, len(uid)))
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for m in np.unique(size[size <= 6]):
                if m < 2:
                    continue
                i, j = np.triu_indices(m, 1)
                base = first[size == m]
                for chunk in np.array_split(base, max(1, len(base) * len(i) // 50_000)):
                    x, y = (chunk[:, None] + i).ravel(), (chunk[:, None] + j).ravel()
                    hit = (sketch[x] == sketch[y]).sum(1) >= enough
                    a.append(x[hit])
                    b.append(y[hit])
            for f, m in zip(first[size > 6].tolist(), size[size > 6].tolist()):
                s = sketch[f : f + m]
                root = _spanning(m, lambda i, others: (s[others] == s[i]).sum(1) >= enough)
                child = np.flatnonzero(root != np.arange(m))
                a.append(f + child)
                b.append(f + root[child])
            a, b = np.concatenate(a), np.concatenate(b)
            for i in range(0, max(1, len(a)), 50_000):
                x, y = a[i : i + 50_000], b[i : i + 50_000]
                equal = labels[x] == labels[y]
                met = ((labels[x].view(">u8") ^ labels[y].view(">u8")).astype(np.uint64) >> shift == 0).sum((1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(uid[x], uid[y])), pa.array(np.minimum(uid[x], uid[y])), pa.array(met.astype(np.int32)), pa.array(equal.sum((1, 2)).astype(np.int32))], schema=EDGE)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id of each vertex's component, by alternating large and small stars."""
    e = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        # Large star: neighbours above a vertex move to the smallest around it.
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # The minima are written, so that the join can split the tasks of a vertex with many neighbours.
        low = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        e = materialise(both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Small star: a vertex and its neighbours below move to the smallest of them.
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialise(moved.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        state = now


SET_DDL = f"{UID} long, shingles array<long>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        data, offsets = utf8(b.column(1))
        flat, bounds = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)]
        total = 0
        for i, j in slabs(offsets):
            s, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            flat.append(s)
            bounds.append(first[1:] + total)
            total += len(s)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(bounds), pa.int32()), pa.array(np.concatenate(flat).view(np.int64)))
        yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[UID, "shingles"])


def intersections(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of rows of distinct values, as a matrix."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    value, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(shared.sum())
    for c in range(0, width, _CHUNK):
        a, b = np.searchsorted(column, [c, c + _CHUNK])
        m = np.zeros((n, min(_CHUNK, width - c)), np.float32)
        m[row[a:b], column[a:b] - c] = 1
        out += m @ m.T
    return out


LINK_DDL = "id long, root long, links long"


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (component, i, j, block, uid, shingles): links between blocks i and j of a component."""
        for t, first in _groups(batches, 3):
            ids, roots, links = [], [], []
            bounds = np.append(first, t.num_rows)
            i, j, block, uid = (np.asarray(t.column(c).combine_chunks()) for c in (1, 2, 3, 4))
            lists = t.column(5).combine_chunks()
            lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
            offsets, flat = np.asarray(lists.offsets, np.int64), np.asarray(lists.values)
            for a, e in zip(bounds, bounds[1:]):
                o = offsets[a : e + 1]
                size = np.diff(o).astype(np.float64)
                both = intersections(flat[o[0] : o[-1]], o - o[0]).astype(np.float64)
                linked = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                np.fill_diagonal(linked, False)
                if i[a] != j[a]:  # pairs inside a block are met with the block itself
                    linked &= block[a:e, None] != block[None, a:e]
                root = _spanning(e - a, lambda x, others: linked[x, others])
                ids.append(uid[a:e])
                roots.append(uid[a:e][root])
                links.append(linked.sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(roots)), pa.array(np.concatenate(links).astype(np.int64))], names=["id", "root", "links"])

    return run


def _sorted(df: DataFrame, by: list[str], *more: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by).sortWithinPartitions(*by, *more)


def forest(s: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Links (a, b) between the rows (uid, labels) that share a node of some tree, down to the depth of the target recall."""
    leaves = s.select(UID, F.posexplode("labels").alias("tree", "label"))
    at = lambda x, depth: F.shiftrightunsigned(x, 8 * (DEPTH - depth))
    edges = None
    for depth in range(DEPTH, 0, -1):
        nodes = leaves.withColumn("node", at("label", depth))
        full = nodes.groupBy("tree", "node").agg(F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).filter("c > 1")
        if depth < DEPTH:
            # Nodes with one subtree were looked at a level deeper.
            full = full.filter(at("low", depth + 1) != at("high", depth + 1))
        full = materialise(full.select("tree", "node", "c"), "full")
        met = materialise(nodes.join(full, ["tree", "node"]), "nodes")
        parts = F.ceil(F.col("c") / NODE_ROWS).cast("long")
        own, other = F.pmod(F.xxhash64(UID, "tree"), parts), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
        # Every two parts of a large node meet, so no pair of a node is left out.
        rows = met.withColumn("own", own).withColumn("other", other).join(s.select(UID, "labels"), UID)
        rows = rows.select("tree", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "label", UID, "labels")
        linked = materialise(_sorted(rows, ["tree", "node", "i", "j"], "label").mapInArrow(_link(depth), EDGE_DDL), "links")
        edges = linked.select("a", "b") if edges is None else edges.unionAll(linked.select("a", "b"))
        equal = TREES * DEPTH
        near = linked.filter(F.col("equal").between(threshold * equal, min(1.0, threshold + NEAR) * equal)).distinct()
        got = near.agg(F.count("*").alias("pairs"), F.avg("trees").alias("found"), F.avg(F.col("equal") / equal).alias("similarity")).first()
        if recall_at(threshold, depth, TREES, got.pairs, got.found or 0.0, got.similarity or 1.0) >= recall:
            break
    return edges


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: row uid, doc_id, class_id, class_size, n_links, set_id, set_size.

    Documents with equal sets of five-word shingles form a set (`set_id`: its smallest doc_id).  Two sets
    are linked if their Jaccard similarity is at least the threshold; `n_links` counts the sets linked to
    a document's own.  Chains of links form a class (`class_id`: its smallest doc_id).  A text of one to
    four words is one shingle; a null text or one without words stands alone and has no links.  Repeated
    rows share a set; a null id is the largest, and the class_id of a class of such rows is null.  An
    empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    d = fields(stable(docs), doc_id="long", text="string")
    s = materialise(d.mapInArrow(_signatures, f"{UID} long, doc_id long, n long, digest binary, labels array<long>"), "signatures")
    s = s.withColumn("rank", doc_order())
    same = s.filter("n > 0").groupBy("digest", "n").agg(F.min(UID).alias("rep"), F.min("rank").alias("top"), F.count("*").alias("copies"))
    same = materialise(same.filter("copies > 1"), "sets")
    placed = join_small(s.select(UID, "doc_id", "rank", "n", "digest"), same, ["digest", "n"], "left")
    placed = materialise(placed.select(UID, "doc_id", "rank", F.coalesce("rep", UID).alias("rep"), F.coalesce("top", "rank").alias("top"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies")), "placed")
    others = placed.filter(F.col("rep") != F.col(UID)).select(UID)
    s = join_small(s.filter("n > 0"), others, UID, "left_anti")
    edges = forest(s, threshold)
    near = components(edges)
    near = materialise(near.join(s.select(F.col(UID).alias("id"), "n"), "id"), "near")

    blocks = near.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_ROWS)).cast("long").alias("blocks"))
    members = materialise(join_small(near, blocks, "root", "inner").select(F.col("id").alias(UID), "root", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")), "members")
    texts = join_small(d, members.select(UID), UID, "left_semi").select(UID, "text")
    sets = texts.mapInArrow(_sets, SET_DDL).join(members, UID)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    sets = sets.withColumn("other", other).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", UID, "shingles")
    found = materialise(_sorted(sets, ["root", "i", "j"]).mapInArrow(_verify(threshold), LINK_DDL), "verified")
    counts = found.groupBy("id").agg(F.sum("links").alias("links")).filter("links > 0")
    roots = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    result = materialise(counts.join(roots, "id").select(F.col("id").alias("rep"), "links", "root"), "result")

    # Sets that hold several documents, and sets with links, are the only ones to be joined.
    out = placed.join(result, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    classes = out.groupBy("root").agg(F.min("rank").alias("class_rank"), F.count("*").alias("class_size")).filter("class_size > 1")
    out = join_small(out, classes, "root", "left")
    known = lambda c: F.when(c != (1 << 63) - 1, c)
    return out.select(
        UID, "doc_id", known(F.coalesce("class_rank", "rank")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), known(F.col("top")).alias("set_id"), F.col("copies").alias("set_size"), F.col("root").alias("_root"),
    )


def join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).drop(UID, "_root")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each class (the one with the smallest doc_id), in the columns of the input."""
    docs = stable(docs)
    j = materialise(join(docs).select(UID, "_root", "class_size", doc_order().alias("rank")), "classes")
    many = j.filter("class_size > 1")
    top = many.groupBy("_root").agg(F.min("rank").alias("top"))
    first = many.join(top, "_root").filter("rank = top").groupBy("_root").agg(F.min(UID).alias("first"))
    return rows_without(docs, materialise(many.join(first, "_root").filter(F.col(UID) != F.col("first")).select(UID), "gone"))
