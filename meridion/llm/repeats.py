"""Repeated windows across documents: what substring dedup and suffix-array dedup share.

A window is L units (words or bytes) of one document.  Every window has an anchor, the gram with the
smallest hash among its grams of K units, so equal windows have equal anchors.

1. Equal documents are folded into the first of them.
2. Anchors that occur once belong to windows that occur once; they are dropped.
3. Around each anchor that is left, the run of windows it stands for is cut out as a piece.  Pieces are
   folded by content, keeping where they first occur.  A window holds at least half of its units beside
   the anchor on one side of it, so pieces whose anchor with either half occurs once are dropped too.
   The others go to the shard of their anchor: all occurrences of a window meet there, and a shard
   holds a bounded number of bytes.  Anchors that have too many different pieces for a shard (a passage
   with many surroundings) send single windows, spread by their content.
4. A shard's index (a suffix automaton or a suffix array) tells where each window first occurs.
5. What it says goes back to the pieces' documents, and the spans to remove follow.

Nothing is sampled: steps 2 and 3 only drop windows that cannot repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridion.llm.common import UID, discard, doc_order, fields, join_small, materialise, small_batches, stable
from meridion.llm.numtext import byte_values, gram_hashes, slabs, span_hashes, stretches, utf8, window_minima, word_hashes, words


#: Bytes of a text beyond which it is hashed in stretches, and windows of a stretch.
LONG, STEP = 1 << 21, 1 << 18


@dataclass(frozen=True)
class Units:
    """What is counted, the window, the anchor's length, and whether a document repeats itself."""

    name: str
    window: int
    gram: int
    within: bool
    shard_bytes: int

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        """Slabs of rows: (first row, row after the last, bytes, values, first unit of each row, byte spans of units
        or None, units of the row before these, units that are new).  A long row comes in stretches that overlap by a
        window less one."""
        for i, j in slabs(offsets):
            part, base = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if len(part) > LONG and j == i + 1:
                yield from ((i, j, part, *x) for x in self._stretched(part))
            elif self.name == "bytes":
                yield i, j, part, byte_values(part), base, None, 0, np.diff(base)
            else:
                starts, ends, rows = words(part, base)
                yield i, j, part, word_hashes(part, starts, ends), rows, (starts, ends), 0, np.diff(rows)

    def _stretched(self, part: np.ndarray) -> Iterator[tuple]:
        spans = None
        if self.name == "bytes":
            n, values = len(part), lambda a, e: byte_values(part[a:e])
        else:
            found = [(i, *words(part[i:j], np.array([0, j - i]))[:2]) for i, j in stretches(part, LONG)]
            hashes = np.concatenate([word_hashes(part[i : i + e[-1]], s, e) for i, s, e in found if len(s)] or [np.empty(0, np.uint64)])
            spans = tuple(np.concatenate([i + x[k] for i, *x in found]) for k in (0, 1))
            n, values = len(hashes), lambda a, e: hashes[a:e]
        for a in range(0, max(1, n - self.window + 1), STEP):
            e = min(n, a + STEP + self.window - 1)
            yield values(a, e), np.array([0, e - a]), spans, a, np.array([e - a if not a else max(0, e - a - self.window + 1)])

    def whole(self, text: bytes) -> bytes:
        return text if self.name == "bytes" else b" ".join(text.split())

    def anchors(self, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Runs of windows with one anchor: (row, first window, last window + 1, anchor's hash, its place)."""
        grams = gram_hashes(values, self.gram)
        at = window_minima(grams, self.window - self.gram + 1)
        row = np.searchsorted(rows, np.arange(len(at)), side="right") - 1
        ok = np.flatnonzero(np.arange(len(at)) + self.window <= rows[row + 1]) if len(at) else np.empty(0, np.int64)
        if not len(ok):
            return ok, ok, ok, ok, ok
        at, row = at[ok], row[ok]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))
        return row[first], ok[first], ok[last - 1] + 1, grams[at[first]].view(np.int64), at[first]

    def halves(self, values: np.ndarray, first: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """Hashes of the anchor with the half window before it and with that after it; null where a piece
        doesn't reach that far.  Each window of a piece holds one of the two."""
        before = (self.window - self.gram + 1) // 2
        after = self.window - self.gram + 1 - before
        a, e = at - before, at + self.gram + after
        near, far = a < first, e > end
        left = span_hashes(values, np.where(near, at, a), at + self.gram).view(np.int64)
        right = span_hashes(values, at, np.where(far, at, e)).view(np.int64)
        return pa.array(left, mask=near), pa.array(right, mask=far)


def _scan(u: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(2)
            data, offsets = utf8(text)
            sizes, prints = np.zeros(b.num_rows, np.int64), []
            bounds = np.zeros(b.num_rows + 1, np.int64)
            found: list[list] = []
            for i, j, _, values, rows, _, before, new in u.parts(data, offsets):
                sizes[i:j] += new
                row, _, _, fp, _ = u.anchors(values, rows)
                if before:  # a further stretch of the row
                    row, fp = np.concatenate([found[-1][2], row]), np.concatenate([found.pop()[3], fp])
                found.append([i, j, row, fp])
            for i, j, row, fp in found:
                order = np.lexsort((fp, row))
                row, fp = row[order], fp[order]
                nth = np.ones(len(fp), bool)
                step = 2 if u.within else 1  # twice in a document is enough to know that it repeats
                nth[step:] = (fp[step:] != fp[:-step]) | (row[step:] != row[:-step])
                row, fp = row[nth], fp[nth]
                prints.append(fp)
                bounds[i + 1 : j + 1] = np.bincount(row, minlength=j - i)
            shas = [hashlib.sha256(u.whole(t or b"")).digest() for t in text.cast(pa.binary()).to_pylist()]
            flat = np.concatenate(prints) if prints else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(bounds), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes), pa.array(shas, pa.binary()), lists], names=[UID, "doc_id", "n", "sha", "prints"])

    return run


PIECE = pa.schema([(UID, pa.int64()), ("rank", pa.int64()), ("start", pa.int64()), ("anchor", pa.int64()), ("key", pa.binary()), ("piece", pa.binary()), ("left", pa.int64()), ("right", pa.int64())])
PIECE_DDL = f"{UID} long, rank long, start long, anchor long, key binary, piece binary, left long, right long"


def _pieces(u: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(2))
            wanted = b.column(3)
            for i, j, part, values, rows, spans, before, _ in u.parts(data, offsets):
                row, first, last, fp, at = u.anchors(values, rows)
                keep = np.zeros(len(row), bool)
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                for k in range(j - i):
                    here = slice(cuts[k], cuts[k + 1])
                    keep[here] = np.isin(fp[here], np.asarray(wanted[i + k].values))
                row, first, last, fp, at = row[keep], first[keep], last[keep], fp[keep], at[keep]
                end = last + u.window - 1
                left, right = u.halves(values, first, end, at)
                first, end = first + before, end + before
                raw = part if before or len(part) > LONG else part.tobytes()
                if spans is None:
                    got = [bytes(raw[a:e]) for a, e in zip(first.tolist(), end.tolist())]
                else:
                    got = [b" ".join(bytes(raw[a:e]).split()) for a, e in zip(spans[0][first].tolist(), spans[1][end - 1].tolist())]
                keys = [hashlib.blake2b(p, digest_size=16).digest() for p in got]
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(first - rows[row]), pa.array(fp), pa.array(keys, pa.binary()), pa.array(got, pa.binary()), left, right], schema=PIECE)

    return run


def _windows(u: Units):
    """Splits pieces into their windows: (key of the piece, place in it, window, its key, first rank and start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, piece, rank, start in zip(*(b.column(i).to_pylist() for i in range(4))):
                units = piece if u.name == "bytes" else piece.split(b" ")
                cut = [units[r : r + u.window] for r in range(len(units) - u.window + 1)]
                cut = cut if u.name == "bytes" else [b" ".join(c) for c in cut]
                n = len(cut)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.binary()), pa.array(range(n), pa.int64()), pa.array([hashlib.blake2b(c, digest_size=16).digest() for c in cut], pa.binary()), pa.array(cut, pa.binary()), pa.array([rank] * n, pa.int64()), pa.array(range(start, start + n), pa.int64())], names=["of", "place", "key", "piece", "rank", "start"])

    return run


FOUND = pa.schema([("key", pa.binary()), ("from_", pa.int64()), ("to", pa.int64()), ("rank", pa.int64()), ("start", pa.int64())])
FOUND_DDL = "key binary, from_ long, to long, rank long, start long"


def _indexed(u: Units, index: Callable):
    """A shard: `index(pieces, ranks, starts)` gives for every window of every piece, one after another, the
    rank and the start of its first occurrence; equal steps are joined to runs."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        pieces = t.column("piece").to_pylist()
        rank, start, size = index(pieces, np.asarray(t.column("rank")), np.asarray(t.column("start")))
        owner = np.repeat(np.arange(len(pieces)), size)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (rank[1:] != rank[:-1])
        if u.within:
            new[1:] |= start[1:] != start[:-1] + 1
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(owner)) - 1
        return pa.Table.from_arrays([t.column("key").take(pa.array(owner[a])), pa.array(place[a]), pa.array(place[b] + 1), pa.array(rank[a]), pa.array(start[a])], schema=FOUND)

    return run


def _joined(lists: pa.ListArray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal spans of each row's runs of windows: (first span of each row, starts, ends)."""
    n = len(lists)
    offsets = np.asarray(lists.offsets, np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    row = np.repeat(np.arange(n), np.diff(offsets)) << 40  # rows apart, so that one sweep serves them all
    start, end = np.asarray(values.field("a")) + row, np.asarray(values.field("b")) + (reach - 1) + row
    order = np.argsort(start)
    start, far = start[order], np.maximum.accumulate(end[order]) if n else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > far[:-1]
    first = np.flatnonzero(new)
    start, end = start[first], far[np.append(first[1:], len(far)) - 1] if len(first) else far
    low = (1 << 40) - 1
    return np.searchsorted(start >> 40, np.arange(n + 1)), start & low, end & low


def _removal(u: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, start, end = _joined(b.column(2), u.window)
            shas = []
            for i, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                units = (text or b"") if u.name == "bytes" else (text or b"").split()
                kept, at = [], 0
                for a, e in zip(start[first[i] : first[i + 1]].tolist(), end[first[i] : first[i + 1]].tolist()):
                    kept.append(units[at:a])
                    at = e
                kept.append(units[at:])
                left = b"".join(kept) if u.name == "bytes" else b" ".join(w for k in kept for w in k)
                shas.append(hashlib.sha256(left).digest())
            total = np.concatenate([[0], np.cumsum(end - start)])
            spans = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], names=["start", "end"]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total[first[1:]] - total[first[:-1]]), spans, pa.array(shas, pa.binary())], names=["of", "removed", "spans", "left"])

    return run


def remove_repeats(docs: DataFrame, u: Units, index: Callable) -> DataFrame:
    """One row a document: row uid, doc_id, n (units), n_removed, spans (start, end in units), kept_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    d = fields(stable(docs), doc_id="long", text="string")
    scan = materialise(d.mapInArrow(_scan(u), f"{UID} long, doc_id long, n long, sha binary, prints array<long>"), "scan")
    a = scan.withColumn("rank", doc_order())
    same = a.filter(F.col("n") >= u.window).groupBy("sha", "n").agg(F.min("rank").alias("top"), F.count("*").alias("copies"))
    same = materialise(same.filter("copies > 1").drop("copies"), "same")
    folded = a.filter(F.col("n") >= u.window).select(UID, "rank", "sha", "n")
    folded = join_small(folded, same, ["sha", "n"], "inner")
    firsts = folded.filter("rank = top").groupBy("sha", "n").agg(F.min(UID).alias("first"))
    same = materialise(join_small(firsts, same, ["sha", "n"], "inner"), "firsts")
    # A copy stands for its first row; only first rows go on.
    placed = join_small(a.drop("prints"), same, ["sha", "n"], "left").withColumn("first", F.coalesce("first", UID)).withColumn("copy", F.coalesce(F.col("rank") > F.col("top"), F.lit(False)))
    placed = materialise(placed.select(UID, "doc_id", "rank", "n", "sha", "first", "copy"), "placed")
    copies = materialise(placed.filter(F.col("first") != F.col(UID)).select(UID), "copies")
    p = join_small(a.select(UID, "prints"), copies, UID, "left_anti").select(UID, F.explode("prints").alias("anchor"))
    # What is counted is written before it is joined with what it was counted from: the join then has its
    # own exchanges, and adaptive execution can split the tasks of a frequent anchor, half or piece.
    shared = materialise(p.groupBy("anchor").agg(F.count("*").alias("c")).filter("c > 1").select("anchor"), "shared")
    suspects = materialise(p.join(shared, "anchor").groupBy(UID).agg(F.collect_set("anchor").alias("anchors")), "suspects")
    discard(scan)
    discard(shared)
    ids = suspects.select(UID)
    texts = join_small(d, ids, UID, "left_semi").withColumn("rank", doc_order()).select(UID, "rank", "text")
    pieces = texts.join(suspects, UID).select(UID, "rank", "text", "anchors").mapInArrow(_pieces(u), PIECE_DDL)
    pieces = materialise(pieces, "pieces")

    folded = pieces.groupBy("key", "anchor", "piece").agg(F.min(F.struct("rank", "start")).alias("o"), F.first("left").alias("left"), F.first("right").alias("right"), F.count("*").alias("times"))
    folded = materialise(folded.select("key", "anchor", "piece", "o.rank", "o.start", F.array_compact(F.array("left", "right")).alias("halves"), "times"), "folded")
    halves = folded.select("key", "times", F.explode("halves").alias("half"))
    again = materialise(halves.groupBy("half").agg(F.sum("times").alias("times")).filter("times > 1").select("half"), "halves")
    alive = halves.select("key", "half").join(again, "half").select("key").distinct()
    every = folded
    folded = materialise(every.drop("halves", "times").join(alive, "key", "left_semi"), "alive")
    discard(every)
    discard(again)
    size = F.sum(F.octet_length("piece"))
    total = folded.agg(size).first()[0] or 0
    shards = max(16, -(-total // u.shard_bytes))
    heavy = materialise(folded.groupBy("anchor").agg(size.alias("s")).filter(F.col("s") > u.shard_bytes).select("anchor"), "heavy")
    n_heavy = heavy.count()
    run = _indexed(u, index)

    def search(rows: DataFrame, by: str) -> DataFrame:
        return rows.withColumn("shard", F.pmod(F.xxhash64(by), F.lit(shards))).select("shard", "key", "piece", "rank", "start").groupBy("shard").applyInArrow(run, FOUND_DDL)

    if n_heavy:
        light = join_small(folded, heavy, "anchor", "left_anti", n_heavy)
        single = join_small(folded, heavy, "anchor", "left_semi", n_heavy).select("key", "piece", "rank", "start")
        single = materialise(single.mapInArrow(_windows(u), "of binary, place long, key binary, piece binary, rank long, start long"), "windows")
        spread = single.groupBy("key", "piece").agg(F.min(F.struct("rank", "start")).alias("o")).select("key", "piece", "o.rank", "o.start")
        answers = search(spread, "key").select("key", "rank", "start")
        back = single.select("of", "place", "key").join(answers, "key")
        back = back.select(F.col("of").alias("key"), F.col("place").alias("from_"), (F.col("place") + 1).alias("to"), "rank", "start")
        found = search(light, "anchor").unionByName(back)
    else:
        found = search(folded, "anchor")
    found = materialise(found, "found").select("key", F.struct("from_", "to", F.col("rank").alias("r"), F.col("start").alias("s")).alias("run"))
    # As many runs as a piece has windows.
    runs = materialise(found.groupBy("key").agg(F.collect_list("run").alias("runs")), "runs")
    hits = pieces.select(UID, "rank", "start", "key").join(runs, "key").select(UID, "rank", "start", F.explode("runs").alias("run"))
    earlier = F.col("run.r") < F.col("rank")
    if u.within:
        earlier = earlier | ((F.col("run.r") == F.col("rank")) & (F.col("run.s") < F.col("start") + F.col("run.from_")))
    hits = hits.filter(earlier).groupBy(UID).agg(F.collect_list(F.struct((F.col("start") + F.col("run.from_")).alias("a"), (F.col("start") + F.col("run.to")).alias("b"))).alias("runs"))
    hits = materialise(hits, "hits")
    discard(pieces)
    discard(runs)
    hit_texts = join_small(d, hits.select(UID), UID, "left_semi").select(UID, "text").join(hits, UID).select(UID, "text", "runs")
    results = materialise(hit_texts.mapInArrow(_removal(u), "of long, removed long, spans array<struct<start:long,end:long>>, left binary"), "removal")
    # Copies take nothing from the first row's result, so their keys are spread instead of meeting.
    placed = placed.withColumn("of", F.when(F.col("copy"), -1 - F.col(UID)).otherwise(F.col("first")))
    out = placed.join(results, "of", "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    every = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    return out.select(
        UID, "doc_id", "n", F.when(F.col("copy"), F.col("n")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), every).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"),
        F.when(F.col("copy"), nothing).otherwise(F.lower(F.hex(F.coalesce("left", "sha")))).alias("kept_sha256"),
    )
