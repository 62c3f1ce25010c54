"""Mixture-controlled packing (operator 1): deficit round-robin over source queues.

Each source is a queue of its documents' tokens.  A round is a window's worth of credit, dealt to the deficit counters
of the queues that still hold tokens, in their target proportions; a queue sends packets of PACKET tokens while its
counter covers them, and what it couldn't send stays on the counter for the next round.  The packets of all rounds are
one stream, and windows are cut from it without gaps, so all of them but the last are full.

What a queue has been credited after a round is a piecewise linear function of the round (its pieces end where a queue
runs out), and what it has sent are the whole packets of that.  So each task computes the deficits that it inherits from
the windows and partitions before it, instead of receiving them: no task holds a queue, and a source may hold any part
of the rows.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridion.llm.common import fields, join_small, materialise, small_batches, stable, table, worker_cache

WINDOW = 2048
PACKET = 64
END_ID = 1
#: Target proportions of the query's sources by code point, null last, repeating.
WEIGHTS = (3, 1, 2)
#: Queues of their own go to the sources with a given weight and to so many of the largest others; smaller ones share
#: as many more, by hash.  LEAST is the credit of a queue without weight, as a part of a window.
QUEUES, LEAST = 2048, 1e-9
#: Cells of the table of what all queues have sent, computed at a time.
CELLS = 1 << 20
#: Distinct words, and parts of words, whose ids a worker remembers; bytes of a text that are cut into words at a time.
CACHED_WORDS = 600_000
STRETCH = 1 << 20
#: Marks that may follow the letters of a word; an apostrophe isn't among them.
_MARKS = b".,;:!?#%$&*|"
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


class _Index(dict):
    """Numbers for words in the order they are first met; 0 is kept for the end of a text."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word):
        self[word] = n = len(self) + 1
        self.new.append(word)
        return n


def stretches(text: bytes) -> Iterator[tuple[int, int]]:
    """Ranges of about STRETCH bytes that end at white space."""
    i = 0
    while i < len(text):
        end = _SPACE.search(text, i + STRETCH) if i + STRETCH < len(text) else None
        j = end.start() if end else len(text)
        yield i, j
        i = j


class WordTokenizer:
    """Ids of whole texts.  The vocabulary drops white space and case and never joins across white space
    or from letters to marks, so the ids of a text are those of its words in turn, and those of a plain
    word are the ids of its letters and of the marks after them.  A word is plain if its letters are ASCII, or if
    the tokenizer's own steps leave them one part and a mark after them another (lower-casing may leave a combining
    mark, which joins the marks).  Each distinct part is encoded once; runs of plain letters are encoded together
    and told apart by the tokens that end a word."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.parts: dict[bytes, bytes] = {b"": b""}
        self.clear()

    def clear(self):
        self.index = _Index()
        self.flat = np.array([END_ID], np.uint32)
        self.start, self.size = np.array([0], np.int32), np.array([1], np.int32)

    def _plain(self, base: bytes) -> bool:
        text = base.decode("utf-8", "replace")
        if not text.isalpha():
            return False
        parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text + "!"))
        return len(parts) == 2 and parts[1][1][1] - parts[1][1][0] == 1

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, four bytes an id."""
        if len(self.parts) > CACHED_WORDS:
            self.parts = {b"": b""}
        p, cut, letters, rest = self.parts, [], [], []
        for w in words:
            base = w.rstrip(_MARKS)
            if base.isalpha():  # bytes: ASCII letters only
                marks, base, plain = w[len(base) :], base.lower(), True
            elif base and not base.isascii() and self._plain(base):
                marks, plain = w[len(base) :], True
            else:
                base, marks, plain = w, b"", False
            cut.append((base, marks))
            if base not in p:
                p[base] = b""
                (letters if plain else rest).append(base)
            if marks not in p:
                p[marks] = b""
                rest.append(marks)
        for i in range(0, len(letters), 512):
            some = letters[i : i + 512]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist() if len(ids) else []
            if len(stops) != len(some):
                rest += some
                continue
            raw, a = ids.tobytes(), 0
            for w, b in zip(some, stops):
                p[w] = raw[a:b]
                a = b
        got = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        p.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest, got))
        return [p[base] + p[marks] if marks else p[base] for base, marks in cut]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text), the end id after each."""
        if len(self.index) > CACHED_WORDS:
            self.clear()
        at, count, held = [], [], 0
        for t in texts:
            for i, j in stretches(t):
                at.append(np.fromiter(map(self.index.__getitem__, t[i:j].split()), np.int32))
                held += len(at[-1])
            at.append(np.zeros(1, np.int32))
            held += 1
            count.append(held)
        if self.index.new:
            got = self._learn(self.index.new)
            size = np.array([len(g) for g in got], np.int32) // 4
            start = np.cumsum(size, dtype=np.int32) - size + len(self.flat)
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(got), "<u4")])
            self.start, self.size = np.concatenate([self.start, start.astype(np.int32)]), np.concatenate([self.size, size])
            self.index.new = []
        at = np.concatenate(at) if at else np.empty(0, np.int32)
        size = self.size[at]
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        place = np.repeat(self.start[at] - (after - size).astype(np.int32), size)
        place += np.arange(total, dtype=np.int32)
        ends = after[np.array(count, np.int64) - 1] if count else after
        return self.flat[place], np.diff(ends, prepend=0)


#: A worker's tokenizers; what one task learned serves the next.
_tokenizers: dict[str, WordTokenizer] = worker_cache({})


def tokenizer_of(spec: str) -> WordTokenizer:
    """Found by name in the worker's own module, so that it outlives the task that made it."""
    if spec not in _tokenizers:
        _tokenizers[spec] = WordTokenizer(spec)
    return _tokenizers[spec]


def _tokenise(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, seen = tokenizer_of(spec.value), {}
        for b in batches:
            pid, doc, source, text = (b.column(i) for i in range(4))
            ids, n = tokenizer.encode([t or b"" for t in text.cast(pa.binary()).to_pylist()])
            ends = np.cumsum(n)
            raw = ids.astype("<u4")
            before = []
            for s, k in zip(source.to_pylist(), n.tolist()):
                before.append(seen.get(s, 0))
                seen[s] = before[-1] + k
            narrow = raw.astype("<u2") if len(raw) and int(raw.max()) < 1 << 16 else raw
            blobs = [narrow[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([pid, doc, source, pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(blobs, pa.binary())], names=["pid", "doc_id", "source", "before", "n", "ids"])

    return run


class Schedule:
    """The rounds of all queues.  `totals` are their tokens, `weights` their shares of a window.

    Time is counted in rounds of a full set of queues: at time v a queue has been credited v times its credit, but no more
    than it holds.  The sum of that is linear between the times at which queues run out, which turns rounds into times.
    State is linear in the queues.  Only single operations of IEEE arithmetic are used, so machines agree.
    """

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = WINDOW, packet: int = PACKET):
        self.totals, self.window, self.packet = np.array(totals, np.int64), window, packet
        share = np.array(totals if weights is None else weights, float)
        self.credit = np.maximum(share / max(share.sum(), 1e-300), LEAST) * window
        self.ends = self.totals / self.credit
        order = np.argsort(self.ends, kind="stable")
        self.times = np.concatenate([[0.0], self.ends[order]])
        self.rates = np.concatenate([np.cumsum(self.credit[order][::-1])[::-1], [0.0]])
        self.credited = np.concatenate([[0.0], np.cumsum(np.diff(self.times) * self.rates[:-1])])
        self.rounds = -(-int(self.totals.sum()) // window) + 1

    def time(self, rounds: np.ndarray) -> np.ndarray:
        """When the credit of each round has been dealt."""
        given = rounds.astype(float) * self.window
        k = np.searchsorted(self.credited, given, side="right") - 1
        rate = self.rates[k]
        v = self.times[k] + (given - self.credited[k]) / np.where(rate > 0, rate, 1.0)
        v = np.minimum(v, self.times[np.minimum(k + 1, len(self.times) - 1)])
        return np.where(rounds >= self.rounds, self.times[-1], v)

    def sent(self, rounds: np.ndarray, queue: int | slice = slice(None)) -> np.ndarray:
        """Tokens that each queue (rows) has sent by the end of each round (columns)."""
        v, total = self.time(rounds)[None, :], self.totals[queue].reshape(-1, 1)
        packets = np.floor(v * self.credit[queue].reshape(-1, 1) / self.packet).astype(np.int64)
        return np.where(v >= self.ends[queue].reshape(-1, 1), total, np.minimum(packets * self.packet, total))

    def deficits(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of credit that each queue carries into the next round; 0 for a queue that has run out."""
        v = self.time(rounds)[None, :]
        return np.where(v >= self.ends[:, None], 0.0, np.maximum(0.0, v * self.credit[:, None] - self.sent(rounds)))

    def round_of(self, queue: int, token: np.ndarray) -> np.ndarray:
        """The round, from 1, that sends each token of the queue."""
        v = np.minimum((token // self.packet + 1) * (self.packet / self.credit[queue]), self.ends[queue])
        k = np.minimum(np.searchsorted(self.times, v, side="right") - 1, len(self.times) - 1)
        given = self.credited[k] + (v - self.times[k]) * self.rates[k]
        out = np.clip(np.ceil(given / self.window).astype(np.int64) - 2, 1, self.rounds)
        while (late := self.sent(out, queue)[0] <= token).any():
            out = out + late
        return out

    def places(self, queue: int, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens first..end-1 of a queue in the stream: (first token of each contiguous run, its place)."""
        packets = np.arange(first // self.packet, (end - 1) // self.packet + 1, dtype=np.int64)
        rounds = self.round_of(queue, packets * self.packet)
        new = np.flatnonzero(np.diff(rounds, prepend=-1))
        rounds, token = rounds[new], np.maximum(packets[new] * self.packet, first)
        place = np.empty(len(rounds), np.int64)
        for i in range(0, len(rounds), step := max(1, CELLS // len(self.totals))):
            r = rounds[i : i + step]
            before, after = self.sent(r - 1), self.sent(r)
            place[i : i + step] = before.sum(0) + (after[:queue] - before[:queue]).sum(0) - before[queue]
        place += token
        joined = np.zeros(len(token), bool)
        joined[1:] = place[1:] - place[:-1] == token[1:] - token[:-1]
        return token[~joined], place[~joined]

    def pieces(self, queue: int, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cuts the tokens bounds[0]..bounds[-1] of a queue at windows and at the inner bounds:
        (start, end, window, offset) of each piece."""
        token, place = self.places(queue, int(bounds[0]), int(bounds[-1]))
        end = np.append(token[1:], bounds[-1])
        low, high = place // self.window + 1, (place + end - token - 1) // self.window
        n = np.maximum(0, high - low + 1)
        run = np.repeat(np.arange(len(token)), n)
        edge = low[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        cuts = np.unique(np.concatenate([token, token[run] + edge * self.window - place[run], bounds]))
        start, stop = cuts[:-1], cuts[1:]
        run = np.searchsorted(token, start, side="right") - 1
        at = place[run] + start - token[run]
        return start, stop, at // self.window, at % self.window


OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("source", pa.string()), ("ids", pa.binary())])
OUT_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary"


def _place(schedule: Schedule, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            doc, n, at, queue = b.column(0), *(np.asarray(b.column(i)) for i in (2, 4, 5))
            order = np.lexsort((at, queue))
            blobs = b.column(3)
            cuts = np.flatnonzero(np.diff(queue[order], prepend=-1) | (np.diff(at[order], prepend=-1) != np.concatenate([[0], n[order][:-1]])))
            rows, crc, ids = [], [], []
            for r in (order[i:j] for i, j in zip(cuts, [*cuts[1:], len(order)])):
                start, end, window, offset = schedule.pieces(int(queue[r[0]]), np.append(at[r], at[r[-1]] + n[r[-1]]))
                of = r[np.searchsorted(at[r], start, side="right") - 1]
                rows.append(np.stack([of, start - at[of], end - start, window, offset]))
                held = -1
                for o, a, e in zip(of.tolist(), (start - at[of]).tolist(), (end - at[of]).tolist()):
                    if o != held:
                        blob = blobs[o].as_py()
                        raw, held = memoryview(np.frombuffer(blob, "<u2" if len(blob) == 2 * n[o] else "<u4").astype("<u4").tobytes()), o
                    crc.append(zlib.crc32(raw[4 * a : 4 * e]))
                    if with_ids:
                        ids.append(bytes(raw[4 * a : 4 * e]))
            of, start, length, window, offset = np.concatenate(rows, axis=1)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([
                doc.take(take), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[of]), pa.array(window), pa.array(offset),
                b.column(1).take(take), pa.array(ids, pa.binary()) if with_ids else pa.nulls(len(of), pa.binary()),
            ], schema=OUT)

    return run


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cycled(sources: DataFrame, weights: tuple) -> DataFrame:
    """(source, weight) of (source): the weights in turn, by code point, null last.  The window without a partition
    holds a row a source."""
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    nth = (F.row_number().over(by_name) - 1) % len(weights) + 1
    return sources.select("source", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth.cast("int")).alias("weight"))


def pack(docs: DataFrame, tokenizer_file: str | None = None, weights: dict | tuple | None = None, window: int = WINDOW, packet: int = PACKET, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source, ids.

    Every token of every document (its ids and the end id; just that for null or empty text) lies in one
    piece.  `weights` are the target proportions of a window: a dict by source (others: 0, they follow when the named
    ones end), or a tuple that is dealt to the sources by code point, null last; without it they are the corpus's own,
    so all queues end together.  Until a source runs out, each window holds its proportion to within a packet; the
    others keep theirs to the end.  Null is a source like any other; repeated rows and null ids are packed row by row;
    an empty table gives no rows; other columns are ignored.  All windows but the last are full.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_file or default_tokenizer(), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    d = fields(stable(docs), doc_id="long", source="string", text="string").select(F.spark_partition_id().alias("pid"), "doc_id", "source", "text")
    t = materialise(d.mapInArrow(_tokenise(spec), "pid int, doc_id long, source string, before long, n long, ids binary"), "tokens")
    by_task = materialise(t.groupBy("pid", "source").agg(F.sum("n").alias("n")), "tasks")
    sizes = by_task.groupBy("source").agg(F.sum("n").alias("n"))
    if isinstance(weights, tuple):
        sizes = sizes.join(cycled(sizes.select("source"), weights).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    elif weights is not None:
        given = spark.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)], "s string, weight double")
        sizes = sizes.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    else:
        sizes = sizes.withColumn("weight", F.col("n").cast("double"))
    sizes = materialise(sizes, "sources")
    named = F.col("weight").isNotNull() if isinstance(weights, dict) else F.lit(False)
    own = sizes.orderBy(named.desc(), F.desc("n"), F.col("source").isNull(), "source").limit(QUEUES + (len(weights) if isinstance(weights, dict) else 0)).collect()
    own.sort(key=lambda r: (r.source is None, r.source or ""))
    numbers = spark.createDataFrame([(r.source, i) for i, r in enumerate(own)], "o string, number long")
    shared = F.lit(len(own)) + F.pmod(F.xxhash64("source"), F.lit(QUEUES))
    queue = F.coalesce("number", shared)
    sizes = sizes.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("o")), "left").select("source", "n", "weight", queue.alias("queue"))
    got = {r.queue: r for r in sizes.groupBy("queue").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).collect()}
    most = max(got, default=-1) + 1
    schedule = Schedule([got[q].n if q in got else 0 for q in range(most)], [(got[q].weight or 0.0) if q in got else 0.0 for q in range(most)], window, packet)
    # Documents of a queue follow one another by task; sources that share a queue, one after another.
    along = Window.partitionBy("queue").orderBy(F.col("source").isNull(), "source", "pid").rowsBetween(Window.unboundedPreceding, -1)
    s = sizes.select(F.col("source").alias("s"), "queue")
    of = by_task.join(F.broadcast(s) if most < QUEUES else s, F.col("source").eqNullSafe(F.col("s")))
    base = materialise(of.select("pid", "source", "queue", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base")), "queues")
    a, q = t.alias("a"), base.alias("q")
    placed = join_small(a, q, (F.col("a.pid") == F.col("q.pid")) & F.col("a.source").eqNullSafe(F.col("q.source")), "inner")
    placed = placed.select("a.doc_id", "a.source", "a.n", "a.ids", (F.col("q.base") + F.col("a.before")).alias("at"), "q.queue")
    return placed.mapInArrow(_place(schedule, with_ids), OUT_DDL)


def pack_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the sources' target proportions are WEIGHTS by code point, null last."""
    return pack(table(spark, sf_dir, "documents"), weights=WEIGHTS, with_ids=False).drop("source", "ids")
