"""Language ID (operator 4): a bidirectional gated recurrent network over bytes, trained in numpy.

Each direction is a light gated unit: z = sigmoid(Ez[x] + h Uz), c = tanh(Ec[x] + h Uc),
h' = z h + (1 - z) c.  Both states label every byte; a document's probabilities are the mean of its
bytes' probabilities.  Texts are read whole, in stretches of STRETCH bytes (the last one is filled up with
zero bytes, which don't count) that start from a zero state, so a result doesn't depend on other rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meridion.llm.common import fields, plain, release, small_batches, table, whole_rows
from meridion.llm.numtext import utf8

HIDDEN = 16
STRETCH = 128
#: The bounded training sample: documents a language, fewer where languages times that were over SAMPLE_DOCS (but never
#: under LEAST_DOCS), and characters of each.  Every language that occurs is learned.
DOCS_PER_LANG, LEAST_DOCS, SAMPLE_DOCS = 400, 4, 100_000
SAMPLE_CHARS = 400
STEPS = 350
UNKNOWN = "und"
#: A stage that rejects unrecognised texts keeps a score of this, or of twice what chance gives where that is less.
LEAST_SCORE = 0.3
_LANES = 1024
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Network:
    """Parameters by name; `labels` are the languages in order."""

    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels, h, c = labels, HIDDEN, max(1, len(labels))
        self.p = {}
        for d in "fb":
            self.p[d + "E"] = r.normal(0, 0.3, (256, 2 * h)).astype(np.float32)
            self.p[d + "E"][:, :h] += 1.0
            self.p[d + "U"] = (r.normal(0, 1, (h, 2 * h)) / np.sqrt(h)).astype(np.float32)
        self.p["W"] = r.normal(0, 0.1, (2 * h, c)).astype(np.float32)
        self.p["B"] = np.zeros(c, np.float32)

    def _direction(self, d: str, x: np.ndarray) -> np.ndarray:
        """States (time, lane, hidden) after each byte of x (time, lane), in the order of time given."""
        h, (t, n) = HIDDEN, x.shape
        half = np.float32([0.5] * h + [1.0] * h)
        e, u = self.p[d + "E"] * half, self.p[d + "U"] * half
        out = np.empty((t, n, h), np.float32)
        state = np.zeros((n, h), np.float32)
        a, g = np.empty((n, 2 * h), np.float32), np.empty((n, 2 * h), np.float32)
        for i in range(t):
            np.take(e, x[i], axis=0, out=a, mode="clip")
            a += np.matmul(state, u, out=g)
            np.tanh(a, out=a)
            z, c = a[:, :h], a[:, h:]
            # z h + (1 - z) c with z = (1 + tanh) / 2
            nxt = out[i]
            np.subtract(state, c, out=nxt)
            z += 1
            z *= 0.5
            nxt *= z
            nxt += c
            state = nxt
        return out

    def position_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(label, time, lane) probabilities of every byte of x (time, lane)."""
        t, n = x.shape
        f, b = self._direction("f", x), self._direction("b", x[::-1])[::-1]
        w = self.p["W"].T
        logits = w[:, :HIDDEN] @ f.reshape(-1, HIDDEN).T
        logits = logits.reshape(-1, t, n)
        for i in range(t):
            logits[:, i] += w[:, HIDDEN:] @ b[i].T
        logits += self.p["B"][:, None, None]
        logits -= logits.max(0)
        np.exp(logits, out=logits)
        logits /= logits.sum(0)
        return logits

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of each document's bytes; zeros for an empty one."""
        size = np.diff(offsets)
        pieces = -(-size // STRETCH)
        doc = np.repeat(np.arange(len(size)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = offsets[:-1][doc] + nth * STRETCH
        length = np.minimum(STRETCH, offsets[1:][doc] - start)
        total = np.zeros((len(size), len(self.labels)))
        for i in range(0, len(doc), _LANES):
            at = slice(i, i + _LANES)
            index = start[at][None, :] + np.arange(STRETCH)[:, None]
            valid = np.arange(STRETCH)[:, None] < length[at][None, :]
            x = np.where(valid, _FOLD[data[np.minimum(index, len(data) - 1)]], 0)
            p = self.position_probabilities(x)
            if not valid.all():
                p *= valid
            np.add.at(total, doc[at], p.sum(1, dtype=np.float64).T)
        return total / np.maximum(size, 1)[:, None]

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all bytes of x (time, lane) with labels y (lane), and its gradients
        by backpropagation through time."""
        h, (t, n) = HIDDEN, x.shape
        state = {"f": self._direction("f", x), "b": self._direction("b", x[::-1])}
        both = np.concatenate([state["f"], state["b"][::-1]], -1)
        logits = both @ self.p["W"] + self.p["B"]
        logits -= logits.max(-1, keepdims=True)
        q = np.exp(logits)
        q /= q.sum(-1, keepdims=True)
        loss = float(-np.log(np.maximum(q[:, np.arange(n), y], 1e-9)).mean())
        q[:, np.arange(n), y] -= 1
        q /= t * n
        g = {"W": np.tensordot(both, q, ([0, 1], [0, 1])), "B": q.sum((0, 1))}
        back = q @ self.p["W"].T
        for d, part, xs in (("f", back[:, :, :h], x), ("b", back[::-1, :, h:], x[::-1])):
            e, u, s = self.p[d + "E"], self.p[d + "U"], state[d]
            da = np.empty((t, n, 2 * h), np.float32)
            prior = np.concatenate([np.zeros((1, n, h), np.float32), s[:-1]])
            a = e[xs] + prior @ u
            z = 1 / (1 + np.exp(-a[:, :, :h]))
            c = np.tanh(a[:, :, h:])
            carry = np.zeros((n, h), np.float32)
            for i in range(t - 1, -1, -1):
                dh = part[i] + carry
                da[i, :, :h] = dh * (prior[i] - c[i]) * z[i] * (1 - z[i])
                da[i, :, h:] = dh * (1 - z[i]) * (1 - c[i] ** 2)
                carry = dh * z[i] + da[i] @ u.T
            g[d + "U"] = np.tensordot(prior, da, ([0, 1], [0, 1]))
            ge = np.zeros_like(e)
            np.add.at(ge, xs.ravel(), da.reshape(-1, 2 * h))
            g[d + "E"] = ge
        return loss, g

    def fit(self, stretches: np.ndarray, y: np.ndarray, steps: int = STEPS, lanes: int = 128, length: int = 48, seed: int = 11) -> "Network":
        """Adam over random cuts of the sample's stretches (rows of bytes, 0 beyond the end)."""
        r = np.random.default_rng(seed)
        by_label = [np.flatnonzero(y == k) for k in range(len(self.labels))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        size = np.maximum(1, (stretches > 0).sum(1))
        for step in range(1, steps + 1):
            label = r.integers(0, len(by_label), lanes)
            row = np.array([r.choice(by_label[k]) for k in label])
            at = (r.random(lanes) * np.maximum(1, size[row] - length + 1)).astype(int)
            x = stretches[row[None, :], np.minimum(at[None, :] + np.arange(length)[:, None], stretches.shape[1] - 1)]
            _, g = self.loss_and_gradients(x, label)
            norm = np.sqrt(sum(float((a**2).sum()) for a in g.values()))
            rate = 0.02 * min(1.0, 2.0 * (1 - step / (steps + 1)))
            for k, a in g.items():
                a = a * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] += 0.1 * (a - m[k])
                v2[k] += 0.01 * (a * a - v2[k])
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text modulo 5 is 0; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Network:
    """Learns every language from at most `docs_per_lang` of its documents that are not held out, chosen by a
    hash of their id; from each one cut of SAMPLE_CHARS characters at a hashed place."""
    d = fields(docs, doc_id="string", lang="string", text="string").withColumnRenamed("doc_id", "id")
    d = d.filter(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    counts = d.groupBy("lang").agg(F.count("*").alias("n"))
    most = max(LEAST_DOCS, min(docs_per_lang, SAMPLE_DOCS // max(1, counts.count())))
    spread = F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(1 << 20))
    share = counts.select(F.col("lang").alias("l"), F.least(F.lit(1.0), F.lit(2.0 * most) / F.col("n")).alias("share"))
    s = d.join(F.broadcast(share), F.col("lang") == F.col("l")).filter(spread < F.col("share") * F.lit(1 << 20)).filter(has_letter(F.col("text")))
    at = F.pmod(F.xxhash64(F.col("id"), F.lit(2)), F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS).cast("long")) + 1
    s = s.select("lang", "id", spread.alias("o"), F.substring(F.col("text"), at.cast("int"), F.lit(SAMPLE_CHARS)).alias("cut"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "id", "cut"))
    rows = s.withColumn("r", rank).filter(F.col("r") <= most).select("lang", "cut").collect()
    rows = sorted((r.lang, r.cut) for r in rows)
    labels = sorted({r[0] for r in rows})
    net = Network(labels)
    if len(labels) < 2:
        return net
    width = 4 * SAMPLE_CHARS
    x = np.zeros((len(rows), width), np.uint8)
    for i, (_, cut) in enumerate(rows):
        raw = np.frombuffer(cut.encode("utf-8", "replace")[:width], np.uint8)
        x[i, : len(raw)] = _FOLD[raw]
    number = {k: i for i, k in enumerate(labels)}
    # With many languages a step sees more cuts, and there are more steps, so that each is seen as often as one of few.
    lanes = min(1024, max(128, len(labels)))
    return net.fit(x, np.array([number[r[0]] for r in rows]), STEPS * max(1, -(-32 * len(labels) // lanes) // 32), lanes)


def _labels(net: Network, keep_columns: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            letter = np.asarray(b.column(b.num_columns - 1).cast(pa.uint8())).astype(bool)
            p = np.zeros((b.num_rows, max(1, len(net.labels))))
            if len(net.labels) == 1:
                p[:, 0] = 1
            elif net.labels and b.num_rows:
                data, offsets = utf8(b.column(b.num_columns - 2))
                p = net.documents(data, offsets)
            best = p.argmax(1) if b.num_rows else np.empty(0, int)
            known = letter & bool(net.labels)
            lang = [net.labels[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), known.tolist())]
            score = np.where(known, np.clip(p[np.arange(b.num_rows), best] if b.num_rows else 0.0, 0, 1), 0.0)
            kept = b.columns[: b.num_columns - (1 if keep_columns else 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names[: len(kept)], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its whole text alone."""
    small_batches(docs.sparkSession)
    d = fields(docs, doc_id="long", text="string").select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text", has_letter(F.col("text")).alias("letter"))
    return d.mapInArrow(_labels(net, False), "doc_id long, held_out boolean, lang_pred string, score double")


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents.  Null text or text without a letter is `und` with score 0, as is everything when no
    row can be learned from; one known language is given to every text with a letter.  Rows with null or
    repeated ids are labelled one by one; an empty table gives no rows; other columns are ignored."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))


def least_score(languages: int) -> float:
    return min(LEAST_SCORE, 2.0 / max(1, languages))


def in_known_language(docs: DataFrame) -> DataFrame:
    """The rows whose text is in a language that the network recognises, in the columns of the input.

    Texts without a letter go, and texts whose best language has a mean probability under `least_score`: their bytes
    disagree, as those of no learned language do.  Where fewer than two languages can be learned there is nothing to
    tell apart, and every text with a letter stays.
    """
    small_batches(docs.sparkSession)
    net = train(docs)
    # The network decides on a copy of the text, so that any columns pass through unchanged.
    text, rows = F.col(f"c{docs.columns.index('text')}").cast("string"), plain(docs)
    if len(net.labels) < 2:
        return whole_rows(rows.filter(has_letter(text)), docs)
    d = rows.select("*", text.alias("text"), has_letter(text).alias("letter"))
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)] + ["text string", "lang_pred string", "score double"])
    return whole_rows(d.mapInArrow(_labels(net, True), schema).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score(len(net.labels)))), docs)
