"""Suffix-array dedup (operator 9): a difference-cover suffix array over shards, adjacent prefixes compared.

The shards come from `repeats`: all occurrences of a window meet in one of them.  In a shard the suffixes
at positions 1 and 2 modulo 3 are sorted by their triples, named, and sorted by recursion on the names;
the others follow from those ranks and are merged in.  Only prefixes of 100 bytes matter, so recursion
ends as soon as a name stands for that many bytes; suffixes beyond that are tied.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.llm.common import table
from meridion.llm.repeats import Units, remove_repeats

WINDOW = 100
BYTES = Units("bytes", WINDOW, 32, True, 3 << 17)


def _names(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of rows, by the columns in turn."""
    key = columns[0].astype(np.int64)
    top = int(key.max(initial=0)) + 1
    for c in columns[1:]:
        size = int(c.max(initial=0)) + 1
        if top > (1 << 62) // size:
            key = np.unique(key, return_inverse=True)[1].reshape(-1)
            top = int(key.max(initial=0)) + 1
        key = key * size + c
        top *= size
    order = np.argsort(key)
    ordered = key[order]
    step = np.zeros(len(key), np.int64)
    np.cumsum(ordered[1:] != ordered[:-1], out=step[1:])
    out = np.empty(len(key), np.int64)
    out[order] = step
    return out, int(step[-1]) + 1 if len(key) else 0


def suffix_ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix; suffixes that agree in at least `depth` symbols may be tied, others never are."""
    n = len(symbols)
    if depth <= 1:
        return _names(symbols)[0]
    if n < 3:
        return _short(symbols)
    s = np.concatenate([symbols.astype(np.int64) + 1, np.zeros(3, np.int64)])
    first = np.arange(1, n + (n % 3 == 1), 3)
    sample = np.concatenate([first, np.arange(2, n, 3)])
    names, count = _names(s[sample], s[sample + 1], s[sample + 2])
    if count < len(sample) and depth > 3:
        names = suffix_ranks(names, -(-depth // 3))
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = names + 1
    other, one, two = np.arange(0, n, 3), first[first < n], np.arange(2, n, 3)
    # Both kinds of comparison with the suffixes at 0 modulo 3 are between pairs: a symbol or the rank of
    # two, and the rank of the sampled suffix that follows.
    top = int(rank.max()) + 1
    pair = lambda i: s[i] * top + rank[i + 1]
    size = int(symbols.max()) + 2
    follow = np.concatenate([s[other + 1] * top + rank[other + 2], s[two + 1] * top + rank[two + 2]])
    m = size * top
    if size * m >= 1 << 62:
        follow, m = _names(follow)
    # Merged place of a suffix: those before it of its own kind, and those of the other kinds.
    count = np.bincount(rank[np.concatenate([one, two])], minlength=top)
    sampled = np.cumsum(count) - count
    place = np.zeros(n, np.int64)
    place[one], place[two] = sampled[rank[one]], sampled[rank[two]]
    zeros = pair(other)
    order = np.argsort(zeros)
    zeros, other, follow_zero = zeros[order], other[order], follow[: len(other)][order]
    place[other] = np.searchsorted(zeros, zeros)
    _count_across(place, one, pair(one), other, zeros)
    _count_across(place, two, s[two] * m + follow[len(other) :], other, s[other] * m + follow_zero)
    return place


def _count_across(place: np.ndarray, a: np.ndarray, a_key: np.ndarray, b: np.ndarray, b_key: np.ndarray) -> None:
    """Adds to the places at a the number of smaller keys of b, and the other way round."""
    i, j = np.argsort(a_key), np.argsort(b_key)
    a_key, b_key = a_key[i], b_key[j]
    place[a[i]] += np.searchsorted(b_key, a_key)
    place[b[j]] += np.searchsorted(a_key, b_key)


def _short(symbols: np.ndarray) -> np.ndarray:
    suffixes = [tuple(symbols[i:].tolist()) for i in range(len(symbols))]
    order = sorted(range(len(symbols)), key=suffixes.__getitem__)
    out = np.empty(len(symbols), np.int64)
    out[order] = np.arange(len(symbols))
    return out


def first_places(pieces: list[bytes], ranks: np.ndarray, starts: np.ndarray, window: int = WINDOW):
    """(rank, start) of the first occurrence of each window of each piece, by neighbours in suffix order."""
    length = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(pieces), np.uint8)
    size = length - window + 1
    base = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(pieces)), size)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    at = base[owner] + place
    order = np.argsort(suffix_ranks(text, window)[at])
    by = at[order]
    # Neighbours are compared eight bytes at a time; windows never reach beyond their piece.
    eight = np.lib.stride_tricks.as_strided(np.concatenate([text, np.zeros(8, np.uint8)]).view(np.uint8), (len(text), 8), (1, 1))
    packed = np.ascontiguousarray(eight).view(np.uint64).reshape(-1)
    new = np.zeros(len(by), bool)
    new[:1] = True
    for j in sorted({*range(0, window - 7, 8), max(0, window - 8)}):
        x = packed[by + j]
        new[1:] |= x[1:] != x[:-1]
    head, group = np.flatnonzero(new), np.cumsum(new) - 1
    rank, start = ranks[owner][order], (starts[owner] + place)[order]
    least = np.minimum.reduceat(rank, head)[group] if len(head) else rank
    first = np.minimum.reduceat(np.where(rank == least, start, np.iinfo(np.int64).max), head) if len(head) else start
    out_rank, out_start = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
    out_rank[order], out_start[order] = least, first[group]
    return out_rank, out_start, size


def deduplicate(docs: DataFrame) -> DataFrame:
    """Row uid, doc_id, n, n_removed, spans (start, end in bytes), kept_sha256 of every document.

    A byte is removed if a string of 100 bytes over it also starts earlier: in a document with a smaller
    doc_id, or earlier in the same document (rows with the same id don't count against each other; a null
    id comes last).  Null text is empty; texts under 100 bytes stay; an empty table gives no rows; other
    columns are ignored.
    """
    return remove_repeats(docs, BYTES, first_places)


def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deduplicate(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.col("n").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
