"""Substring dedup (operator 5): suffix automata of reference shards, matching statistics, maximal spans.

The reference is the corpus itself: the passages that may repeat, cut out and folded by `repeats`.  A
task holds the automaton of one shard of it and streams that shard's passages.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.llm.common import UID, table
from meridion.llm.repeats import Units, remove_repeats

WINDOW = 50
WORDS = Units("words", WINDOW, 16, False, 1 << 19)


class SuffixAutomaton:
    """Of a set of sequences; a state knows the smallest rank of the sequences its strings occur in."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.rank = [-1], [0], [1 << 63]

    def _state(self, length: int, link: int, nxt: dict) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.rank.append(1 << 63)
        return len(self.length) - 1

    def _copy(self, p: int, symbol, q: int) -> int:
        """A state for the shorter strings of q, reached from p by symbol."""
        c = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = c
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = c
            p = self.link[p]
        return c

    def add(self, sequence: Iterable, rank: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for symbol in sequence:
            q = nxt[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._copy(last, symbol, q)
            else:
                new = self._state(length[last] + 1, 0, {})
                p = last
                while p >= 0 and symbol not in nxt[p]:
                    nxt[p][symbol] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][symbol]
                    link[new] = q if length[q] == length[p] + 1 else self._copy(p, symbol, q)
                last = new
            if rank < self.rank[last]:
                self.rank[last] = rank

    def close(self, window: int) -> None:
        """Hand ranks down to the states of shorter strings, and find for each state the one that holds
        its suffix of `window` symbols."""
        order = np.argsort(np.array(self.length), kind="stable").tolist()
        for v in reversed(order[1:]):
            if self.rank[v] < self.rank[self.link[v]]:
                self.rank[self.link[v]] = self.rank[v]
        self.top = list(range(len(order)))
        for v in order[1:]:
            if self.length[self.link[v]] >= window:
                self.top[v] = self.top[self.link[v]]

    def statistics(self, sequence: Iterable) -> Iterator[tuple[int, int]]:
        """After each symbol: the length of the longest suffix that the automaton knows, and its state."""
        v, n = 0, 0
        for symbol in sequence:
            while v and symbol not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if symbol in self.next[v]:
                v, n = self.next[v][symbol], n + 1
            yield n, v


def first_ranks(pieces: list[bytes], ranks: np.ndarray, starts: np.ndarray, window: int = WINDOW):
    """Rank of the first document of each window of each piece, by matching statistics."""
    number: dict[bytes, int] = {}
    sequences = [[number.setdefault(w, len(number)) for w in p.split(b" ")] for p in pieces]
    automaton = SuffixAutomaton()
    for s, r in zip(sequences, ranks.tolist()):
        automaton.add(s, r)
    automaton.close(window)
    rank, top = automaton.rank, automaton.top
    out, size = [], []
    for s in sequences:
        before = len(out)
        out.extend(rank[top[v]] for n, v in automaton.statistics(s) if n >= window)
        size.append(len(out) - before)
    return np.array(out, np.int64), np.zeros(len(out), np.int64), np.array(size, np.int64)


def deduplicate(docs: DataFrame) -> DataFrame:
    """Row uid, doc_id, n, n_removed, spans (start, end in words), kept_sha256 of every document.

    A word is removed if one of its windows of 50 words also starts in a document with a smaller doc_id
    (rows with the same id don't count against each other; a null id comes last).  Null text has no
    words; texts under 50 words stay as they are; an empty table gives no rows; other columns are ignored.
    """
    return remove_repeats(docs, WORDS, first_ranks)


def substring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).select("doc_id", F.col("n").alias("n_words"), "n_removed", "kept_sha256")


__all__ = ["SuffixAutomaton", "UID", "deduplicate", "first_ranks", "substring_query"]
