import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meridion.llm import numtext, repeats, substring, suffixarray

SHA = lambda b: hashlib.sha256(b).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 70))
def test_suffix_ranks(symbols, depth):
    got = suffixarray.suffix_ranks(np.array(symbols, np.uint8), depth)
    suffixes = [tuple(symbols[i:]) for i in range(len(symbols))]
    for i in range(len(symbols)):
        for j in range(len(symbols)):
            if suffixes[i][:depth] < suffixes[j][:depth]:
                assert got[i] < got[j]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=14), min_size=1, max_size=5), st.lists(st.integers(0, 2), max_size=14))
def test_automaton(sequences, other):
    a = substring.SuffixAutomaton()
    for r, s in enumerate(sequences):
        a.add(s, r)
    a.close(3)
    known = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i, len(s) + 1)}
    for e, (n, v) in enumerate(a.statistics(other), 1):
        assert n == max(k for k in range(e + 1) if tuple(other[e - k : e]) in known)
        if n >= 3:
            w = tuple(other[e - 3 : e])
            assert a.rank[a.top[v]] == min(r for r, s in enumerate(sequences) if any(tuple(s[i : i + 3]) == w for i in range(len(s))))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té", max_size=12), max_size=6))
def test_words(texts):
    import pyarrow as pa

    data, offsets = numtext.utf8(pa.array(texts, pa.string()))
    starts, ends, rows = numtext.words(data, offsets)
    got = [[bytes(data[s:e]) for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(rows, rows[1:])]
    assert got == [t.encode().split() for t in texts]
    h = numtext.word_hashes(data, starts, ends)
    flat = [w for t in got for w in t]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def brute(rows, unit, window, within):
    docs = [(float("inf") if i is None else i, (t or "").encode()) for i, t in rows]
    cut = [t if unit == "bytes" else t.split() for _, t in docs]
    first = {}
    for (i, _), u in zip(docs, cut):
        for s in range(len(u) - window + 1):
            w = u[s : s + window] if unit == "bytes" else tuple(u[s : s + window])
            first[w] = min(first.get(w, (float("inf"), float("inf"))), (i, s))
    out = []
    for (i, t), u, (raw, _) in zip(docs, cut, rows):
        gone = np.zeros(len(u), bool)
        for s in range(len(u) - window + 1):
            f = first[u[s : s + window] if unit == "bytes" else tuple(u[s : s + window])]
            if f[0] < i or (within and f[0] == i and f[1] < s):
                gone[s : s + window] = True
        kept = bytes(np.frombuffer(u, np.uint8)[~gone]) if unit == "bytes" else b" ".join(w for w, g in zip(u, gone) if not g)
        out.append((raw, len(u), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), SHA(kept)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages, line = [text(n) for n in (60, 90, 49, 50)], text(55)
    rows = []
    for i in range(70):
        parts = [text(r.randrange(0, 40)) for _ in range(3)]
        if r.random() < 0.6:
            parts.insert(1, r.choice(passages))
        if r.random() < 0.4:
            parts.insert(0, line)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    base = text(200).split()
    for i in range(100, 130):
        w = list(base)
        w[r.randrange(200)] = "edit"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[-1][1]) for i in range(5)] + [(3, rows[3][1]), (300, None), (301, ""), (None, line), (None, rows[0][1]), (302, "a " * 700), (303, "a" * 900), (304, text(30) + " x" * 3 + " " + line + line)]
    return rows


@pytest.mark.parametrize("seed,shard", [(1, 1 << 20), (2, 400)])
def test_words_against_brute_force(spark, docs, seed, shard):
    rows = corpus(seed)
    u = repeats.Units("words", 50, 16, False, shard)
    got = repeats.remove_repeats(docs(rows), u, substring.first_ranks).collect()
    assert sorted(((g.doc_id, g.n, g.n_removed, len(g.spans), g.kept_sha256) for g in got), key=str) == brute(rows, "words", 50, False)


@pytest.mark.parametrize("seed,shard", [(3, 1 << 20), (4, 900)])
def test_bytes_against_brute_force(spark, docs, seed, shard):
    rows = corpus(seed)
    u = repeats.Units("bytes", 100, 32, True, shard)
    got = repeats.remove_repeats(docs(rows), u, suffixarray.first_places).collect()
    assert sorted(((g.doc_id, g.n, g.n_removed, len(g.spans), g.kept_sha256) for g in got), key=str) == brute(rows, "bytes", 100, True)


def test_nothing_to_remove(spark, docs):
    assert substring.deduplicate(docs([])).collect() == []
    got = suffixarray.deduplicate(docs([(1, "abc"), (2, None)])).collect()
    assert sorted((g.doc_id, g.n, g.n_removed) for g in got) == [(1, 3, 0), (2, 0, 0)]


@pytest.mark.parametrize("unit", ["words", "bytes"])
def test_long_texts_are_cut_into_stretches(unit, monkeypatch):
    import pyarrow as pa

    r = random.Random(8)
    text = " ".join("".join(r.choice("abcdeé") for _ in range(r.randrange(1, 6))) for _ in range(900)) + "  " + "z" * 300
    u = repeats.Units("words", 50, 16, False, 1) if unit == "words" else repeats.Units("bytes", 100, 32, True, 1)
    column = pa.array([text, "short", None, text[:700]], pa.string())
    ids = pa.array(range(4), pa.int64())

    def run():
        (scan,) = repeats._scan(u)(iter([pa.RecordBatch.from_arrays([ids, ids, column], names=["a", "b", "c"])]))
        found = []
        for p in repeats._pieces(u)(iter([pa.RecordBatch.from_arrays([ids, ids, column, scan.column(4)], names=list("abcd"))])):
            found += p.select(["_row_uid", "start", "anchor", "piece", "left", "right"]).to_pylist()
        return scan, found

    def windows(found):
        out = []
        for f in found:
            units = f["piece"].split(b" ") if unit == "words" else f["piece"]
            out += [(f["_row_uid"], f["start"] + k, f["anchor"], tuple(units[k : k + u.window])) for k in range(len(units) - u.window + 1)]
        return sorted(out)

    whole, found = run()
    monkeypatch.setattr(repeats, "LONG", 400)
    monkeypatch.setattr(repeats, "STEP", 37)
    monkeypatch.setattr(repeats, "slabs", lambda offsets: numtext.slabs(offsets, 300))
    cut, again = run()
    assert whole.column(2) == cut.column(2) and whole.column(3) == cut.column(3)
    assert [set(x) for x in whole.column(4).to_pylist()] == [set(x) for x in cut.column(4).to_pylist()]
    assert windows(found) == windows(again) and len(again) > len(found)
    raw = text.encode()
    units = raw.split() if unit == "words" else raw
    assert [w[1] for w in windows(again) if not w[0]] == list(range(len(units) - u.window + 1))
    assert all(tuple(units[w[1] : w[1] + u.window]) == w[3] for w in windows(again) if not w[0])
