import random

import numpy as np
import pytest

from meridion.llm import neardup


def sets_of(text):
    w = (text or "").encode().split()
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def brute(rows):
    big = float("inf")
    sets = [sets_of(t) for _, t in rows]
    rank = [big if i is None else i for i, _ in rows]
    kinds = sorted({s for s in sets if s}, key=lambda s: sorted(map(str, s)))
    links = {s: [o for o in kinds if o != s and len(s & o) >= 0.8 * len(s | o)] for s in kinds}
    label = {}
    for s in kinds:
        if s not in label:
            stack, seen = [s], {s}
            while stack:
                for o in links[stack.pop()]:
                    if o not in seen:
                        seen.add(o)
                        stack.append(o)
            members = [i for i, x in enumerate(sets) if x in seen]
            for o in seen:
                label[o] = (min(rank[i] for i in members), len(members))
    out = []
    for (i, _), s, r in zip(rows, sets, rank):
        c, size = label.get(s, (r, 1))
        same = [rank[k] for k, x in enumerate(sets) if x == s] if s else [r]
        out.append((i, None if c == big else c, size, len(links.get(s, [])), None if min(same) == big else min(same), len(same)))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randrange(2, 6)))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, " ".join(word() for _ in range(r.randrange(6, 80))) + (" " + passage if r.random() < 0.3 else "")) for i in range(80)]
    n = 100
    for base in range(12):
        words = [word() for _ in range(r.choice([30, 90, 200]))]
        for _ in range(r.choice([2, 3, 12])):
            w = list(words)
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = word()
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n + 1, rows[-1][1]), (n + 2, "  " + rows[-1][1].replace(" ", "\n")), (n + 3, None), (n + 4, ""), (n + 5, "a b"), (n + 6, "a b"), (n + 7, "b a"), (None, rows[85][1]), (None, "only null"), (85, rows[85][1]), (n + 8, "w " * 5000)]
    return rows


def test_recall_is_measured():
    assert neardup.recall_at(0.8, 6) == pytest.approx(1 - (1 - 0.8**6) ** neardup.TREES)
    r = np.random.default_rng(0)
    for p in (0.02, 0.1, 0.4):
        met = r.binomial(neardup.TREES, p, 200_000)
        assert neardup.share_of_trees(met[met > 0].mean()) == pytest.approx(p, rel=0.02)
    # Pairs that met in fewer trees than independent minima would give call for shorter prefixes.
    assert neardup.recall_at(0.8, 6, pairs=500, found=3.0, similarity=0.82) < neardup.recall_at(0.8, 6, pairs=500, found=10.0, similarity=0.82)
    assert neardup.recall_at(0.8, 6, pairs=neardup.MEASURED - 1, found=1.0, similarity=0.82) == neardup.recall_at(0.8, 6)


def test_prefixes_are_shortened_until_the_recall(spark, docs, monkeypatch):
    depths = []
    real = neardup._link
    monkeypatch.setattr(neardup, "_link", lambda depth: depths.append(depth) or real(depth))
    neardup.join(docs(corpus(1)[:40])).count()
    assert depths == [8, 7, 6]
    depths.clear()
    monkeypatch.setattr(neardup, "RECALL", 0.9)
    s = neardup.materialise(neardup.fields(docs(corpus(1)), doc_id="long", text="string").mapInArrow(neardup._signatures, "_row_uid long, doc_id long, n long, digest binary, labels array<long>").filter("n > 0"), "s")
    full = {tuple(x) for x in neardup.forest(s, recall=1.0).select("a", "b").collect()}
    assert depths == list(range(8, 0, -1)) and full
    depths.clear()
    neardup.forest(s, recall=0.9)
    assert depths == [8]


def test_long_texts_are_cut_into_stretches(monkeypatch):
    r = random.Random(9)
    text = " ".join("".join(r.choice("ab") for _ in range(r.randrange(1, 9))) for _ in range(3000)).encode()
    cases = [text, b"x" * 500 + b" " + text, b" a b  c " + b" " * 300, b"y" * 900]
    whole = []
    for t in cases:
        data = np.frombuffer(t, np.uint8)
        whole.append(neardup.shingles(data, np.array([0, len(data)]))[0])
    monkeypatch.setattr(neardup, "STRETCH", 100)
    for t, w in zip(cases, whole):
        data = np.frombuffer(t, np.uint8)
        got, first = neardup.shingles(data, np.array([0, len(data)]))
        assert np.array_equal(got, w) and first.tolist() == [0, len(w)]


def test_intersections():
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 5000, r.integers(0, 4000))) for _ in range(30)]
    got = neardup.intersections(np.concatenate(rows), np.cumsum([0, *map(len, rows)]))
    assert all(got[i, j] == len(np.intersect1d(rows[i], rows[j])) for i in range(30) for j in range(30) if i != j)


@pytest.mark.parametrize("seed,node,block,members", [(1, 4096, 1 << 21, 1024), (2, 4, 700, 1024), (3, 3, 1 << 21, 3)])
def test_against_brute_force(spark, docs, monkeypatch, seed, node, block, members):
    monkeypatch.setattr(neardup, "NODE_ROWS", node)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", members)
    rows = corpus(seed)
    got = neardup.join(docs(rows)).collect()
    want = brute(rows)
    assert sorted(((g.doc_id, g.class_id, g.class_size, g.n_links, g.set_id, g.set_size) for g in got), key=str) == want
    d = docs(rows)
    kept = neardup.representatives(d)
    assert kept.columns == d.columns
    classes = {}
    for w in want:
        classes.setdefault(("lone", w[0]) if w[2] == 1 else w[1], w[2])
    assert kept.count() == len({w[1] for w in want if w[2] > 1}) + sum(w[2] == 1 for w in want)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.id: x.root for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_empty(spark, docs):
    assert neardup.join(docs([])).collect() == []
