from fractions import Fraction

import pytest

from meridion.llm import mixing


def water(sizes, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = [s for s in open_ if level * w[s] >= most * sizes[s]]
        if not full:
            return out | {s: level * w[s] for s in open_}
        for s in full:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def words(t):
    return len((t or "").encode().split())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets_and_budgets(spark, docs, seed):
    import random

    r = random.Random(seed)
    rows = [(i, " ".join("ab"[r.randrange(2)] * r.randrange(1, 4) for _ in range(r.randrange(0, 30))), "en", r.choice(["a", "b", "B", "é", None, "z"] + ["hot"] * 4)) for i in range(150)]
    rows += [(200, None, "en", "a"), (200, None, "en", "a"), (None, "x y", "en", "b"), (201, "", "en", "empty"), (3, "same id again", "en", "a")]
    got = mixing.mix(docs(rows)).collect()
    sizes = {}
    for x in rows:
        sizes[x[3]] = sizes.get(x[3], 0) + words(x[1])
    want = water(sizes)
    assert len(got) == len(rows)
    taken = {}
    for g in got:
        assert g.source_size == sizes[g.source] and g.target == pytest.approx(float(want[g.source]))
        assert 0 <= g.taken <= 2 * g["size"]
        taken[g.source] = taken.get(g.source, 0) + g.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.5
    again = mixing.mix(docs(rows, 1)).collect()
    tied = {i for i in (x[0] for x in rows) if [y[0] for y in rows].count(i) > 1}  # rows of one id have no order of their own
    plain = lambda got: sorted(tuple(g)[1:] for g in got if g.doc_id is not None and g.doc_id not in tied)
    assert plain(again) == plain(got) and len(plain(got)) > 140


def test_documents_of_the_mix(spark, docs):
    rows = [(i, f"a{i}\tb  c\nd e", "en", "s1" if i % 3 else "s2") for i in range(30)] + [(99, None, "en", "s1")]
    d = docs(rows)
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    got = {}
    for x in out.collect():
        assert x.n_chars == len(x.text) and all(x[c] == f"own {c}" for c in ("_size", "_epochs", "_part", "_take", "_row_uid", "c0"))
        got[x.source] = got.get(x.source, 0) + words(x.text)
    taken = {}
    for x in mixing.mix(d).collect():
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert got == {k: v for k, v in taken.items() if v}


def test_empty(spark, docs):
    assert mixing.mix(docs([])).collect() == []


def test_rows_of_a_shuffle(spark, docs):
    rows = [(i, f"a{i} b c", "en", "s") for i in range(20)]
    got = [x.text for x in mixing.mixed_documents(docs(rows, 5, written=False)).collect()]
    assert sum(map(words, got)) == 90 and set(got) <= {r[1] for r in rows} | {" ".join(r[1].split()[:k]) for r in rows for k in (1, 2)}
