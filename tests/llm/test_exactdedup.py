import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from meridion.llm import exactdedup


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200))
def test_golomb_round_trip(values):
    v = np.sort(np.array(values, np.uint64))
    k, coded = exactdedup.golomb_encode(v)
    assert np.array_equal(exactdedup.golomb_decode(k, len(v), coded), v)


def test_groups(spark, docs):
    rows = [(i, f"text {i % 7}" if i % 2 else f"own {i}") for i in range(120)] + [(500, None), (501, ""), (None, "text 1"), (None, "lone"), (5, "text 5"), (5, "text 5"), (600, "z" * 200_000), (601, "z" * 200_000)]
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    got = exactdedup.groups(docs(rows)).collect()
    assert len(got) == len(rows)
    sha = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in v if i is not None), default=None), len(v)) for t, v in by.items()}
    kept = {}
    for g in got:
        assert (g.keep_id, g.group_size) == sha[g.text_sha256]
        kept.setdefault(g.text_sha256, []).extend([g.doc_id] * g.kept)
    assert all(len(v) == 1 and v[0] == sha[k][0] for k, v in kept.items())
    d = docs(rows)
    assert exactdedup.deduplicated(d).count() == len(by) and exactdedup.deduplicated(d).columns == d.columns
    assert exactdedup.groups(docs([])).collect() == []
