import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meridion.llm import packing

SPEC = open(packing.default_tokenizer(), encoding="utf-8").read()
WORDS = packing.WordTokenizer(SPEC)
PLAIN = Tokenizer.from_str(SPEC)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85 ́'sre<|endoftext|>")), max_size=60), min_size=1, max_size=4))
def test_word_by_word_ids_are_those_of_the_text(texts):
    got, n = WORDS.encode([t.encode() for t in texts])
    want = [ids(t) for t in texts]
    assert n.tolist() == [len(w) for w in want] and got.tolist() == [i for w in want for i in w]


_LETTERS = st.sampled_from(list("İıſKÅǅŉßΣςẞﬁǰéñяжךא한字กा٣Ⅷªʰ") + ["i̇", "é", "क्षि", "ẋ̣"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.one_of(_LETTERS, st.sampled_from([chr(m) for m in packing._MARKS] + list("ab' 1-")), st.characters(categories=["Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc"])), max_size=12).map("".join), min_size=1, max_size=6))
def test_ids_of_letters_next_to_marks(texts):
    got, n = WORDS.encode([t.encode() for t in texts])
    want = [ids(t) for t in texts]
    assert n.tolist() == [len(w) for w in want] and got.tolist() == [i for w in want for i in w]


def test_ids_where_lower_case_leaves_a_mark():
    texts = ["İ!!", "TATİ.", "TATİ, x", "ok İ.", "Ǆ! İİ?"]
    got, n = WORDS.encode([t.encode() for t in texts])
    assert got.tolist() == [i for t in texts for i in ids(t)]


def test_long_texts_are_cut_at_white_space(monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 7)
    text = "one twothree\tfour  " * 20 + "x" * 40 + " end"
    assert b"".join(text.encode()[i:j] for i, j in packing.stretches(text.encode())) == text.encode()
    got, _ = WORDS.encode([text.encode(), b""])
    assert got.tolist() == ids(text) + [1]


def fluid(totals, weights, window, rounds):
    """Credit of each queue after each round, exactly: a window's worth is shared by those that hold tokens."""
    got, out = [Fraction(0)] * len(totals), []
    for _ in range(rounds):
        left = Fraction(window)
        while left and (open_ := [q for q, n in enumerate(totals) if got[q] < n]):
            whole = sum(weights[q] for q in open_)
            step = min(left, min((totals[q] - got[q]) * whole / weights[q] for q in open_))
            for q in open_:
                got[q] += step * weights[q] / whole
            left -= step
        out.append(list(got))
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 900), min_size=1, max_size=6), st.booleans(), st.sampled_from([1, 8, 32]), st.integers(1, 5))
def test_schedule_is_a_round_robin_with_deficits(totals, weighted, packet, cells):
    weights = [Fraction(i + 1) for i in range(len(totals))] if weighted else [Fraction(max(n, 1)) for n in totals]
    s = packing.Schedule(totals, [float(w) for w in weights], 64, packet)
    rounds = np.arange(0, s.rounds + 1)
    sent = s.sent(rounds)
    assert (sent[:, 0] == 0).all() and (sent[:, -1] == totals).all() and (np.diff(sent) >= 0).all()
    for r, credit in enumerate(fluid(totals, weights, 64, s.rounds), 1):
        # What is credited and not sent is less than a packet, and nothing is sent on credit.
        assert all(-1e-6 <= float(c) - x < packet + 1e-6 for c, x in zip(credit, sent[:, r].tolist()))
    assert (s.deficits(rounds) <= packet + 1e-6).all()
    stream = [(q, t) for r in rounds[1:] for q in range(len(totals)) for t in range(sent[q, r - 1], sent[q, r])]
    where = {x: i for i, x in enumerate(stream)}
    packing.CELLS, before = cells, packing.CELLS
    try:
        for q, n in enumerate(totals):
            if not n:
                continue
            for first in (0, n // 2):
                bounds = np.unique([first, first + (n - first) // 3, n])
                start, end, window, offset = s.pieces(q, bounds)
                assert start[0] == first and end[-1] == n and (start[1:] == end[:-1]).all() and set(bounds[:-1].tolist()) <= set(start.tolist())
                for a, e, w, o in zip(*(x.tolist() for x in (start, end, window, offset))):
                    assert o + e - a <= 64 and [where[q, t] for t in range(a, e)] == list(range(64 * w + o, 64 * w + o + e - a))
    finally:
        packing.CELLS = before


def test_schedule_of_many_sources():
    s = packing.Schedule([5000 + i for i in range(3000)], [1 + i % 7 for i in range(3000)])
    start, end, window, offset = s.pieces(1234, np.array([100, 3000]))
    assert (end - start).sum() == 2900 and (offset + end - start <= 2048).all()


@pytest.mark.parametrize("weights, queues", [(None, 2048), ({"hot": 1, "a": 5, None: 1}, 2048), ((3, 1, 2), 2048), (None, 1), ({"b": 1}, 1)])
def test_pack(spark, docs, weights, queues, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", queues)
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["alpha", "Beta", "été", "12,3", "x" * 40]) for _ in range(r.randrange(0, 200))), "en", r.choice(["hot"] * 3 + ["a", "b", None])) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "no id", "en", "a"), (7, "again", "en", "b"), (7, "again", "en", "b"), (502, "word " * 9000, "en", "b")]
    got = packing.pack(docs(rows), weights=weights).collect()
    want = {}
    for x in rows:
        want.setdefault(x[0], []).append(ids(x[1]))
    windows = {}
    left = {}
    for g in got:
        part = np.frombuffer(g.ids, "<u4").tolist()
        assert len(part) == g.length > 0 and zlib.crc32(g.ids) == g.ids_crc32
        assert any(part == w[g.start : g.start + g.length] and len(w) == g.doc_tokens for w in want[g.doc_id])
        left.setdefault(g.doc_id, []).extend(part)
        windows.setdefault(g.sequence_id, []).append((g.offset, g.length))
    assert {k: sorted(v) for k, v in left.items()} == {k: sorted(i for w in v for i in w) for k, v in want.items()}
    assert sorted(windows) == list(range(len(windows)))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    total = sum(g.length for g in got)
    assert len(windows) == -(-total // packing.WINDOW)
    if queues == 2048 and not isinstance(weights, dict):
        shares, totals = {}, {}
        for g in got:
            shares.setdefault(g.sequence_id, {}).setdefault(g.source, 0)
            shares[g.sequence_id][g.source] += g.length
            totals[g.source] = totals.get(g.source, 0) + g.length
        names = ["a", "b", "hot", None]
        target = dict(zip(names, (totals[s] / total for s in names) if weights is None else (3 / 7, 1 / 7, 2 / 7, 1 / 7)))  # s0, the fourth, has two tokens
        # As long as all queues last, windows hold the targets; where one ends, the window it ends in is the last such.
        lasting = min(totals[s] / target[s] for s in names) // 2048 - 2
        assert lasting >= 2
        for k in range(1, int(lasting)):
            assert all(abs(shares[k].get(s, 0) - target[s] * 2048) <= 5 * packing.PACKET for s in names)
    assert packing.pack(docs([])).collect() == []


def test_other_operators_drop_the_words_a_worker_learned():
    from meridion.llm import langid, neardup

    for task in (neardup._signatures, neardup._sets, neardup._link(1), neardup._verify(0.8), langid._labels(langid.Network.__new__(langid.Network), False)):
        packing.tokenizer_of(SPEC).encode([b"some words"])
        assert list(task(iter([]))) == [] and not packing._tokenizers
    assert packing.tokenizer_of(SPEC).encode([b"some words"])[0].tolist() == ids("some words")
