import zlib

import numpy as np

from meridion.llm import langid

VOCABULARY = {"aa": ["kato", "miru", "tane", "soko"], "bb": ["strum", "blint", "grosp", "kremf"], "cc": ["éloi", "uéa", "oué", "iaé"]}


def sample(r, lang, n):
    return " ".join(VOCABULARY[lang][r.integers(4)] for _ in range(n))


def test_gradients():
    r = np.random.default_rng(1)
    net = langid.Network(["a", "b"])
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    x, y = r.integers(97, 100, (5, 3)).astype(np.uint8), np.array([0, 1, 1])
    _, g = net.loss_and_gradients(x, y)
    for k in net.p:
        for _ in range(3):
            at = tuple(r.integers(0, s) for s in net.p[k].shape)
            if k.endswith("E"):
                at = (int(x[0, 0]), at[1])
            was = net.p[k][at]
            net.p[k][at] = was + 1e-2
            up = net.loss_and_gradients(x, y)[0]
            net.p[k][at] = was - 1e-2
            down = net.loss_and_gradients(x, y)[0]
            net.p[k][at] = was
            assert abs((up - down) / 2e-2 - g[k][at]) < 2e-4


def test_documents_are_means_of_positions():
    net = langid.Network(["a", "b", "c"])
    texts = [b"", b"hello", b"x" * 300, b"abc" * 200]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    got = net.documents(data, offsets)
    assert (got[0] == 0).all()
    for t, p in zip(texts[1:], got[1:]):
        parts = [t[i : i + langid.STRETCH] for i in range(0, len(t), langid.STRETCH)]
        want = sum(net.position_probabilities(np.frombuffer(x.ljust(langid.STRETCH, b"\0"), np.uint8)[:, None])[:, : len(x)].sum((1, 2)) for x in parts) / len(t)
        assert np.allclose(p, want, atol=1e-4)


def test_held_out_accuracy_and_edges(spark, docs):
    r = np.random.default_rng(3)
    rows = [(i, sample(r, lang, int(r.integers(5, 60))), lang) for i, lang in enumerate(list(VOCABULARY) * 100)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", "cc"), (None, sample(r, "aa", 30), None), (1003, sample(r, "bb", 30_000), "bb"), (3, rows[3][1], "aa")]
    d = docs(rows)
    got = langid.predict(d, langid.train(d)).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "aa" and by[1003].lang_pred == "bb"
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got if g.doc_id is not None)
    held = [(by[i].lang_pred, lang) for i, _, lang in rows[:300] if by[i].held_out]
    assert len(held) > 30 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= g.score <= 1 for g in got)
    out = langid.in_known_language(d)
    assert out.columns == d.columns and out.count() == len(rows) - 3
    assert langid.predict(docs([]), langid.train(docs([]))).collect() == []
    assert {g.lang_pred for g in langid.predict(d, langid.Network([])).collect()} == {"und"}


def test_every_language_is_learned(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 2)
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 900)
    rows = [(i, f"text of {i}", f"l{i % 300:03}") for i in range(2400)]
    net = langid.train(docs(rows))
    assert net.labels == sorted({x[2] for x in rows})


def test_what_a_stage_keeps(spark, docs):
    r = np.random.default_rng(4)
    rows = [(i, sample(r, lang, 40), lang) for i, lang in enumerate(["aa", "bb"] * 60)] + [(500, None, "aa"), (501, "12 34", "bb")]
    assert langid.least_score(2) == langid.LEAST_SCORE and langid.least_score(100) == 0.02
    d = docs(rows)
    assert langid.in_known_language(d).count() == 120
    # Nothing to learn from, or one language alone: texts with letters stay.
    for lang in (None, "aa"):
        alone = docs([(i, t, lang) for i, t, _ in rows])
        assert langid.in_known_language(alone).count() == 120
