import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from meridion.llm import packing
from meridion.llm.common import materialise


def words(t):
    return len((t or "").encode().split())


def test_stages(spark, docs):
    r = random.Random(9)
    lang = {"aa": ["kato", "miru", "tane", "soko", "pime"], "bb": ["strum", "blint", "grosp", "kremf", "thwax"]}
    text = lambda k, n: " ".join("".join(r.choice(lang[k]) for _ in range(2)) for _ in range(n))
    rows = [(i, text(k, r.randrange(20, 60)), k, r.choice(["hot", "hot", "b", "c"])) for i, k in enumerate(["aa", "bb"] * 40)]
    rows += [(100 + i, rows[i][1], rows[i][2], "b") for i in range(6)]  # exact copies
    near = [(200 + i, rows[10 + i][1] + " " + rows[10 + i][1].split()[0], rows[10 + i][2], "c") for i in range(4)]
    long = text("aa", 150).split()
    rows += near + [(300 + i, " ".join([*long[:i], "edit", *long[i + 1 :]]), "aa", "c") for i in range(5)]
    rows += [(400, None, "aa", "b"), (401, "12 34", "bb", "hot"), (402, "", None, None)]
    d = docs(rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, d, None), name)
        if name != "pack":
            assert out.columns == d.columns
        kept[name] = out.collect()
        d = out
    ids = {n: sorted(x.doc_id for x in k) for n, k in kept.items() if n != "pack"}
    assert ids["language_id"] == sorted(i for i, *_ in rows if i < 400)
    assert ids["exact_dedup"] == sorted(set(ids["language_id"]) - set(range(6)))
    assert not set(range(301, 305)) & set(ids["near_duplicates"]) and 300 in ids["near_duplicates"]
    assert set(range(20, 80)) <= set(ids["near_duplicates"])
    taken, size = {}, {}
    for x in kept["near_duplicates"]:
        size[x.source] = size.get(x.source, 0) + words(x.text)
    for x in kept["mix_sources"]:
        taken[x.source] = taken.get(x.source, 0) + words(x.text)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 2 and all(taken[s] <= 2 * size[s] for s in size)
    fill = {}
    for p in kept["pack"]:
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
    # The windows are full and without gaps, and the pieces are the mix's documents by brute force.
    assert all(sorted(w)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(w), sorted(w)[1:])) for w in fill.values())
    assert sorted(fill) == list(range(len(fill))) and all(sum(n for _, n in fill[k]) == 2048 for k in range(len(fill) - 1))
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted((x.doc_id, np.array(tokenizer.encode(x.text, add_special_tokens=False).ids + [packing.END_ID], "<u4").tobytes()) for x in kept["mix_sources"])
    assert sum(p.length for p in kept["pack"]) == sum(len(i) // 4 for _, i in want)
    for p in kept["pack"]:
        assert any(d == p.doc_id and len(i) == 4 * p.doc_tokens and zlib.crc32(i[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for d, i in want)
    covered = {}
    for p in kept["pack"]:
        covered[p.doc_id] = covered.get(p.doc_id, 0) + p.length
    tokens = {}
    for d, i in want:
        tokens[d] = tokens.get(d, 0) + len(i) // 4
    assert covered == tokens


def test_run_of_nothing(spark, docs, tmp_path):
    docs([]).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []


def test_stages_start_after_memory_was_given_back(spark, docs, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    operators = [("langid", "in_known_language"), ("exactdedup", "deduplicated"), ("neardup", "representatives"), ("mixing", "mixed_documents"), ("packing", "pack")]
    seen = []
    for module, name in operators:
        monkeypatch.setattr(getattr(corpus_pipeline, module), name, lambda d, **_: seen.append(full()) or d.withColumn("ids", d.doc_id))
    d = docs([(1, "some words")])
    for _, stage in corpus_pipeline.STAGES:
        before = full()
        stage(spark, d, None)
        assert seen.pop() > before
    assert not seen


def test_giving_back_drops_the_words_a_worker_learned():
    from meridion.llm import common

    packing.tokenizer_of(open(packing.default_tokenizer(), encoding="utf-8").read()).encode([b"some words"])
    assert list(common._trimmed(iter([]))) == [] and not packing._tokenizers
