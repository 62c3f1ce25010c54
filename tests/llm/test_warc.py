import hashlib
import random
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st

from meridion.llm import warc
from meridion.llm.common import materialise


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50)), max_size=9))
def test_loser_tree(runs):
    got = list(warc.LoserTree([iter(sorted(r)) for r in runs], lambda x: x))
    assert got == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("HTTP://u@Blog.Example.com:80/a?b=1#c") == "com,example,blog)/a?b=1"
    assert warc.url_key("https://x.org:8080") == "org,x:8080)/" and warc.url_key(None) == ""


def pages(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, first string, refers int") if rows else spark.createDataFrame([], "page_id long, url string, html string, first string, refers int")
    return materialise(df.repartition(parts), "pages")


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 13)
    r = random.Random(2)
    big, odd = "ü" * 700, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" * 40
    html = [big, odd, "short", "x" * 999, "y" * 1000, None, "", "long " * 60_000]
    rows = [(i, r.choice([f"http://h{i % 3}.example.com/p{i % 5}", "http://hot.org/a\r\nb", None]), r.choice(html) if i % 2 else f"own {i} " * 300, "f", 1) for i in range(90)]
    rows += [(None, "http://n.org/", big, "f", 1), (200, "http://z.org", odd, "f", 1), (200, "http://z.org", odd, "f", 1)]
    path = f"{warc.work_folder(spark)}/meridion/archives-{uuid.uuid4().hex}"
    warc.write_archives(pages(spark, rows), path)
    got = warc.capture_history(spark, path).collect()
    assert len(got) == len(rows)
    order = [(g.url_key, g.captured_at) for g in got]
    assert order == sorted(order)
    top = {}
    for i, _, h, *_ in rows:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", -1))
    kinds = {}
    want = {}
    for i, _, h, *_ in rows:
        want.setdefault(i, set()).add(h or "")
    for g in got:
        h = next(h for h in want[g.page_id] if hashlib.sha1(h.encode()).hexdigest() == g.payload_digest)
        assert g.payload_bytes == len(h.encode())
        kinds.setdefault((h, g.page_id), []).append(g.record_type)
        assert g.refers_to == (top[h] if g.record_type == "revisit" else None)
    for (h, i), k in kinds.items():
        response = len(h.encode()) < 1000 or i == top[h]
        assert sorted(k) == (["response"] + (["response"] if len(h.encode()) < 1000 else ["revisit"]) * (len(k) - 1) if response else ["revisit"] * len(k))
    path += "-none"
    warc.write_archives(pages(spark, []), path)
    assert warc.capture_history(spark, path).count() == 0
