"""WARC archives and their index (operator 6): sorted capture runs, k-way loser-tree merge by URL key and time."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.llm.common import UID, fields, join_small, materialise, small_batches, stable, table, work_folder

#: Payloads shorter than this are always stored.
LEAST_REVISIT = 1000
#: Records in an archive file, of payloads under LARGE bytes and of others: bound the size of a file that a task reads.
RECORDS_PER_FILE, LARGE, LARGE_PER_FILE = 2000, 1 << 18, 8
#: Index rows of a range that a task merges, and rows of a run that it decodes at a time.
RANGE_ROWS, CURSOR_ROWS = 100_000, 512
#: Captures carry no time of their own: this instant plus a second for each page_id.
FIRST_CAPTURE = 1_704_067_200
EOL = "\r\n"


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, the winner leaves at the top."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, k = runs, key, max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.k, self.tree = k, [-1] * k
        for i in range(k):
            self._play(i)

    def _next(self, i: int):
        x = next(self.runs[i], None)
        return None if x is None else (self.key(x), i, x)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _play(self, i: int) -> None:
        winner, node = i, (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while True:
            i = self.tree[0]
            head = self.heads[i]
            if head is None:
                return
            yield head[2]
            self.heads[i] = self._next(i)
            winner, node = i, (i + self.k) // 2
            while node > 0:
                if self._beats(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2
            self.tree[0] = winner


def url_key(url: str | None) -> str:
    """Sort-friendly form: host labels reversed, then path and query; no scheme, default port or fragment."""
    if not url:
        return ""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url)
    host, port, rest = m[1].lower(), m[2], m[3]
    port = f":{port}" if port and port not in ("80", "443") else ""
    return f"{','.join(reversed(host.split('.')))}{port}){rest or '/'}"


def _record_id(uid: Column) -> Column:
    h = F.md5(F.concat(F.lit("record "), uid.cast("string")).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(first_uid: Column, revisit: Column, refers_to: Column) -> Column:
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL)), F.lit(""))
    clean = F.regexp_replace(F.col("url"), r"[\r\n]+", "%0A")
    at = F.date_format(F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.octet_length("html").cast("string"), F.lit(EOL + EOL))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    return F.concat(
        F.lit(f"WARC/1.1{EOL}"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _record_id(F.col(UID))), line("WARC-Date", at), line("WARC-Target-URI", clean), line("Page-ID", F.col("page_id")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("html").cast("binary")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, _record_id(first_uid))), line("Refers-To-Page-ID", F.when(revisit, refers_to)),
        F.lit(f"Content-Type: application/http; msgtype=response{EOL}"), line("Content-Length", F.octet_length(block)), F.lit(EOL), block,
    )


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Gzipped archives of a bounded number of records; equal payloads (by SHA-256) are stored once.

    The terminator of a record is the line separator of Spark's text sink, so any file system Spark
    knows can hold the archives.
    """
    p = fields(stable(pages), page_id="long", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    rank = F.coalesce("page_id", F.lit(-(1 << 63)))
    d = materialise(p.filter(F.octet_length("html") >= least).select(UID, "page_id", rank.alias("rank"), F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("sha"), F.octet_length("html").alias("size")), "payloads")
    g = materialise(d.groupBy("sha", "size").agg(F.max("rank").alias("top"), F.count("*").alias("n")).filter("n > 1").drop("n"), "equal")
    members = materialise(join_small(d, g, ["sha", "size"], "inner"), "members")
    first = members.filter("rank = top").groupBy("sha", "size").agg(F.min(UID).alias("first"), F.first("page_id").alias("refers"))
    again = materialise(join_small(members, first, ["sha", "size"], "inner").filter(f"{UID} <> first").select(UID, "first", "refers"), "revisits")
    r = join_small(p, again, UID, "left")
    record = _record(F.col("first"), F.col("first").isNotNull(), F.col("refers"))
    large = F.octet_length("html") >= LARGE
    for name, kind, records in (("small", ~large, RECORDS_PER_FILE), ("large", large, LARGE_PER_FILE)):
        r.filter(kind).select(record.alias("value")).write.option("lineSep", EOL + EOL).option("compression", "gzip").option("maxRecordsPerFile", records).text(f"{path}/{name}")


def read_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the unpacked archive, header, block) of each record of a gzipped archive."""
    unpack = zlib.decompressobj(wbits=31)
    held, at, done = bytearray(), 0, 0

    def more() -> bool:
        nonlocal unpack, done
        while done < len(content):
            if unpack.eof:
                rest = unpack.unused_data
                unpack = zlib.decompressobj(wbits=31)
                got = unpack.decompress(rest)
            else:
                got = unpack.decompress(content[done : done + (1 << 18)])
                done += 1 << 18
            if got:
                held.extend(got)
                return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a record is cut off")
                return
        lines = held[:end].decode().split(EOL)
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        header = dict(x.split(": ", 1) for x in lines[1:])
        size = end + 4 + int(header["Content-Length"])
        while len(held) < size + 4:
            if not more():
                raise ValueError("a record is cut off")
        if held[size : size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is longer than it says")
        yield at, header, bytes(held[end + 4 : size])
        del held[: size + 4]
        at += size + 4


INDEX = pa.schema([("url_key", pa.string()), ("captured_at", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64())])
INDEX_DDL = "url_key string, captured_at string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def _order(r: dict) -> tuple:
    return r["url_key"], r["captured_at"], r["page_id"] is None, r["page_id"] or 0, r["archive"], r["offset"]


def _index_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            name, rows = path.as_py().rsplit("/", 1)[-1], []
            for at, header, block in read_records(content.as_py()):
                head, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
                if header["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{name}: the payload at {at} doesn't match its digest")
                page, refers = header.get("Page-ID"), header.get("Refers-To-Page-ID")
                rows.append(dict(zip(INDEX.names, (url_key(header.get("WARC-Target-URI")), header["WARC-Date"], page and int(page), size, digest, header["WARC-Type"], refers and int(refers), name, at))))
            rows.sort(key=_order)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=INDEX)


def _cursor(batches: list[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(0, b.num_rows, CURSOR_ROWS):
            yield from b.slice(i, CURSOR_ROWS).to_pylist()


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a range by a loser tree over its runs.

    Runs stay in Arrow buffers and are decoded a few rows at a time.  Rows of one archive that were fetched out of turn
    make a run more: a run ends where the order does.
    """
    runs: list[list[pa.RecordBatch]] = []
    end: dict[str, tuple[int, tuple]] = {}
    for b in batches:
        if not b.num_rows:
            continue
        archive, keys, at = b.column(INDEX.get_field_index("archive")).to_pylist(), [_order(r) for r in _cursor([b])], 0
        for i in range(1, b.num_rows + 1):
            if i == b.num_rows or archive[i] != archive[at] or keys[i] < keys[i - 1]:
                run, last = end.get(archive[at], (-1, ()))
                if run < 0 or keys[at] < last:
                    run = len(runs)
                    runs.append([])
                runs[run].append(b.slice(at, i - at))
                end[archive[at]] = run, keys[i - 1]
                at = i
    out = []
    for r in LoserTree([_cursor(r) for r in runs], _order):
        out.append(r)
        if len(out) == 4096:
            yield pa.RecordBatch.from_pylist(out, schema=INDEX)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=INDEX)


def capture_history(spark: SparkSession, path: str) -> DataFrame:
    """The index of all records under `path` in order of (url_key, captured_at, page_id).

    Each archive gives a sorted run, written to the shared folder.  Runs are cut at the same sampled
    keys, and a task merges its range of all runs; the whole key decides, so a host or a URL with any
    part of the captures is cut as well.  There are as many ranges as bound the rows of each.  Partitions
    are in order, as are the rows within.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    runs = materialise(files.mapInArrow(_index_run, INDEX_DDL), "runs")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    return runs.repartitionByRange(ranges, "url_key", "captured_at", "page_id", "archive", "offset").mapInArrow(_merge, INDEX_DDL)


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written and read back.

    Null html is an empty payload, null url an empty key, null page_id the smallest in a group of equal
    payloads.  Of rows that repeat the largest id of a group the first one read is the response.  An
    empty table gives no rows; other columns are ignored.
    """
    path = f"{work_folder(spark)}/meridion/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    h = capture_history(spark, path)
    return h.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


ORACLE = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS top FROM p),
u AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#:]*)([^#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://([^/?#:]*)([^#]*)', 2) AS rest FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> top THEN top END AS refers_to,
  array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS captured_at
FROM u
"""
