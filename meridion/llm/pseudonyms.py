"""Format-preserving pseudonyms (operator 3): personal numbers and dates are permuted within their format.

A value is found by its pattern and kept only if it is valid (check digits, calendar, ranges).  Valid
values of a format are numbered 0..N-1, and a keyed Feistel network with cycle walking permutes the
numbers.  It is conjugated with a step by one, so no value stays what it is; equal values, however
they are punctuated, get equal pseudonyms in every document, and the key's holder can go back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.llm.common import UID, fields, small_batches, table, work_folder
from meridion.llm.numtext import utf8

ROUNDS = 10
#: Session setting with the key in hex.  Where it is unset, a key is drawn once for each shared folder and kept there.
KEY_SETTING = "spark.meridion.pseudonyms.key"
LEAST_KEY = 16
_FIRST, _LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of 0..n-1: alternating halves of an a x b grid over it, walked back into range."""

    def __init__(self, key: bytes, n: int, label: str):
        self.n, self.a = n, isqrt(n - 1) + 1 if n > 1 else 1
        self.b = -(-n // self.a)
        self.size = 8 + (self.a.bit_length() + 7) // 8
        seed = hashlib.blake2b(f"{label}|{n}".encode(), key=key[:64], digest_size=32).digest()
        self.keys = [hashlib.blake2b(bytes([r]), key=seed, digest_size=32).digest() for r in range(ROUNDS)]

    def _round(self, r: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes(self.size, "little"), key=self.keys[r], digest_size=min(64, self.size)).digest(), "little")

    def _walk(self, x: int, back: bool) -> int:
        while True:
            left, right = x // self.b, x % self.b
            for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if r % 2:
                    step = self._round(r, left)
                    right = (right - step if back else right + step) % self.b
                else:
                    step = self._round(r, right)
                    left = (left - step if back else left + step) % self.a
            x = left * self.b + right
            if x < self.n:
                return x

    def encrypt(self, x: int) -> int:
        return self._walk(x, False)

    def decrypt(self, x: int) -> int:
        return self._walk(x, True)

    def move(self, x: int, step: int = 1) -> int:
        """The pseudonym of x (step 1), or the value of a pseudonym (step -1); never x itself for n > 1."""
        return self.encrypt((self.decrypt(x) + step) % self.n)


@lru_cache(maxsize=4096)
def _network(key: bytes, n: int, label: str) -> Feistel:
    return Feistel(key, n, label)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _refill(shape: str, digits: str, skip: int = 0) -> str:
    """`digits` in the places of the digits of `shape` after the first `skip`."""
    it, seen, out = iter(digits), 0, []
    for c in shape:
        if "0" <= c <= "9":
            seen += 1
            out.append(c if seen <= skip else next(it))
        else:
            out.append(c)
    return "".join(out)


def luhn(payload: str) -> str:
    """The check digit that follows `payload`."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (1 if i % 2 else 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _move_digits(key: bytes, label: str, digits: str, step: int) -> str:
    n = len(digits)
    return str(_network(key, 10**n, f"{label}{n}").move(int(digits), step)).zfill(n) if n else ""


def _card(key: bytes, m: re.Match, step: int) -> str | None:
    d = _digits(m[0])
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    # Numbers of one repeated digit aren't cards, so they aren't pseudonyms either: walk past them.
    p = d[:-1]
    while True:
        p = _move_digits(key, "card", p, step)
        out = p + luhn(p)
        if len(set(out)) > 1:
            return _refill(m[0], out)


def _phone(key: bytes, m: re.Match, step: int) -> str | None:
    d = _digits(m[0])
    fixed = len(_digits(m["country"] or ""))
    if not 8 <= len(d) <= 15:
        return None
    return _refill(m[0], _move_digits(key, "phone", d[fixed:], step), fixed)


def _ssn(key: bytes, m: re.Match, step: int) -> str | None:
    area, group, serial = (int(x) for x in m[0].split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    place = area - 1 - (area > 666)
    x = _network(key, 898 * 99 * 9999, "ssn").move((place * 99 + group - 1) * 9999 + serial - 1, step)
    place, group, serial = x // 9999 // 99, x // 9999 % 99 + 1, x % 9999 + 1
    return f"{place + 1 + (place >= 665):03}-{group:02}-{serial:04}"


def _address(key: bytes, m: re.Match, step: int) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = _network(key, 1 << 32, "ip").move(int.from_bytes(bytes(map(int, parts)), "big"), step)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _iban(key: bytes, m: re.Match, step: int) -> str | None:
    plain = m[0].replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    account = _shaped(key, "iban" + plain[:2], plain[4:], step)
    check = 98 - number(account + plain[:2] + "00") % 97
    out = iter(f"{plain[:2]}{check:02}{account}")
    return "".join(c if c == " " else next(out) for c in m[0])


def _shaped(key: bytes, label: str, text: str, step: int) -> str:
    """Letters stay letters of the same case and digits digits; other characters stay where they are."""
    radix = [10 if "0" <= c <= "9" else 26 if c.isascii() and c.isalpha() else 0 for c in text]
    n = 1
    x = 0
    for c, r in zip(text, radix):
        if r:
            x, n = x * r + (int(c) if r == 10 else ord(c.lower()) - 97), n * r
    if n == 1:
        return text
    x = _network(key, n, label + "".join("d" if r == 10 else "a" for r in radix if r)).move(x, step)
    out = []
    for c, r in zip(reversed(text), reversed(radix)):
        if r:
            x, k = divmod(x, r)
            c = str(k) if r == 10 else chr(97 + k) if c.islower() else chr(65 + k)
        out.append(c)
    return "".join(reversed(out))


def _email(key: bytes, m: re.Match, step: int) -> str | None:
    return f"{_shaped(key, 'email', m['local'], step)}@{m['domain']}"


def _secret(key: bytes, m: re.Match, step: int) -> str | None:
    value = m["value"]
    x = _network(key, 16 ** len(value), "hex").move(int(value, 16), step)
    out = f"{x:0{len(value)}x}"
    return m[0][: m.start("value") - m.start()] + (out.upper() if value.isupper() else out) + m[0][m.end("value") - m.start() :]


def _date(key: bytes, m: re.Match, step: int) -> str | None:
    order = {"-": "ymd", "/": "mdy", ".": "dmy"}[m["mark"]]
    parts = [int(x) for x in re.split(r"[-/.]", m[0])]
    when = dict(zip(order, parts))
    if order == "mdy" and when["m"] > 12:
        order, when = "dmy", {"d": when["m"], "m": when["d"], "y": when["y"]}
    try:
        day = datetime.date(when["y"], when["m"], when["d"]).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    network = _network(key, _LAST - _FIRST + 1, "date")
    while True:
        day = _FIRST + network.move(day - _FIRST, step)
        d = datetime.date.fromordinal(day)
        # Written month first, or day first: the pseudonym must be read the same way as its value.
        if m["mark"] != "/" or (order == "mdy") or d.day > 12:
            break
    values = {"y": f"{d.year:04}", "m": f"{d.month:02}", "d": f"{d.day:02}"}
    return m["mark"].join(values[c] for c in order)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    change: Callable[[bytes, re.Match, int], str | None]


_BEFORE, _AFTER = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: In order of precedence where matches begin at the same place.
KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+-])(?P<local>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63})@(?P<domain>(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})(?![A-Za-z0-9-])", _email),
    Kind("secret", r"(?i:token|secret|passwd|password|api[_-]?key|key)\s{0,3}[=:]\s{0,3}[\"']?(?P<value>[0-9a-f]{16,128}|[0-9A-F]{16,128})(?![0-9A-Za-z])", _secret),
    Kind("iban", _BEFORE + r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?" + _AFTER, _iban),
    Kind("phone", r"(?<![0-9A-Za-z+])(?P<country>\+[0-9]{1,3})[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}" + _AFTER, _phone),
    Kind("card", _BEFORE + r"(?<![0-9][.,])[0-9]{4}(?:[ -]?[0-9]){9,15}" + _AFTER, _card),
    Kind("ssn", _BEFORE + r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-)" + _AFTER, _ssn),
    Kind("ip", _BEFORE + r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9])" + _AFTER, _address),
    Kind("date", _BEFORE + r"(?<![0-9][-/.])(?:[0-9]{4}(?P<mark>-)[0-9]{2}-[0-9]{2}|[0-9]{2}(?P<mark2>[/.])[0-9]{2}(?P=mark2)[0-9]{4})(?:(?=T[0-9]{2}(?![0-9A-Za-z]))|(?![-/.]?[0-9A-Za-z]))", _date),
    Kind("phone", r"(?<![0-9A-Za-z+])(?P<country>)(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}" + _AFTER, _phone),
)
_COMPILED = [(k.name, re.compile(k.pattern.replace("(?P<mark2>", "(?P<second>").replace("(?P=mark2)", "(?P=second)")), k.change) for k in KINDS]


class _Marked:
    """A date's match whose mark may come from either alternative."""

    def __init__(self, m: re.Match):
        self.m = m

    def __getitem__(self, key):
        return (self.m["mark"] or self.m["second"]) if key == "mark" else self.m[key]


#: Where a rejected match may end earlier, or a later try may start: at the borders of its groups.
_BORDER = re.compile(r"(?<=[0-9A-Za-z])(?![0-9A-Za-z])")
_START = re.compile(r"(?<![0-9A-Za-z])(?=[0-9A-Za-z+(])")
_RETRIED = {"iban", "card", "phone"}


def _tries(name: str, pattern: re.Pattern, change: Callable, text: str, key: bytes, step: int) -> Iterator[tuple[re.Match, str]]:
    """Valid matches: of one start the longest; a rejected match gives way to shorter ends, then to later starts within it.

    The way back must reject the same tries, so a pseudonym that makes one of them valid is walked past.
    """
    at, rejected = 0, []
    while m := pattern.search(text, at):
        whole = m
        new = change(key, _Marked(m) if name == "date" else m, step)
        if new is None and name in _RETRIED:
            rejected.append(m.span())
            for e in reversed([b.end() for b in _BORDER.finditer(text, m.start() + 1, m.end()) if b.end() < m.end()]):
                shorter = pattern.fullmatch(text, m.start(), e)
                if shorter and (new := change(key, shorter, step)) is not None:
                    m = shorter
                    break
                rejected += [shorter.span()] if shorter else []
        if new is not None:
            a, e = m.span()
            while near := [r for r in rejected if r[1] > a]:
                moved = text[:a] + new + text[e:]
                if all(not (x := pattern.fullmatch(moved, *r)) or change(key, x, step) is None for r in near):
                    break
                new = change(key, pattern.fullmatch(moved, a, e), step)
            yield m, new
            at, rejected = e, []
        elif name in _RETRIED and (later := _START.search(text, whole.start() + 1)) and later.start() < whole.end():
            at = later.start()
        else:
            at, rejected = whole.end(), []


def pseudonymise(text: str, key: bytes, step: int = 1) -> tuple[str, list[tuple[str, int, int]]]:
    """(text with pseudonyms, their (kind, start, end) in it); step -1 goes back from pseudonyms to values."""
    found = []
    for rank, (name, pattern, change) in enumerate(_COMPILED):
        for m, new in _tries(name, pattern, change, text, key, step):
            found.append((m.start(), rank, m.end(), name, new))
    out, spans, at, shift = [], [], 0, 0
    for a, _, e, name, new in sorted(found):
        if a < at:
            continue
        out += [text[at:a], new]
        spans.append((name, a + shift, a + shift + len(new)))
        shift += len(new) - (e - a)
        at = e
    return "".join([*out, text[at:]]), spans


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _apply(key: bytes, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1)
            data, offsets = utf8(text)
            # A mail address may do without digits; every other kind has some.
            marks = np.concatenate([[0], np.cumsum((data == 64) | ((data >= 48) & (data <= 57)))])
            hit = np.flatnonzero(marks[offsets[1:]] > marks[offsets[:-1]])
            spans: list[list] = [[]] * b.num_rows
            if len(hit):
                values = text.to_pylist()
                for i in hit.tolist():
                    values[i], s = pseudonymise(values[i], key, step)
                    spans[i] = [{"kind": k, "start": a, "end": e} for k, a, e in s]
                text = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), text.cast(pa.string()), pa.array([len(s) for s in spans], pa.int64()), pa.array(spans, _SPANS)], names=["doc_id", "text", "n_replaced", "spans"])

    return run


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's setting; without one, the secret key of the shared folder, readable by its owner alone.

    All runs on a cluster link equal values then, and no key can be read from this code.
    """
    if given := spark.conf.get(KEY_SETTING, None):
        key = bytes.fromhex(given)
        if len(key) < LEAST_KEY:
            raise ValueError(f"{KEY_SETTING} must have {LEAST_KEY} bytes or more")
        return key
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{work_folder(spark)}/meridion-key/pseudonyms")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        # Written beside and renamed: of two drivers that draw a key at once, one loses and reads the other's.
        own = path.suffix(f"-{secrets.token_hex(8)}")
        out = fs.create(own)
        out.writeBytes(secrets.token_hex(32))
        out.close()
        fs.setPermission(own, jvm.org.apache.hadoop.fs.permission.FsPermission("600"))
        if fs.exists(path) or not fs.rename(own, path):
            fs.delete(own, False)
    stream = fs.open(path)
    key = stream.readLine()
    stream.close()
    return bytes.fromhex(key)


def replace(docs: DataFrame, key: bytes, step: int = 1) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced, spans (kind, start, end, in characters of the new text).

    Values that fail validation (a card's check digit, a day that doesn't exist) are left alone, as is
    every other character.  A null text stays null; repeated rows and null ids are treated row by row;
    an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    d = fields(docs, doc_id="long", text="string").drop(UID)
    return d.mapInArrow(_apply(key, step), "doc_id long, text string, n_replaced long, spans array<struct<kind:string,start:long,end:long>>")


def pseudonym_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents"), session_key(spark))
