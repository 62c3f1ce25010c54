import datetime
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meridion.llm import pseudonyms as p

KEY = b"k" * 32


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 365, 1000])
def test_permutation(n):
    f = p.Feistel(KEY, n, "t")
    moved = [f.move(x) for x in range(n)]
    assert sorted(moved) == list(range(n)) and all(f.move(y, -1) == x for x, y in enumerate(moved))
    assert n == 1 or all(x != y for x, y in enumerate(moved))
    assert all(f.decrypt(f.encrypt(x)) == x for x in range(n))


def change(text):
    out, spans = p.pseudonymise(text, KEY)
    back, _ = p.pseudonymise(out, KEY, -1)
    assert back == text
    return out, [s[0] for s in spans]


@pytest.mark.parametrize("text,kind,shape", [
    ("4111 1111 1111 1111", "card", r"\d{4} \d{4} \d{4} \d{4}"),
    ("4111111111111111", "card", r"\d{16}"),
    ("+1 (017) 555-7713", "phone", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
    ("(212) 555-0199", "phone", r"\(\d{3}\) \d{3}-\d{4}"),
    ("078-05-1120", "ssn", r"\d{3}-\d{2}-\d{4}"),
    ("152.143.123.131", "ip", r"\d+\.\d+\.\d+\.\d+"),
    ("2024-02-29", "date", r"\d{4}-\d{2}-\d{2}"),
    ("31/12/1999", "date", r"\d{2}/\d{2}/\d{4}"),
    ("12/31/1999", "date", r"\d{2}/\d{2}/\d{4}"),
    ("29.02.2024", "date", r"\d{2}\.\d{2}\.\d{4}"),
    ("Jo.55@mail4.example.com", "email", r"[A-Z][a-z]\.\d\d@mail4\.example\.com"),
    ("GB82 WEST 1234 5698 7654 32", "iban", r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d"),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "secret", r'token = "[0-9a-f]{40}"'),
])
def test_kinds(text, kind, shape):
    out, kinds = change(f"xé {text}### {text}.")
    assert kinds == [kind, kind]
    m = re.fullmatch(rf"xé ({shape})### ({shape})\.", out)
    assert m and m[1] == m[2] != text
    again, spans = p.pseudonymise(out, KEY)
    assert [s[0] for s in spans] == kinds  # a pseudonym is valid in its turn
    assert p.pseudonymise(f"xé {text}### {text}.", b"z" * 32)[0] != out


@pytest.mark.parametrize("text", ["9807915762804491", "0000000000000000", "2023-02-29", "13/32/2020", "256.1.1.1", "000-12-3456", "1.2.3", "version 10.2", "GB00 WEST 1234 5698 7654 32", "a@b", "12345", "1234567.4111111111111111"])
def test_invalid_values_stay(text):
    assert p.pseudonymise(f"so {text} so", KEY) == (f"so {text} so", [])


def test_formats_of_one_value_stay_linked():
    a, b = p.pseudonymise("4111-1111-1111-1111 4111111111111111", KEY)[0].split()
    assert a.replace("-", "") == b and p.luhn(b[:-1]) == b[-1]
    iso, dotted = p.pseudonymise("2001-03-04 04.03.2001", KEY)[0].split()
    assert datetime.datetime.strptime(dotted, "%d.%m.%Y").date().isoformat() == iso


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789-/. +()@ab#", max_size=60))
def test_any_text_goes_back(text):
    out, spans = p.pseudonymise(text, KEY)
    assert all(0 <= a < e <= len(out) for _, a, e in spans)


def test_documents(spark, docs):
    rows = [(1, "call +1 (017) 555-7713 now"), (2, None), (3, ""), (None, "again +1 (017) 555-7713"), (4, "clean text"), (4, "clean text"), (5, "w " * 50_000 + "10.0.0.1")]
    got = p.replace(docs(rows), KEY).collect()
    assert len(got) == len(rows)
    phones = {re.search(r"\+1 \S+ \S+", g.text)[0] for g in got if g.text and "+1" in g.text}
    assert len(phones) == 1 and "+1 (017) 555-7713" not in phones
    by = {g.doc_id: g for g in got}
    assert by[2].text is None and by[4].text == "clean text" and by[5].n_replaced == 1 and by[5].spans[0].kind == "ip"
    assert p.replace(docs([]), KEY).collect() == []


@pytest.mark.parametrize("text,value,kind", [
    ("card 4111 1111 1111 1111 123", "4111 1111 1111 1111", "card"),
    ("4111111111111111 12", "4111111111111111", "card"),
    ("12345 4111 1111 1111 1111", "4111 1111 1111 1111", "card"),
    ("1234 4111 1111 1111 1111 99", "4111 1111 1111 1111", "card"),
    ("BE68 5390 0754 7034 EUR", "BE68 5390 0754 7034", "iban"),
    ("2024-03-05T10:00:00Z", "2024-03-05", "date"),
])
def test_values_that_run_on(text, value, kind):
    out, spans = p.pseudonymise(text, KEY)
    assert value not in out and kind in [s[0] for s in spans]
    a, b = text.split(value)
    assert out.startswith(a) and out.endswith(b)
    assert p.pseudonymise(out, KEY, -1)[0] == text


def test_values_that_run_on_go_back():
    for i in range(300):
        d = f"{4000_0000_0000_000 + i * 7919}"
        d += p.luhn(d)
        text = f"{1000 + i} {d[:4]} {d[4:8]} {d[8:12]} {d[12:]} {i:03}"
        out, _ = p.pseudonymise(text, KEY)
        assert out != text and p.pseudonymise(out, KEY, -1)[0] == text


def luhn_sum(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))


def valid(token):
    """What a token is, by definitions of its own: None if it is nothing that must be replaced."""
    import ipaddress

    digits = re.sub(r"[ -]", "", token)
    if re.fullmatch(r"\d{4}([ -]?\d){9,15}", token) and 13 <= len(digits) <= 19:
        return "card" if luhn_sum(digits) % 10 == 0 and len(set(digits)) > 1 else None
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", token):
        a, b, c = map(int, token.split("-"))
        return "ssn" if a not in (0, 666) and a < 900 and b and c else None
    if re.fullmatch(r"[\d.]+", token) and token.count(".") == 3:
        try:
            return "ip" if str(ipaddress.IPv4Address(token)) == token else None
        except ValueError:
            return None
    if re.fullmatch(r"\d{4}-\d\d-\d\d", token):
        try:
            return "date" if 1900 <= datetime.datetime.strptime(token, "%Y-%m-%d").year < 2100 else None
        except ValueError:
            return None
    if re.fullmatch(r"[A-Z]{2}\d\d[0-9A-Z]{11,30}", token):
        number = "".join(str(int(c, 36)) for c in token[4:] + token[:4])
        return "iban" if int(number) % 97 == 1 else None
    return None


def test_documents_against_brute_force(spark, docs):
    import random

    r = random.Random(12)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def token():
        kind = r.randrange(7)
        if kind == 0:
            d = digits(15)
            return r.choice([d + p.luhn(d), d + digits(1)])
        if kind == 1:
            return f"{r.choice(['000', '666', '123', '899', '900', digits(3)])}-{r.choice(['00', '12'])}-{r.choice(['0000', digits(4)])}"
        if kind == 2:
            return ".".join(str(r.choice([0, 7, 10, 255, 256, 300])) for _ in range(4))
        if kind == 3:
            return f"{r.choice(['1899', '1900', '2024', '2023', '2099', '2100'])}-{r.choice(['00', '02', '12', '13'])}-{r.choice(['01', '29', '30', '32'])}"
        if kind == 4:
            account = "".join(r.choice("0123456789ABCZ") for _ in range(18))
            check = 98 - int("".join(str(int(c, 36)) for c in account + "DE00")) % 97
            return f"DE{check:02}{account}" if r.random() < 0.6 else f"DE{digits(2)}{account}"
        return r.choice(["word", "x1", "12", "3.14", "a-b"])

    pool = [token() for _ in range(150)]
    rows = [(i, " ; ".join(r.choice(pool) for _ in range(r.randrange(0, 40)))) for i in range(120)]
    got = {g.doc_id: g for g in p.replace(docs(rows), KEY).collect()}
    new = {}
    for i, text in rows:
        tokens, out = text.split(" ; "), got[i].text.split(" ; ")
        assert len(tokens) == len(out) and got[i].n_replaced == sum(valid(t) is not None for t in tokens)
        for a, b in zip(tokens, out):
            kind = valid(a)
            assert (a == b) if kind is None else (a != b and valid(b) == kind and re.sub("[0-9]", "0", re.sub("[A-Z]", "A", a)) == re.sub("[0-9]", "0", re.sub("[A-Z]", "A", b)) or kind == "ip")
            assert new.setdefault(a, b) == b
    kinds = {valid(t) for t in new}
    assert {"card", "ssn", "ip", "date", "iban", None} <= kinds
    moved = [b for a, b in new.items() if valid(a)]
    assert len(moved) == len(set(moved))


def test_every_date_has_its_own_pseudonym():
    days = [datetime.date.fromordinal(o).isoformat() for o in range(p._FIRST, p._LAST + 1, 1)][::97]
    out = [p.pseudonymise(d, KEY)[0] for d in days]
    assert len(set(out)) == len(days) and all(a != b and valid(b) == "date" for a, b in zip(days, out))


def test_key(spark):
    first = p.session_key(spark)
    assert len(first) == 32 and p.session_key(spark) == first != bytes(range(32))
    spark.conf.set(p.KEY_SETTING, "ab" * 20)
    try:
        assert p.session_key(spark) == b"\xab" * 20
        spark.conf.set(p.KEY_SETTING, "ab")
        with pytest.raises(ValueError):
            p.session_key(spark)
    finally:
        spark.conf.unset(p.KEY_SETTING)
