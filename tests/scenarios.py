"""Seeded bar series: a level that drifts and jumps, and a session around each of its values."""

import datetime
import random

SCHEMA = "symbol string, session_date date, open double, high double, low double, close double, volume double"


def business_days(n, start=datetime.date(2021, 1, 4)):
    out, d = [], start
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += datetime.timedelta(days=1)
    return out


def series(symbol, n, seed, scale=1.0, start=datetime.date(2021, 1, 4)):
    """Four prices of a session are drawn around a level: the first is the open, the last the close."""
    r = random.Random(seed * 7919 + 13)
    level, rows = 40.0 + seed % 5, []
    for day in business_days(n, start):
        level *= 1 + r.uniform(-0.012, 0.0125) + (r.choice((-0.05, 0.05)) if r.random() < 0.02 else 0)
        prints = [level * (1 + r.uniform(-0.008, 0.008)) for _ in range(4)]
        rows.append((symbol, day, *(float(x * scale) for x in (prints[0], max(prints), min(prints), prints[-1])), float(r.randrange(20_000, 400_000))))
    return rows
