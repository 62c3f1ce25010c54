"""Settings of a cache of bars, from the environment or by hand."""

from __future__ import annotations

import datetime
import os
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    root: str
    history_anchor: datetime.date | None = None
    refetch_tail_days: int = 7
    session_grace_minutes: int = 15
    warmup_days: int = 0
    orphan_gap_days: int = 365
    compression: str = "zstd"
    calls_per_second: float = 3.0
    tasks: int = 3

    @classmethod
    def from_env(cls, **given) -> "Settings":
        """Environment first, then what is given.  An anchor that is no date counts as none."""
        e, out = os.environ, {"root": os.environ.get("CACHE_DAILY_ROOT", "")}
        for name, field in (("CACHE_REFETCH_TAIL_DAYS", "refetch_tail_days"), ("CACHE_SESSION_GRACE_MIN", "session_grace_minutes"), ("CACHE_WARMUP_DAYS", "warmup_days"), ("CACHE_ORPHAN_GAP_DAYS", "orphan_gap_days")):
            if e.get(name):
                out[field] = int(e[name])
        if e.get("PARQUET_COMPRESSION"):
            out["compression"] = e["PARQUET_COMPRESSION"]
        try:
            out["history_anchor"] = datetime.date.fromisoformat(e.get("CACHE_HISTORY_ANCHOR", "").strip()[:10])
        except ValueError:
            pass
        out |= given
        if not out["root"]:
            raise ValueError("a cache needs a root: CACHE_DAILY_ROOT or root=")
        return cls(**out)

    def with_updates(self, **given) -> "Settings":
        return replace(self, **given)


@dataclass(frozen=True)
class Series:
    """One instrument and the rules that apply to it."""

    name: str
    kind: str = "equity"
    exchange: str = "NSE"
    tradingsymbol: str = ""
    session_end: str = "15:30"

    @property
    def continuous(self) -> bool:
        return self.kind == "futures"

    @property
    def has_volume(self) -> bool:
        return self.kind != "index"

    @property
    def detect_splits(self) -> bool:
        return self.kind == "equity"

    @property
    def lag_sessions(self) -> int:
        """A series that ends after the exchange's close is known a session later."""
        return int(self.session_end > "15:30")


#: The series beside equities that a panel may join, and when the sessions of futures end.
INDICES = {
    "NIFTY50": "NIFTY 50", "NIFTYBANK": "NIFTY BANK", "NIFTY500": "NIFTY 500", "NIFTYMIDCAP150": "NIFTY MIDCAP 150", "NIFTYSMLCAP250": "NIFTY SMLCAP 250", "INDIAVIX": "INDIA VIX",
    "NIFTYAUTO": "NIFTY AUTO", "NIFTYFMCG": "NIFTY FMCG", "NIFTYIT": "NIFTY IT", "NIFTYMETAL": "NIFTY METAL", "NIFTYPHARMA": "NIFTY PHARMA", "NIFTYREALTY": "NIFTY REALTY", "NIFTYENERGY": "NIFTY ENERGY",
    "NIFTYPSUBANK": "NIFTY PSU BANK", "NIFTYFINSERVICE": "NIFTY FIN SERVICE", "NIFTYMEDIA": "NIFTY MEDIA", "NIFTYCONSUMPTION": "NIFTY CONSUMPTION", "NIFTYINFRA": "NIFTY INFRA",
}
FUTURES = {"USDINR": ("CDS", "17:00"), "CRUDEOIL": ("MCX", "23:30"), "GOLD": ("MCX", "23:30")}


def outside_series() -> list[Series]:
    return [Series(k, "index", "NSE", v) for k, v in INDICES.items()] + [Series(k, "futures", e, k, end) for k, (e, end) in FUTURES.items()]
