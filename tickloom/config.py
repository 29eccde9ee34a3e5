"""Settings of sessions, analysis modes, gates and costs."""

from __future__ import annotations

from dataclasses import dataclass

#: Round-trip cost of a trade in per cent. Fixed value.
COST_PCT = 0.13
#: Bars that a symbol needs to be replayed. Fixed value.
REPLAY_BARS = 40
#: Intervals that bars can have, and days that a period name looks back. Fixed values.
INTERVALS = {"1m": "1 minute", "3m": "3 minutes", "5m": "5 minutes", "10m": "10 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour", "1d": "1 day"}
PERIOD_DAYS = {"1d": 1, "5d": 5, "1mo": 30, "3mo": 90, "6mo": 180, "1y": 365, "2y": 730}
OTHER_PERIOD_DAYS = 180

#: The market's time zone. Fixed value.
MARKET_ZONE = "Asia/Kolkata"


def interval_of(name: str) -> str:
    """The length of a named interval; an unknown name is an error."""
    if name not in INTERVALS:
        raise ValueError(f"unknown interval {name!r}; known: {', '.join(INTERVALS)}")
    return INTERVALS[name]


#: Categories of alerts by how they resolve, and statuses by class. Fixed values.
INTRADAY_CATEGORIES = ("scan", "manual_intraday")
SWING_CATEGORIES = ("swing_auto", "manual_swing", "channel_tip", "channel_call")
#: Sections of the day report, and the categories of each. Fixed values.
SECTIONS = {"scan": ("scan",), "manual_intraday": ("manual_intraday",), "swing": SWING_CATEGORIES}
PASS = ("t2_hit", "t1_then_squareoff", "t1_then_breakeven")
FAIL = ("sl_hit",)


# The defaults of the three classes below are fixed values.


@dataclass(frozen=True)
class Session:
    """Minutes of the day between which the market is open and entries are allowed; minutes after which a trade is timed out."""

    opens: int = 9 * 60 + 15
    closes: int = 15 * 60 + 30
    entry_from: int = 9 * 60 + 30
    entry_until: int = 14 * 60 + 30
    lunch_from: int = 12 * 60
    lunch_until: int = 13 * 60 + 30
    time_stop_minutes: int = 45


@dataclass(frozen=True)
class Mode:
    """Windows of the vote, of the trade plan, and what a change is measured from."""

    sma_short: int
    sma_long: int
    rsi: int
    macd: tuple[int, int, int]
    bollinger: int
    recent: int
    atr_multiple: float
    from_open: bool


SWING = Mode(20, 50, 14, (12, 26, 9), 20, 20, 1.5, False)
INTRADAY = Mode(9, 21, 9, (5, 13, 6), 20, 30, 1.0, True)


@dataclass(frozen=True)
class Gates:
    atr_low: float = 0.004
    atr_high: float = 0.015
    volume_ratio: float = 1.5
    vwap_slope: float = 0.02
    round_distance: float = 0.003
    min_score: int = 90
    per_pass: int = 5
    per_day: int = 8
    swing_confidence: float = 90.0
    swing_per_user: int = 5


GATES = Gates()
