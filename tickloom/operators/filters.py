"""Gates on a bar's features. A gate's column is NULL where it passes, else a stable code of why not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.config import GATES, Gates, Session

#: Prices below the first number of a pair round to multiples of the second. Fixed values.
ROUND_STEPS = ((100, 25), (500, 50), (1000, 100))
LARGEST_STEP = 500


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def time_code(ts: Column, s: Session = Session()) -> Column:
    m = minute_of_day(ts)
    return F.when(F.weekday(ts) >= 5, "weekend").when(m < s.entry_from, "before_entry").when((m >= s.lunch_from) & (m < s.lunch_until), "lunch").when(m >= s.entry_until, "after_entry")


def in_entry_window(ts: Column, s: Session = Session()) -> Column:
    return time_code(ts, s).isNull()


def market_open(ts: Column, s: Session = Session()) -> Column:
    m = minute_of_day(ts) * 60 + F.second(ts)
    return (F.weekday(ts) < 5) & (m >= s.opens * 60) & (m <= s.closes * 60)


def atr_code(low: Column, high: Column) -> Column:
    share = F.try_divide(F.col("atr14"), F.nullif("close", F.lit(0.0)))
    return F.when(share.isNull(), "atr_missing").when(share < low, "atr_low").when(share > high, "atr_high")


def volume_code(least: float) -> Column:
    return F.when(F.col("vol_ratio").isNull(), "volume_missing").when(F.col("vol_ratio") < least, "volume_low")


def slope_code(least: float) -> Column:
    return F.when(F.col("vwap_slope").isNull(), "slope_missing").when(F.abs("vwap_slope") < least, "slope_flat")


def round_step(price: Column) -> Column:
    step = None
    for below, size in ROUND_STEPS:
        step = F.when(price < below, size) if step is None else step.when(price < below, size)
    return step.otherwise(LARGEST_STEP).cast("double")


def round_code(price: Column, direction: Column, distance: float) -> Column:
    """Rejects a long just under, and a short just over, a round price."""
    step = round_step(price)
    near = F.array(*(((F.bround(price / step) + k) * step) for k in (-1, 0, 1)))
    away = lambda level: F.try_divide(level - price, price)
    long = F.exists(near, lambda x: (x > 0) & (away(x) > 0) & (away(x) < distance))
    short = F.exists(near, lambda x: (x > 0) & (away(x) < 0) & (away(x) > -distance))
    return F.when((direction == "long") & long, "round_number").when((direction == "short") & short, "round_number")


def reject_code(direction: Column, g: Gates = GATES, check_time: bool = False, low: Column | None = None, high: Column | None = None, session: Session = Session()) -> Column:
    """The first gate that rejects: time if asked, ATR band, volume, VWAP slope, round number. The ATR band may be columns."""
    codes = [atr_code(F.lit(g.atr_low) if low is None else low, F.lit(g.atr_high) if high is None else high), volume_code(g.volume_ratio), slope_code(g.vwap_slope), round_code(F.col("close"), direction, g.round_distance)]
    return F.coalesce(*([time_code(F.col("ts"), session)] if check_time else []), *codes)
