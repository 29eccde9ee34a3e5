"""Supertrend of every bar: bands carried from bar to bar, in window functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.indicators import by_symbol, previous, sma, true_range


def _carried(band: str, upper: bool) -> Column:
    """The band of each bar of a run, from the run's bars up to it (an array column of close before and raw band)."""

    def step(was: Column, bar: Column) -> Column:
        left = bar["close"] > was if upper else bar["close"] < was
        kept = F.greatest(bar["band"], was) if upper else F.least(bar["band"], was)
        return F.when(left & bar["band"].isNotNull(), kept).otherwise(bar["band"])

    return F.aggregate(F.slice(band, F.lit(2), F.size(band)), F.get(band, F.lit(0))["band"], step)


def with_supertrend(bars: DataFrame, n: int = 10, k: float = 3.0) -> DataFrame:
    """Adds st_line and st_dir (1 up, -1 down). Direction starts at 1; it turns when a close leaves the previous bar's band.

    A bar's rule makes its upper band from the one before: what lies below the close
    before is carried on (the greater of both), anything else gives the bar's own raw band.
    A band never lies inside its raw one, so where the close before stayed inside the raw
    band of its bar, the rule is constant, and a new run begins there. Only inside runs,
    which last while closes stand outside bands of their own bars, is the rule folded, by
    an aggregate over the run's bars; ranges would have to grow by a factor a bar for a
    run to go on. Runs, bands and turns are windows over the same exchange by symbol.
    """
    middle = (F.col("high") + F.col("low")) / 2
    own = bars.columns
    out = bars.withColumn("__tr", true_range()).withColumn("__atr", sma("__tr", n)).withColumn("__was", previous("close"))
    out = out.withColumns({"__up": middle + k * F.col("__atr"), "__lo": middle - k * F.col("__atr")})
    for band, upper in (("__up", True), ("__lo", False)):
        before = previous(band)
        goes_on = F.coalesce((F.col("__was") > before) if upper else (F.col("__was") < before), F.lit(False))
        out = out.withColumn(f"{band}_new", (~goes_on).cast("int")).withColumn(f"{band}_run", F.sum(f"{band}_new").over(by_symbol().rowsBetween(W.unboundedPreceding, 0)))
        inside = W.partitionBy("symbol", f"{band}_run").orderBy("session", "ts").rowsBetween(W.unboundedPreceding, 0)
        out = out.withColumn(f"{band}_bars", F.collect_list(F.struct(F.col("__was").alias("close"), F.col(band).alias("band"))).over(inside))
        out = out.withColumn(f"{band}_at", _carried(f"{band}_bars", upper))
    turn = F.when(F.col("close") > previous("__up_at"), 1).when(F.col("close") < previous("__lo_at"), -1)
    way = F.coalesce(F.last("__turn", ignorenulls=True).over(by_symbol().rowsBetween(W.unboundedPreceding, 0)), F.lit(1))
    out = out.withColumn("__turn", turn).withColumn("st_dir", way)
    line = F.when(F.col("__was").isNotNull(), F.when(F.col("st_dir") == 1, F.col("__lo_at")).otherwise(F.col("__up_at")))
    return out.withColumn("st_line", line).select(*own, "st_line", "st_dir")
