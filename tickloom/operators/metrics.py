"""Performance of resolved trades: counts, profit, and risk, as columns for any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.config import COST_PCT, FAIL, PASS, SECTIONS


def net(gross: str = "pnl_pct", cost: float = COST_PCT) -> Column:
    return F.col(gross) - cost


def hold_days() -> Column:
    return F.datediff(F.to_date("exit_time"), F.to_date("generated_at"))


def score_bucket(setup: Column) -> Column:
    """The bucket of a setup named score<NN>."""
    s = F.regexp_extract(setup, "^score([0-9]+)$", 1).try_cast("int")
    return F.when(s >= 95, "95-100").when(s >= 90, "90-94").when(s >= 80, "80-89").when(s.isNotNull(), "<80")


def realized() -> list[Column]:
    """n, wins, losses, neutral, net, average, win rate over decided trades, and days held, of rows with pnl_pct, status, hold."""
    has = F.col("pnl_pct").isNotNull()
    n, wins, losses = F.count_if(has), F.count_if(has & F.col("status").isin(*PASS)), F.count_if(has & F.col("status").isin(*FAIL))
    total = F.coalesce(F.sum("pnl_pct"), F.lit(0.0)) - COST_PCT * n
    rate = F.coalesce(F.try_divide(wins, wins + losses) * 100, F.lit(0.0))
    return [n.alias("n"), wins.alias("wins"), losses.alias("losses"), (n - wins - losses).alias("neutral"), total.alias("net"), F.coalesce(F.try_divide(total, n), F.lit(0.0)).alias("avg_net"), rate.alias("win_rate"), F.avg(F.when(has, F.col("hold"))).alias("avg_hold")]


def risk(c: str = "net") -> list[Column]:
    """Mean, deviation, Sharpe and Sortino ratios, 95 % interval, t and edge of the returns in a column; NULL where undefined."""
    n, mean = F.count(c), F.avg(c)
    dev = F.coalesce(F.stddev_samp(c), F.lit(0.0))
    se = F.when(n >= 2, dev / F.sqrt(n.cast("double")))
    down = F.sqrt(F.avg(F.pow(F.least(F.col(c), F.lit(0.0)), F.lit(2.0))))
    ratio = lambda d: F.when(n >= 2, F.try_divide(mean, F.nullif(d, F.lit(0.0))))
    low, high = mean - 1.96 * se, mean + 1.96 * se
    return [n.alias("trades"), mean.alias("mean"), dev.alias("std"), ratio(dev).alias("sharpe"), ratio(down).alias("sortino"), low.alias("ci_low"), high.alias("ci_high"), F.try_divide(mean, F.nullif(se, F.lit(0.0))).alias("t_stat"), F.coalesce((low > 0) | (high < 0), F.lit(False)).alias("edge")]


def performance(resolved: DataFrame) -> DataFrame:
    """realized() overall, by category, by score bucket of scans and by channel of calls, in one aggregate over grouping sets."""
    rows = resolved.withColumns({"hold": hold_days(), "bucket": F.when(F.col("category") == "scan", score_bucket(F.col("setup"))), "channel": F.when(F.col("category") == "channel_call", F.coalesce("setup", F.lit("?")))})
    sets = rows.groupingSets([[], ["category"], ["category", "bucket"], ["category", "channel"]], "category", "bucket", "channel")
    level = F.when(F.grouping_id() == 7, "overall").when(F.grouping_id() == 3, "category").when(F.grouping_id() == 1, "bucket").otherwise("channel")
    out = sets.agg(level.alias("slice"), *realized())
    return out.where("slice in ('overall', 'category') or (slice = 'bucket' and bucket is not null) or (slice = 'channel' and channel is not null)")


def symbol_summary(trades: DataFrame) -> DataFrame:
    """Replay statistics of each symbol and, with a NULL symbol, of all."""
    p = F.col("pnl_pct")
    wins, losses, n = F.count_if(p > 0), F.count_if(p < 0), F.count(p)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return trades.rollup("symbol").agg(
        F.grouping("symbol").cast("int").alias("is_total"), n.alias("n"), wins.alias("wins"), losses.alias("losses"), F.count_if(p == 0).alias("break_even"), zero(F.try_divide(wins, n) * 100).alias("hit_rate"),
        zero(F.sum(p)).alias("gross_total"), zero(F.avg(p)).alias("gross_avg"), (zero(F.sum(p)) - COST_PCT * n).alias("net_total"), (zero(F.avg(p)) - COST_PCT).alias("net_avg"), zero(F.avg(F.when(p > 0, p))).alias("avg_win"), zero(F.avg(F.when(p < 0, p))).alias("avg_loss"))


def status_breakdown(trades: DataFrame, by: str = "symbol") -> DataFrame:
    w = W.partitionBy(by)
    out = trades.groupBy(by, "status").agg(F.count("*").alias("n"))
    return out.withColumn("pct", F.col("n") / F.sum("n").over(w) * 100)


def max_drawdown(trades: DataFrame, by: str = "symbol") -> DataFrame:
    """The deepest fall of summed net returns, in order of generated_at and alert_id, below their highest point, which is 0 at least."""
    w = W.partitionBy(by).orderBy("generated_at", "alert_id").rowsBetween(W.unboundedPreceding, 0)
    out = trades.where("pnl_pct is not null").withColumn("equity", F.sum(net()).over(w))
    out = out.withColumn("fall", F.greatest(F.lit(0.0), F.max("equity").over(w)) - F.col("equity"))
    return out.groupBy(by).agg(F.max("fall").alias("max_drawdown"))


def swing_record(resolved: DataFrame) -> DataFrame:
    """Each user's wins, losses, neutrals, win rate over all resolved, net and days held."""
    r = resolved.where("pnl_pct is not null").withColumn("hold", hold_days())
    wins, losses, n = F.count_if(F.col("status").isin(*PASS)), F.count_if(F.col("status").isin(*FAIL)), F.count("*")
    return r.groupBy("user_id").agg(wins.alias("wins"), losses.alias("losses"), (n - wins - losses).alias("neutral"), (F.try_divide(wins, n) * 100).alias("win_rate"), F.sum(net()).alias("net"), F.avg("hold").alias("avg_hold"))


def section(category: Column) -> Column:
    """The part of the day report that a category belongs to; NULL for any other."""
    out = F.lit(None).cast("string")
    for name, held in SECTIONS.items():
        out = F.when(category.isin(*held), name).otherwise(out)
    return out


def day_sections(alerts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """day_report by the three sections: scans, manual intraday alerts, and all swing categories together."""
    rows = alerts.withColumn("category", section(F.col("category"))).where("category is not null")
    return day_report(rows, outcomes).withColumnRenamed("category", "section")


def day_report(alerts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Totals of each day and category: alerts, passes, failures, neutrals, profit."""
    rows = alerts.join(outcomes, "alert_id", "left")
    ok, bad = F.col("status").isin(*PASS), F.col("status").isin(*FAIL)
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("trade_date", "category").agg(F.count("*").alias("total"), yes(ok).alias("passed"), yes(bad).alias("failed"), (F.count("*") - yes(ok) - yes(bad)).alias("neutral"), F.coalesce(F.sum("pnl_pct"), F.lit(0.0)).alias("pnl_sum"), F.avg("pnl_pct").alias("pnl_avg"))


def top_reasons(rows: DataFrame, by: list[str], reason: str, k: int = 5) -> DataFrame:
    """The k most frequent reasons of each group, with their share of all of its rows with a reason."""
    counts = rows.where(F.col(reason).isNotNull()).groupBy(*by, reason).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by)
    out = counts.withColumns({"share": F.col("n") / F.sum("n").over(w) * 100, "place": F.row_number().over(w.orderBy(F.desc("n"), reason))})
    return out.where(F.col("place") <= k)


def benchmark(bars: DataFrame) -> DataFrame:
    """Buy-and-hold return of each symbol over the bars given; NULL for under two bars or a zero start."""
    at = F.struct("session", "ts")
    a, b = F.min_by("close", at), F.max_by("close", at)
    return bars.groupBy("symbol").agg(F.when(F.count("*") >= 2, F.try_divide(b - a, F.nullif(a, F.lit(0.0))) * 100).alias("hold_pct"))
