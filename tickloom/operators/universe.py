"""Which symbols exist and when: aliases, lists, snapshots, tradable sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Places of a list that one task ranks, on average.
RUN = 4096


def alias_key(s: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(s)), "\\.NS|\\.BO|[ -]", "")


def base_symbol(s: Column) -> Column:
    return F.upper(F.trim(F.substring_index(s, ".", 1)))


def normalize_symbols(rows: DataFrame, aliases: DataFrame, column: str = "symbol") -> DataFrame:
    """Adds ticker and display: ^ symbols as they are, index aliases (alias, ticker, display) by name, others upper-case with .NS unless they have a market."""
    up = F.upper(F.trim(F.col(column)))
    plain = F.when(up.startswith("^") | up.contains("."), up).otherwise(F.concat(up, F.lit(".NS")))
    a = aliases.select(F.col("alias").alias("__alias"), F.col("ticker").alias("__ticker"), F.col("display").alias("__display"))
    out = rows.join(a, alias_key(F.col(column)) == F.col("__alias"), "left")
    ticker = F.when(up.startswith("^"), up).otherwise(F.coalesce("__ticker", plain))
    return out.withColumn("ticker", ticker).withColumn("display", F.coalesce("__display", F.col(column))).drop("__alias", "__ticker", "__display")


def instruments(symbols: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols with token and exchange of their cash instrument in master (exch_seg, symbol, name, instrumenttype, token), and those without one."""
    exch = F.when(F.upper("symbol").endswith(".BO"), "BSE").otherwise("NSE")
    want = symbols.select("symbol", exch.alias("exch"), F.concat(base_symbol(F.col("symbol")), F.lit("-EQ")).alias("target"))
    m = master.select(F.col("exch_seg").alias("exch"), F.col("symbol").alias("target"), "token")
    out = want.join(m, ["exch", "target"], "left")
    return out.where("token is not null"), out.where("token is null").select("symbol", "exch", "target")


def index_candles(names: DataFrame, aliases: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars of the indices that names (symbol) mean, by the alias table (alias, ticker, display), under their display names; other names have none."""
    known = normalize_symbols(names.select("symbol").distinct(), aliases).where(F.col("ticker").startswith("^"))
    return known.select(F.col("ticker").alias("__ticker"), F.col("display").alias("index_name")).join(bars, F.col("__ticker") == F.col("symbol")).drop("__ticker")


def tradable(master: DataFrame) -> DataFrame:
    """Cash symbols that are underlyings of stock futures, without test and indicative names, in order of where master first names them.

    Where master has pos, its order, so has the result; else the order is that of its rows.
    """
    if "pos" not in master.columns:
        master = master.withColumn("pos", F.monotonically_increasing_id())
    cash = master.where("exch_seg = 'NSE' and symbol like '%-EQ' and symbol not like '%INAV%'").groupBy(F.regexp_replace("symbol", "-EQ$", "").alias("symbol")).agg(F.min("pos").alias("pos"))
    under = master.where("exch_seg = 'NFO' and instrumenttype = 'FUTSTK' and name not like '%TEST%'").select(F.col("name").alias("symbol")).distinct()
    return cash.join(under, "symbol", "left_semi").orderBy("pos")


def or_default(found: DataFrame, default: DataFrame, least: int) -> DataFrame:
    """found if it has `least` rows, else default."""
    n = found.agg((F.count("*") >= least).alias("enough"))
    return found.crossJoin(F.broadcast(n)).where("enough").drop("enough").unionByName(default.crossJoin(F.broadcast(n)).where("not enough").drop("enough"))


def union_lists(lists: list[DataFrame]) -> DataFrame:
    """(symbol, place): the lists' symbols once each, in order of the first list and place (symbol, pos) where they stand.

    Symbols are ranked inside runs of RUN places of a list, on top of prefix sums of the
    runs' counts, so no task sorts all symbols.
    """
    rows = lists[0].select("symbol", F.lit(0).alias("i"), "pos")
    for k, x in enumerate(lists[1:], 1):
        rows = rows.unionByName(x.select("symbol", F.lit(k).alias("i"), "pos"))
    first = rows.groupBy("symbol").agg(F.min(F.struct("i", "pos")).alias("at"))
    placed = first.select("symbol", "at", F.struct("at.i", F.floor(F.col("at.pos") / RUN).alias("run")).alias("run"))
    runs = placed.groupBy("run").agg(F.count("*").alias("held")).select("run", F.coalesce(F.sum("held").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("run").orderBy("at", "symbol"))
    return placed.withColumn("nth", inside).join(runs, "run").select("symbol", (F.col("before") + F.col("nth")).cast("int").alias("place"))


def snapshot(symbols: DataFrame, as_of: Column) -> DataFrame:
    return symbols.select("symbol").distinct().select(as_of.alias("as_of"), "symbol")


def write_snapshot(snap: DataFrame, root: str) -> None:
    snap.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(root)


def as_of(snapshots: DataFrame, dates: DataFrame) -> DataFrame:
    """(d, as_of, symbol, survivorship_biased) of each date asked for: the latest snapshot up to it, or NULLs and true without one.

    Distinct calendar days of both sides, which are few whatever the data, lie in one
    order; each day asked for takes the last snapshot day before it there.
    """
    none = F.lit(None).cast("date")
    days = snapshots.select(F.col("as_of").alias("at"), "as_of", none.alias("d")).distinct().unionByName(dates.select(F.col("d").alias("at"), none.alias("as_of"), "d").distinct())
    best = days.withColumn("as_of", F.last("as_of", ignorenulls=True).over(W.orderBy("at", F.col("as_of").desc_nulls_last()))).where("d is not null").select("d", "as_of")
    return best.join(snapshots, "as_of", "left").select("d", "as_of", "symbol", F.col("as_of").isNull().alias("survivorship_biased"))


def memberships(snapshots: DataFrame) -> DataFrame:
    """(symbol, valid_from, valid_to): the spans in which snapshots (as_of, symbol) list a symbol; valid_to is NULL where it still is.

    A snapshot holds until the day before the next one. Snapshot days, few whatever the
    data, are numbered; numbers of a symbol that follow each other make one span.
    """
    days = snapshots.select("as_of").distinct()
    days = days.select("as_of", F.row_number().over(W.orderBy("as_of")).alias("k"), F.lead("as_of").over(W.orderBy("as_of")).alias("next"))
    held = snapshots.select("as_of", "symbol").distinct().join(days, "as_of")
    held = held.withColumn("span", F.col("k") - F.row_number().over(W.partitionBy("symbol").orderBy("k")))
    return held.groupBy("symbol", "span").agg(F.min("as_of").alias("valid_from"), F.max_by("next", "k").alias("valid_to")).drop("span")


def with_membership(rows: DataFrame, snapshots: DataFrame, day: str = "session") -> DataFrame:
    """Adds member, whether the symbol was listed on the row's day, and survivorship_biased, whether no snapshot tells.

    Spans and rows meet by symbol and month, so a span is met by the rows of its months
    only, at most once each; a span that still runs is cut at the last day asked for. A
    row of a day before all snapshots has NULL and true.
    """
    own = rows.columns
    ends = rows.agg(F.max(day).alias("most"))
    firsts = snapshots.agg(F.min("as_of").alias("least"))  # one row, like ends
    spans = memberships(snapshots).crossJoin(F.broadcast(ends)).withColumn("to", F.coalesce(F.col("valid_to"), F.date_add("most", 1))).where("valid_from < to")
    months = spans.select("symbol", "valid_from", "to", F.explode(F.sequence(F.trunc("valid_from", "month"), F.trunc(F.date_sub("to", 1), "month"), F.expr("interval 1 month"))).alias("__month"))
    out = rows.withColumn("__month", F.trunc(day, "month")).alias("r").join(months.alias("m"), (F.col("r.symbol") == F.col("m.symbol")) & (F.col("r.__month") == F.col("m.__month")) & (F.col(f"r.{day}") >= F.col("m.valid_from")) & (F.col(f"r.{day}") < F.col("m.to")), "left")
    out = out.select(*(F.col(f"r.`{c}`") for c in own), F.col("m.symbol").isNotNull().alias("__in")).crossJoin(F.broadcast(firsts))
    biased = F.col("least").isNull() | (F.col(day) < F.col("least"))
    return out.select(*own, F.when(~biased, F.col("__in")).alias("member"), biased.alias("survivorship_biased"))
