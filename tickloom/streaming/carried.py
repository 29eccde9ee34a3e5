"""Features of a stream's batches from a bounded state of each symbol, equal to those of its whole history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind
from tickloom.operators import features as ft
from tickloom.sources.shared import delete, names

EMAS = {"ema9": 9, "ema20": 20, "ema50": 50}
#: Whole sessions, and bars at least, of a symbol that are carried on: relative volume looks back four sessions, windows 15 bars.
SESSIONS, BARS = 7, 50
STATE = "symbol {symbol}, ts timestamp_ntz, session date, open double, high double, low double, close double, volume double, rn int, session_no int, bar_no int, ema9 double, ema20 double, ema50 double"


def resumed(state: DataFrame, batch: DataFrame) -> DataFrame:
    """Features, with rvol, of the state's rows and of the batch's bars after them; `new` marks these.

    A symbol's numbers go on where its state ends. Exponential means go on from the last
    row's values, which stand in for a first bar; all other indicators look back no
    further than the rows that the state holds. Bars up to a symbol's last known time
    are left out, and of bars of equal time one is taken.
    """
    own = ["symbol", "ts", "session", "open", "high", "low", "close", "volume"]
    before = state.groupBy("symbol").agg(F.max("ts").alias("__last"))
    fresh = batch.select(*own).dropDuplicates(["symbol", "ts"]).join(before, "symbol", "left").where("__last is null or ts > __last").drop("__last")
    rows = state.withColumn("new", F.lit(False)).unionByName(fresh.withColumn("new", F.lit(True)), allowMissingColumns=True)
    w, session = W.partitionBy("symbol").orderBy("session", "ts"), W.partitionBy("symbol", "session").orderBy("ts")
    changed = (F.lag("session").over(w).isNull() | (F.lag("session").over(w) != F.col("session"))).cast("int")
    rows = rows.withColumns({"__nth": F.row_number().over(w), "__changed": changed, "__in": F.row_number().over(session)})
    first = lambda c: F.coalesce(F.first(c).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(1))
    so_far = F.sum("__changed").over(w.rowsBetween(W.unboundedPreceding, 0))
    in_session = F.coalesce(F.first("bar_no").over(session.rowsBetween(W.unboundedPreceding, 0)), F.lit(1))
    numbers = {"rn": first("rn") + F.col("__nth") - 1, "session_no": first("session_no") + so_far - 1, "bar_no": in_session + F.col("__in") - 1}
    rows = rows.withColumns({k: v.cast("int") for k, v in numbers.items()})
    known = F.coalesce(F.max(F.when(~F.col("new"), F.col("rn"))).over(W.partitionBy("symbol")), F.lit(0))
    rows = rows.withColumn("__step", F.when(known > 0, F.col("rn") - known + 1).otherwise(F.col("rn")))
    rows = rows.withColumns({f"__{k}": F.when(F.col("new"), F.col("close")).when(F.col("__step") == 1, F.col(k)) for k in EMAS})
    rows = ind.with_emas(rows, {f"{k}_on": (f"__{k}", n) for k, n in EMAS.items()}, "__step")
    rows = rows.withColumns({k: F.when(F.col("new"), F.col(f"{k}_on")).otherwise(F.col(k)) for k in EMAS}).drop("__nth", "__changed", "__in", "__step", *(f"__{k}" for k in EMAS), *(f"{k}_on" for k in EMAS))
    return ft.with_relative_volume(ft.features(rows, carried=True))


def left(rows: DataFrame) -> DataFrame:
    """The state after resumed() rows: each symbol's last SESSIONS sessions, and its last BARS bars."""
    w = W.partitionBy("symbol")
    ends = {"__session": F.max("session_no").over(w), "__rn": F.max("rn").over(w)}
    kept = rows.withColumns(ends).where((F.col("session_no") > F.col("__session") - SESSIONS) | (F.col("rn") > F.col("__rn") - BARS))
    return kept.select(*(x.split()[0] for x in STATE.split(", ")))


class Carried:
    """States of all symbols in versions of a folder, one for each batch of a stream.

    A batch reads the version before it and writes its own, so one that runs again after
    a failure finds and leaves the same. The two versions before stay for that.
    """

    def __init__(self, root: str) -> None:
        self.root, self.held = root, None

    def state(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        spark = batch.sparkSession
        versions = [int(x[2:]) for x in names(spark, self.root) if x.startswith("v=")]
        earlier = [v for v in versions if number is None or v < number]
        schema = STATE.format(symbol=batch.schema["symbol"].dataType.simpleString())
        return spark.read.schema(schema).parquet(f"{self.root}/v={max(earlier)}") if earlier else spark.createDataFrame([], schema)

    def features(self, batch: DataFrame, number: int) -> DataFrame:
        """Features of the batch's new bars (symbol, ts, session, open, high, low, close, volume); writes the version of this batch."""
        state = self.state(batch, number)
        if self.held is not None:
            self.held.unpersist()  # of the batch before
        rows = self.held = resumed(state.join(batch.select("symbol").distinct(), "symbol", "left_semi"), batch).persist()
        others = state.join(batch.select("symbol").distinct(), "symbol", "left_anti")
        left(rows).unionByName(others).write.mode("overwrite").parquet(f"{self.root}/v={number}")
        spark = batch.sparkSession
        for v in (int(x[2:]) for x in names(spark, self.root) if x.startswith("v=")):
            if v < number - 2:
                delete(spark, f"{self.root}/v={v}")
        return rows.where("new").drop("new")
