"""Streams over files give what the batch gives, once."""

from __future__ import annotations

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tickloom.config import Gates
from tickloom.operators import features as ft
from tickloom.operators import outcomes as oc
from tickloom.operators.alerts import append, autoscan
from tickloom.sources import bars as br
from tickloom.sources import files
from tickloom.streaming import journal, live
from tickloom.streaming.carried import Carried


def run(stream, name, path, mode="append"):
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start().awaitTermination(120)
    return stream.sparkSession.table(name)


def test_bars_of_a_stream_equal_the_batch(spark, sf, tmp_path):
    ticks = br.event_ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    ticks.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "ticks"))
    end = ticks.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("interval 2 days")).withColumn("symbol", F.lit("end"))
    end.write.mode("append").parquet(str(tmp_path / "ticks"))  # closes all windows before it
    stream = live.stream_bars(spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ticks")))
    got = run(stream, "bars_out", tmp_path / "c").where("symbol <> 'end'")
    batch = br.bars_from_ticks(br.event_ticks(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp")).select(*got.columns)
    assert got.count() == batch.count()
    assert got.exceptAll(batch).count() == batch.exceptAll(got).count() == 0


def test_a_signal_counts_once_a_day(spark, tmp_path):
    rows = [("A", "s", "long", "2026-01-05", "2026-01-05 10:00:00"), ("A", "s", "long", "2026-01-05", "2026-01-05 11:00:00"), ("A", "s", "short", "2026-01-05", "2026-01-05 11:00:00"), ("A", "s", "long", "2026-01-06", "2026-01-06 10:00:00")]
    df = spark.createDataFrame(rows, "symbol string, setup string, direction string, session string, ts string").withColumns({"session": F.to_date("session"), "ts": F.to_timestamp("ts")})
    for k in range(2):  # the same rows come twice
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(live.once_a_day(stream), "once_out", tmp_path / "c")
    assert sorted((r.direction, str(r.session)) for r in got.collect()) == [("long", "2026-01-05"), ("long", "2026-01-06"), ("short", "2026-01-05")]


def test_counters_end_with_their_day_and_batches_may_run_again(spark, tmp_path):
    at = lambda d, h: dt.datetime(2026, 1, d, h)
    rows = [(at(5 + i // 10, 9 + i % 7), ("volume_low", "slope_flat", None)[i % 3]) for i in range(30)]
    log = spark.createDataFrame(rows, "ts timestamp, reject_code string")
    for k in range(3):
        log.where(f"day(ts) = {5 + k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(at(12, 9), "end")], log.schema)
    stream = lambda: spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.run_counters(stream(), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = live.run_counters(stream(), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert q.lastProgress.stateOperators[0].numRowsTotal == 1  # the last day's only
    want = sorted(map(str, log.unionByName(end).groupBy(F.to_date("ts").alias("session"), "reject_code").agg(F.count("*").alias("n")).collect()))
    assert sorted(map(str, live.counted(spark, str(tmp_path / "out")).collect())) == want
    first = spark.createDataFrame(spark.read.parquet(str(tmp_path / "out" / "batch=0")).collect(), "session date, reject_code string, n long")
    first.write.mode("overwrite").parquet(str(tmp_path / "out" / "batch=0"))  # a batch that runs again writes what it wrote
    assert sorted(map(str, live.counted(spark, str(tmp_path / "out")).collect())) == want


BAR = "symbol string, ts timestamp_ntz, session date, open double, high double, low double, close double, volume double"


def walk(spark, symbols, days, per_day, seed, minutes=5):
    """Bars of random walks, some of them missing."""
    rng, rows = random.Random(seed), []
    for s in symbols:
        price = 100.0
        for d in range(days):
            for k in range(per_day):
                if rng.random() < 0.1:
                    continue
                o, price = price, max(1.0, price * (1 + rng.gauss(0, 0.004)))
                ts = dt.datetime(2026, 1, 5, 9, 15) + dt.timedelta(days=d, minutes=minutes * k)
                rows.append((s, ts, ts.date(), o, max(o, price) * (1 + rng.random() / 500), min(o, price) * (1 - rng.random() / 500), price, float(rng.randint(0, 50))))
    return spark.createDataFrame(rows, BAR), rows


def test_features_of_random_cuts_equal_those_of_the_whole_history(spark, tmp_path):
    bars, rows = walk(spark, "AB", 12, 20, 4)
    rng = random.Random(9)
    cuts = sorted(rng.sample(range(1, len(rows)), 7))
    by_time = sorted(rows, key=lambda r: r[1])
    carried, got = Carried(str(tmp_path / "state")), None
    for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        batch = spark.createDataFrame(by_time[max(0, a - 3) : b], BAR)  # a few rows come twice
        if number == 3:
            carried.features(batch, number).count()  # fails later and runs again
        part = carried.features(batch, number).collect()
        got = part if got is None else got + part
    whole = ft.with_relative_volume(ft.features(br.numbered(bars)))
    names = [c for c, kind in whole.dtypes if c not in ("ts", "session")]
    same = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1, abs(a)))
    want = {(r.symbol, r.ts): r for r in whole.collect()}
    assert len(got) == len(want) == len(rows)
    for r in got:
        for c in names:
            assert same(r[c], want[r.symbol, r.ts][c]), (r.symbol, r.ts, c, r[c], want[r.symbol, r.ts][c])
    held = carried.state(spark.createDataFrame([], BAR))
    assert held.groupBy("symbol").count().agg(F.max("count")).first()[0] <= 7 * 20


ALERT = "alert_id long, symbol string, direction string, category string, entry double, stop_loss double, target1 double, target2 double, generated_at timestamp_ntz, trade_date date"


def test_alerts_are_settled_by_state_as_by_the_batch(spark, tmp_path):
    bars, rows = walk(spark, "ABC", 14, 30, 11, 12)
    rng, made = random.Random(2), []
    for i, r in enumerate(rng.sample(rows, 260)):
        way, unit = rng.choice(["BUY", "SELL"]), r[6] * rng.choice([0.004, 0.01, 0.03])
        side = 1 if way == "BUY" else -1
        made.append((i, r[0], way, rng.choice(["scan", "manual_intraday", "swing_auto", "channel_call"]), r[6], r[6] - side * unit, r[6] + 2 * side * unit, r[6] + 3 * side * unit, r[1], r[2]))
    alerts = spark.createDataFrame(made, ALERT)
    alerts.unionByName(alerts.limit(20)).coalesce(1).write.parquet(str(tmp_path / "alerts"))  # some come twice
    order, step = sorted(rows, key=lambda r: r[1]), 170
    parts = [order[k : k + step] for k in range(0, len(order), step)]
    end = [("Z", dt.datetime(2026, 6, 1, 10), dt.date(2026, 6, 1), 1.0, 1.0, 1.0, 1.0, 1.0)]

    def go(files, **more):
        for x in files:
            spark.createDataFrame(x, BAR).coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
        read = lambda schema, name: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        q = live.run_resolver(read(ALERT, "alerts"), read(BAR, "bars"), str(tmp_path / "out"), str(tmp_path / "c"), horizon=10, spread=2)
        q.awaitTermination(300)
        assert q.exception() is None
        return q

    go(parts[:4])
    early = spark.read.parquet(str(tmp_path / "out")).count()
    go(parts[4:])  # a restart goes on from the state
    q = go([end, [(*end[0][:1], end[0][1] + dt.timedelta(days=2), *end[0][2:])]])
    days = bars.groupBy("symbol", "session").agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close")).withColumn("ts", F.col("session").cast("timestamp_ntz"))
    a = alerts.withColumn("direction", oc.normal_direction(F.col("direction")))
    want = oc.resolve_intraday(a.where("category in ('scan', 'manual_intraday')"), bars).unionByName(oc.resolve_swing(a.where("category in ('swing_auto', 'channel_call')"), days, 10)).where("status not in ('open', 'no_data')")
    shown = lambda df: sorted((r.alert_id, r.status, r.exit_price, r.exit_time, round(r.pnl_pct, 9)) for r in df.collect())
    got = shown(spark.read.parquet(str(tmp_path / "out")))
    assert 0 < early < len(got) and got == shown(want)
    assert {s for _, s, *_ in got} >= {"time_stop", "sl_hit", "t2_hit", "t1_then_breakeven", "squareoff_no_t1"}
    # What the batch resolver leaves pending is what the stream has not settled.
    rest = oc.resolve_pending(alerts, spark.read.parquet(str(tmp_path / "out")), bars, days, F.lit("2026-01-19").cast("date")).where("status not in ('open', 'no_data')")
    assert rest.count() == 0
    assert sum(s.numRowsTotal for s in q.lastProgress.stateOperators) < 20  # nothing pending is kept for ever


def test_scan_of_raw_bars_fires_once_and_keeps_the_daily_cap(spark, sf, tmp_path):
    g = Gates(min_score=45, per_day=2)
    bars = br.intraday(spark, sf).where("session < date'2024-01-12'").select(*(x.split()[0] for x in BAR.split(", ")))
    rows = sorted(bars.collect(), key=lambda r: r.ts)
    for k in range(0, len(rows), 150):
        spark.createDataFrame(rows[k : k + 150], bars.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root = str(tmp_path / "alerts")
    judge = lambda f: live.judged(f, indices=["view"])
    other = bars.limit(3).selectExpr("'manual_intraday' category", "1L user_id", "symbol", "'A' setup", "'long' direction", "0D entry", "0D stop_loss", "0D target1", "0D target2", "ts generated_at", "session trade_date", "1L alert_id", "concat(symbol, session) signal_key")
    append(other, root)  # alerts of other categories do not count towards the cap
    for k in range(2):  # the second run sees the same bars again
        stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        live.run_scan(spark, stream, root, str(tmp_path / f"s{k}"), str(tmp_path / f"c{k}"), judge, g, {"availableNow": True}).awaitTermination(300)
    got = spark.read.parquet(root).where("category = 'scan'")
    feat = ft.with_relative_volume(ft.features(br.numbered(bars)))
    want = autoscan(live.judged(feat, indices=["view"]), g)
    shown = lambda df: sorted((r.symbol, r.direction, r.setup, r.generated_at, round(r.stop_loss, 6)) for r in df.collect())
    assert got.count() > 0 and shown(got) == shown(want)
    assert got.groupBy("trade_date").count().agg(F.max("count")).first()[0] <= 2
    assert got.count() == got.select("signal_key").distinct().count()


def test_a_message_of_an_earlier_day_is_looked_for_in_its_folder_only(spark, tmp_path):
    rows = spark.createDataFrame([("c", i, dt.datetime(2026, 1, 1 + i % 20, 9), "x") for i in range(200)], "channel string, msg_id long, ts timestamp_ntz, text string")
    root, keys = str(tmp_path / "t"), ["channel", "msg_id"]
    journal.append_new_rows(journal.new_rows(rows, keys, "ts", root), root)
    again = rows.where("msg_id = 7").unionByName(spark.createDataFrame([("c", 999, dt.datetime(2026, 1, 8, 9), "y"), ("c", 1000, None, "z")], rows.schema))
    fresh = journal.new_rows(again.unionByName(again), keys, "ts", root)
    assert sorted(r.msg_id for r in fresh.collect()) == [999, 1000]
    read = journal.stored_near(spark, journal.with_bucket(again.where("ts is not null"), keys, "ts"), root, "channel string, msg_id long")
    filters = read._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "day#" in filters and "bucket#" in filters and "2026-01-08" in filters
    journal.append_new_rows(fresh, root)
    assert journal.new_rows(again, keys, "ts", root).count() == 0


def test_rows_move_once_to_the_stored_keys(spark, tmp_path):
    at = lambda d: dt.datetime(2026, 1, d, 9)
    schema, keys, root = "channel string, msg_id long, ts timestamp_ntz, text string", ["channel", "msg_id"], str(tmp_path / "t")
    first = spark.createDataFrame([("c", 1, at(1), "a"), (None, 2, at(2), "b"), ("c", None, None, "c")], schema)
    journal.append_new_rows(journal.new_rows(first, keys, "ts", root), root)
    more = [("c", 3, at(1), "d"), ("d", 1, at(1), "e"), ("c", 1, at(5), "another day"), (None, 2, at(3), "another day")]
    fresh = journal.new_rows(first.unionByName(spark.createDataFrame(more * 2, schema)), keys, "ts", root)
    assert sorted((r.text, r.day.day) for r in fresh.collect()) == [("another day", 3), ("another day", 5), ("d", 1), ("e", 1)]
    assert fresh.columns == [*first.columns, "day", "bucket"]
    plan = fresh._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_versions_are_compacted_under_readers_and_after_failures(spark, tmp_path):
    schema = "alert_id long, status string, resolved_at timestamp"
    table = journal.Versions(spark, str(tmp_path / "v"), schema)
    rows = lambda *x: spark.createDataFrame([(i, s, dt.datetime(2026, 1, 9, h), dt.date(2026, 1, d)) for i, s, h, d in x], f"{schema}, trade_date date")
    shown = lambda df: sorted((r.alert_id, r.status) for r in df.collect())
    assert table.read().count() == 0
    table.append(rows((1, "open", 1, 5), (2, "open", 1, 5), (3, "open", 1, 6), (4, "open", 1, 7)))
    table.append(rows((1, "t2_hit", 2, 5), (3, "sl_hit", 2, 6)))
    want = [(1, "t2_hit"), (2, "open"), (3, "sl_hit"), (4, "open")]
    reader = table.read()  # planned before the rewrite, run during and after it
    assert shown(reader) == want
    before = table.stored().count()
    real, table._enter = table._enter, lambda _: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        table.compact()
    except RuntimeError:
        pass
    assert shown(table.read()) == want and table.stored().count() == before == 6  # half a compaction is not seen
    table._enter = real
    table.compact()
    assert shown(table.read()) == want == shown(reader) and table.stored().count() == 4
    table.append(rows((4, "sl_hit", 3, 7), (2, "t2_hit", 3, 5)))
    table.compact(F.col("trade_date") > F.lit("2026-01-05").cast("date"))
    want = [(1, "t2_hit"), (2, "t2_hit"), (3, "sl_hit"), (4, "sl_hit")]
    assert shown(table.read()) == want and table.stored().count() == 5
    plan = table.stored().where("trade_date = date'2026-01-07'")
    filters = plan._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "trade_date#" in filters and "gen#" in filters and plan.count() == 1
    table.purge(F.lit("2026-01-06").cast("date"))
    table.append(rows((1, "late", 4, 5)))
    assert shown(table.read()) == [(3, "sl_hit"), (4, "sl_hit")]
    assert not [x for x in (tmp_path / "v" / "trade_date=2026-01-05").iterdir() if x.name.startswith("gen=")]


def test_tip_stream_appends_with_the_gate(spark, tmp_path):
    texts = ["buy ABC @ 100 SL 95 TGT 110 " + "x" * 1500, "sell XYZ at 50", "go short LOW cmp 20", "buy BAD @ 70", "ABC is fine"]
    lines = [json.dumps({"channel": "c", "msg_id": i, "ts": "2026-01-05 10:00:00", "text": t}) for i, t in enumerate(texts)]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text("\n".join([*lines, lines[0]]))
    universe = spark.createDataFrame([("ABC",), ("XYZ",), ("LOW",), ("BAD",)], "symbol string")
    voted = spark.createDataFrame([("ABC", "BUY", 100.0), ("LOW", "SELL", 50.0), ("BAD", "BUY", 100.0)], "symbol string, signal string, confidence double")
    rejected = spark.createDataFrame([("BAD", "long", "volume_low")], "symbol string, direction string, code string")
    for k in range(2):
        live.run_tips(files.messages(spark, str(tmp_path / "m"), stream=True), universe, str(tmp_path / "t"), str(tmp_path / f"c{k}"), lambda _: (voted, rejected)).awaitTermination(60)
    got = {r.symbol: r for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    assert {s: r.outcome for s, r in got.items()} == {"ABC": "passed", "XYZ": "error", "LOW": "low_confidence", "BAD": "failed_filter"}
    assert got["ABC"].agreement == "Agreement" and len(got["ABC"].raw_text) == 1000 and got["ABC"].received_at is not None
