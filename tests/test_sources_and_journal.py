"""Files, zones, lists and the journal's writers, which no query runs."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from tickloom.operators import alerts, universe
from tickloom.sources import bars as br
from tickloom.sources import files


def test_bars_of_a_folder(spark, sf, tmp_path):
    root = str(tmp_path / "bars")
    hours = br.intraday(spark, sf).select("symbol", "ts", "session", "open", "high", "low", "close", "volume")
    br.write_bars(hours.where("symbol = 'view'"), root, "1h")
    br.write_bars(hours.where("symbol = 'click'"), root, "5m")
    got = br.read_bars(spark, root, "1h")
    want = hours.where("symbol = 'view'")
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    plan = got.where("session = date'2024-01-03'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(interval" in plan and "session" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_times_of_another_zone_get_the_market_s_session(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2026, 1, 5, 20, 0)), (2, dt.datetime(2026, 1, 5, 4, 0)), (3, None)], "i int, ts timestamp_ntz").withColumn("session", F.to_date("ts"))
    got = {r.i: (r.ts, r.session) for r in br.in_market_zone(rows).collect()}
    assert got == {1: (dt.datetime(2026, 1, 6, 1, 30), dt.date(2026, 1, 6)), 2: (dt.datetime(2026, 1, 5, 9, 30), dt.date(2026, 1, 5)), 3: (None, None)}
    instants = rows.withColumn("ts", F.col("ts").cast("timestamp"))  # the session's zone is UTC
    assert {r.i: r.ts for r in br.in_market_zone(instants).collect()} == {i: ts for i, (ts, _) in got.items()}
    eastern = br.in_market_zone(rows.where("i = 2"), source="America/New_York").first()
    assert eastern.ts == dt.datetime(2026, 1, 5, 14, 30)


def test_instrument_master_and_messages(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"exch_seg": "NSE", "symbol": "ABC-EQ", "name": "ABC", "instrumenttype": "", "token": "7", "more": 1}, {"exch_seg": "NFO", "symbol": "ABC26FUT", "name": "ABC", "instrumenttype": "FUTSTK", "token": "8"}]))
    master = files.instrument_master(spark, str(tmp_path / "m.json"))
    assert [r.symbol for r in universe.tradable(master).collect()] == ["ABC"]
    found, missing = universe.instruments(spark.createDataFrame([("ABC.NS",), ("XYZ.BO",)], "symbol string"), master)
    assert [r.token for r in found.collect()] == ["7"] and [r.symbol for r in missing.collect()] == ["XYZ.BO"]
    (tmp_path / "x.json").write_text('{"channel": "c", "msg_id": 1, "ts": "2026-01-05 10:00:00", "text": "hello"}\n{"channel": "c", "msg_id": 2, "text": " "}\n{"channel": "c", "msg_id": 3}\n')
    got = files.messages(spark, str(tmp_path / "x.json")).collect()
    assert [(r.msg_id, r.ts) for r in got] == [(1, dt.datetime(2026, 1, 5, 10))]
    tip = files.raw_tips(spark.createDataFrame([("x" * 1200,)], "raw_text string")).first()
    assert len(tip.raw_text) == 1000 and tip.received_at is not None


def test_keyed_appends_snapshots_and_notices(spark, tmp_path):
    root = str(tmp_path / "keyed")
    first = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    alerts.append_new(first, first.limit(0), "k", root)
    alerts.append_new(spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int"), spark.read.parquet(root), "k", root)
    assert sorted((r.k, r.v) for r in spark.read.parquet(root).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    snap = str(tmp_path / "snap")
    day = lambda d, names: universe.snapshot(spark.createDataFrame([(n,) for n in names], "symbol string"), F.lit(d).cast("date"))
    for d, names in (("2026-01-01", "ab"), ("2026-02-01", "abc"), ("2026-01-01", "xx")):  # the last replaces its day only
        universe.write_snapshot(day(d, names), snap)
    assert sorted((str(r.as_of), r.symbol) for r in spark.read.parquet(snap).collect()) == [("2026-01-01", "x"), ("2026-02-01", "a"), ("2026-02-01", "b"), ("2026-02-01", "c")]
    a = spark.createDataFrame([(1, 5, "swing_auto"), (2, 5, "swing_auto"), (3, None, "swing_auto")], "alert_id long, user_id long, category string")
    o = spark.createDataFrame([(1, "t2_hit"), (2, "sl_hit"), (3, "t2_hit")], "alert_id long, status string")
    told = str(tmp_path / "told")
    alerts.mark_notified(a.where("alert_id = 1"), told)
    assert [r.alert_id for r in alerts.unnotified(a, o, spark.read.parquet(told), ("swing_auto",), ("t2_hit", "sl_hit")).collect()] == [2]


def test_journal_order_and_defaults(spark):
    rows = spark.createDataFrame([(3, dt.datetime(2026, 1, 2)), (1, dt.datetime(2026, 1, 3)), (2, dt.datetime(2026, 1, 2))], "alert_id long, generated_at timestamp_ntz")
    assert [r.alert_id for r in alerts.journal_order(rows.repartition(3)).collect()] == [2, 3, 1]
    found, default = (spark.createDataFrame([(x,) for x in names], "symbol string") for names in ("ab", "xyz"))
    assert sorted(r.symbol for r in universe.or_default(found, default, 2).collect()) == ["a", "b"]
    assert sorted(r.symbol for r in universe.or_default(found, default, 3).collect()) == ["x", "y", "z"]


def test_delivery_of_a_folder_and_the_newest_file(spark, tmp_path):
    from tickloom.operators import score

    (tmp_path / "d").mkdir()
    for name, lines in {"sec_05012026.csv": "abc, EQ, 55.5\nxyz, EQ, 40", "full-2026-01-08.csv": "xyz, EQ, 41\nq, BE, 3", "sec_09012026.csv": "abc, EQ, -\n", "notes.csv": "abc, EQ, 1"}.items():
        (tmp_path / "d" / name).write_text("SYMBOL , SERIES, DELIV_PER\n" + lines + "\n")
    found = files.delivery_files(spark, str(tmp_path / "d"))
    assert sorted((r.symbol, str(r.as_of), r.delivery_pct) for r in found.collect()) == [("ABC", "2026-01-05", 55.5), ("XYZ", "2026-01-05", 40.0), ("XYZ", "2026-01-08", 41.0)]
    asked = spark.createDataFrame([(s, dt.date(2026, 1, d)) for s in ("ABC", "XYZ") for d in (4, 6, 9, 14)], "symbol string, session date")
    got = {(r.symbol, r.session.day): r.delivery_pct for r in score.with_delivery(asked, found).collect()}
    # On the 9th the file of the 8th counts, which lacks ABC; on the 14th none is new enough.
    assert got == {("ABC", 4): None, ("ABC", 6): 55.5, ("ABC", 9): None, ("ABC", 14): None, ("XYZ", 4): None, ("XYZ", 6): 40.0, ("XYZ", 9): 41.0, ("XYZ", 14): None}


def test_orders_of_lists(spark):
    master = spark.createDataFrame([(i, e, s, n, k) for i, (e, s, n, k) in enumerate([("NFO", "ZF", "Z", "FUTSTK"), ("NSE", "Z-EQ", "Z", ""), ("NFO", "AF", "A", "FUTSTK"), ("NSE", "A-EQ", "A", ""), ("NSE", "M-EQ", "M", ""), ("NSE", "Z-EQ", "Z", ""), ("NFO", "TEST1", "M TEST", "FUTSTK")])], "pos long, exch_seg string, symbol string, name string, instrumenttype string")
    assert [r.symbol for r in universe.tradable(master.repartition(3)).collect()] == ["Z", "A"]
    at = lambda d: dt.datetime(2026, 1, d)
    seen = spark.createDataFrame([(1, "b", at(3), "add"), (1, "a", at(4), "add"), (1, "c", at(1), "add"), (1, "c", at(2), "remove"), (1, "b", at(9), "add"), (2, "z", at(1), "add")], "user_id long, symbol string, at timestamp_ntz, action string")
    assert [r.symbol for r in alerts.watchlist_of(alerts.watchlists(seen).repartition(3), 1).collect()] == ["b", "a"]


def test_default_watchlists_take_little_room(spark, tmp_path):
    users = spark.range(40).select(F.when(F.col("id") < 39, F.col("id")).alias("user_id"))  # one has no id
    symbols = spark.range(70_000).select(F.when(F.col("id") > 0, F.col("id")).alias("symbol"))  # more than a compressor looks back on, and one NULL
    own = spark.createDataFrame([(3, 1), (3, 7), (9999, 5)], "user_id long, symbol long")
    got = alerts.watched_or_default(users, own, F.broadcast(symbols))
    got.write.parquet(str(tmp_path / "w"))
    rows = spark.read.parquet(str(tmp_path / "w"))
    assert got.columns == ["user_id", "symbol"] and rows.count() == 39 * 70_000 + 2
    per = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("d"))
    assert sorted((r.user_id is None, r.n, r.d) for r in per.collect()) == sorted([(False, 2, 2)] + [(False, 70_000, 69_999)] * 38 + [(True, 70_000, 69_999)])
    stored = sum(f.stat().st_size for f in (tmp_path / "w").glob("*.parquet"))
    assert stored < 0.5 * 39 * 70_000  # bytes


def test_spans_of_membership(spark):
    day = lambda m, d=1: dt.date(2026, m, d)
    snaps = spark.createDataFrame([(day(m), s) for m, held in {1: "ab", 2: "ab", 3: "b", 4: "ab"}.items() for s in held] + [(day(1), "a")], "as_of date, symbol string")
    spans = sorted((r.symbol, r.valid_from, r.valid_to) for r in universe.memberships(snaps).collect())
    assert spans == [("a", day(1), day(3)), ("a", day(4), None), ("b", day(1), None)]
    rows = [("a", dt.date(2025, 12, 31)), ("a", day(1)), ("a", day(2, 28)), ("a", day(3)), ("a", day(9)), ("b", day(3)), ("c", day(3)), (None, day(3)), ("a", day(1))]
    got = universe.with_membership(spark.createDataFrame(rows, "symbol string, session date").withColumn("as_of", F.lit(1)), snaps)
    want = {("a", rows[0][1]): (None, True), ("a", day(1)): (True, False), ("a", day(2, 28)): (True, False), ("a", day(3)): (False, False), ("a", day(9)): (True, False), ("b", day(3)): (True, False), ("c", day(3)): (False, False), (None, day(3)): (False, False)}
    assert got.count() == 9 and all((r.member, r.survivorship_biased) == want[r.symbol, r.session] for r in got.collect())
    empty = universe.with_membership(spark.createDataFrame(rows, "symbol string, session date"), snaps.limit(0))
    assert all((r.member, r.survivorship_biased) == (None, True) for r in empty.collect())


def test_shortlists_of_users_without_a_watchlist_and_their_alerts(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    watch = spark.createDataFrame([(1, "s1"), (1, "s9"), (9, "s2")], "user_id long, symbol string")
    listed = spark.createDataFrame([(f"s{i}",) for i in range(8)], "symbol string")
    planned = spark.createDataFrame([(f"s{i}", "HOLD" if i == 3 else "BUY", float(100 - i % 4), dt.datetime(2026, 1, 5), 10.0 if i != 4 else None, 9.0, 11.0, 12.0) for i in range(10)], "symbol string, signal string, confidence double, ts timestamp_ntz, entry double, stop_loss double, target1 double, target2 double")
    best, summary = alerts.swing_shortlist(users, watch, listed, planned, alerts.Gates(swing_confidence=98, swing_per_user=3))
    assert sorted((r.user_id, r.place, r.symbol) for r in best.collect()) == [(1, 1, "s1"), (1, 2, "s9"), (2, 1, "s0"), (2, 2, "s4"), (2, 3, "s1"), (3, 1, "s0"), (3, 2, "s4"), (3, 3, "s1")]
    assert {r.user_id: (r.scanned, r.actionable, r.below, r.cut) for r in summary.collect()} == {1: (2, 2, 0, 0), 2: (8, 6, 1, 3), 3: (8, 6, 1, 3)}
    first = alerts.swing_alerts(best)
    assert sorted((r.user_id, r.symbol) for r in first.collect()) == [(1, "s1"), (1, "s9"), (2, "s0"), (2, "s1"), (3, "s0"), (3, "s1")]  # s4 has no plan
    assert alerts.swing_alerts(best, first).count() == 0


def test_tasks_of_a_large_table_hold_a_bounded_number_of_rows(spark):
    from tickloom.functions import indicators
    from tickloom.sources import bars

    rows = spark.range(4000).selectExpr("id % 1000 as symbol", "date'2026-01-01' as session", "timestamp_ntz'2026-01-01' + make_interval(0, 0, 0, 0, 0, id, 0) as ts", "id as rn")
    dealt = bars.by_key(rows, "symbol", 100)
    assert dealt.groupBy("symbol").agg({"rn": "count"}).count() == 1000 and dealt.rdd.getNumPartitions() >= 40
    assert bars.by_key(rows, "symbol", 4000) is rows
    last = indicators.latest(dealt)
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange") == 1
    assert sorted(r.rn for r in last.collect()) == list(range(3000, 4000))


def test_the_gate_of_tips_votes_once(spark, sf, monkeypatch):
    from tickloom.plans import queries

    written = []
    monkeypatch.setattr(queries, "saved", lambda df, what: written.append(df) or df.limit(0))
    queries._gated_tips(spark, sf)
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for df in written] == [1]
