"""Outcome and fold scenarios by hand, and small behaviours that have no query."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom import config
from tickloom.functions import indicators as ind
from tickloom.functions.supertrend import with_supertrend
from tickloom.operators import filters, history, metrics, outcomes, tips
from tickloom.sources import bars as br
from tickloom.sources import files

START = dt.datetime(2026, 1, 5, 9, 30)
BARS = "symbol string, ts timestamp_ntz, session date, open double, high double, low double, close double, volume double"


def frame(spark, rows, symbol="TEST", start=START, step=5):
    out = []
    for i, (o, h, lo, c) in enumerate(rows):
        ts = start + dt.timedelta(minutes=step * i)
        out.append((symbol, ts, ts.date(), float(o), float(h), float(lo), float(c), 1000.0))
    return br.numbered(spark.createDataFrame(out, BARS))


@pytest.mark.parametrize(
    ("later", "alert", "status", "pnl"),
    [
        ([(200, 231, 199, 229)], ("long", 190, 220, 230), "t2_hit", 12.5),
        ([(200, 203, 189, 190)], ("long", 190, 220, 230), "sl_hit", -5.0),
        ([(200, 221, 201, 215), (215, 216, 198, 199)], ("long", 190, 220, 230), "t1_then_breakeven", 5.0),
        ([(200, 221, 201, 215), (215, 222, 204, 212)], ("long", 190, 220, 230), "t1_then_squareoff", 8.0),
        ([(200, 201, 168, 171)], ("short", 210, 180, 170), "t2_hit", 12.5),
        ([(200, 221, 188, 200)], ("long", 190, 220, 230), "sl_hit", -5.0),
        ([(200, 204, 197, 203)] * 10, ("long", 190, 220, 230), "time_stop", 1.5),
        ([(200, 204, 197, 203)] * 3, ("short", 210, 180, 170), "squareoff_no_t1", -1.5),
        ([], ("long", 190, 220, 230), "no_data", None),
    ],
)
def test_first_touch(spark, later, alert, status, pnl):
    bars = frame(spark, [(200, 200, 200, 200), *later])
    way, sl, t1, t2 = alert
    a = spark.createDataFrame([(1, "TEST", way, START, 200.0, float(sl), float(t1), float(t2))], "alert_id long, symbol string, direction string, generated_at timestamp_ntz, entry double, stop_loss double, target1 double, target2 double")
    r = outcomes.resolve_intraday(a, bars).first()
    assert r.status == status
    assert r.pnl_pct == pytest.approx(pnl, abs=0.011) if pnl is not None else r.pnl_pct is None


def test_filters_on_outcomes_do_not_search_bars(spark):
    bars = frame(spark, [(200, 200, 200, 200), (200, 231, 199, 229)])
    a = spark.createDataFrame([(1, "TEST", "long", START, 200.0, 190.0, 220.0, 230.0)], "alert_id long, symbol string, direction string, generated_at timestamp_ntz, entry double, stop_loss double, target1 double, target2 double")
    kept = outcomes.resolve_intraday(a, bars).where("pnl_pct is not null and status = 't2_hit'")
    plan = kept._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in plan if x.lstrip(" :+-").startswith("Filter") and "lambda" in x]
    assert [r.alert_id for r in kept.collect()] == [1]


@pytest.mark.parametrize(("later", "status"), [([], "open"), ([(100, 101, 99, 100)], "open"), ([(100, 101, 97, 98)], "sl_hit"), ([(100, 107, 99, 106), (106, 110, 104, 109)], "t2_hit"), ([(100, 107, 99, 106), (106, 106, 99, 100)], "t1_then_breakeven")])
def test_swing_outcomes(spark, later, status):
    days = frame(spark, [(100, 100, 100, 100), *later], start=dt.datetime(2026, 1, 30), step=24 * 60)
    a = spark.createDataFrame([(1, "TEST", "long", dt.datetime(2026, 1, 30, 11), 100.0, 98.0, 106.0, 109.0)], "alert_id long, symbol string, direction string, generated_at timestamp_ntz, entry double, stop_loss double, target1 double, target2 double")
    assert [r.status for r in outcomes.resolve_swing(a, days).collect()] == [status]
    late = outcomes.resolve_swing(a, days.withColumn("session", F.date_add("session", 61)))
    assert late.first().status == "open"


def test_walk_forward_takes_the_best_parameter_of_the_folds_before(spark, sf):
    from tickloom.config import Gates
    from tickloom.operators.features import features
    from tickloom.plans.queries import ALL_DAY, TIME_STOP

    feat = features(br.intraday(spark, "/root/testdata/sf0.01")).persist()
    bands = [(0, 0.002, 0.02), (1, 0.004, 0.015), (2, 0.003, 0.012)]
    fold = {r.session: r.fold for r in history.folds(feat, 4).collect()}
    nets = {}
    for param, lo, hi in bands:
        for t in history.setup_history(feat, Gates(atr_low=lo, atr_high=hi), ALL_DAY, TIME_STOP).collect():
            nets.setdefault((fold[t.generated_at.date()], param), []).append(t.pnl_pct - config.COST_PCT)
    trades, log = history.walk_forward(feat, spark.createDataFrame(bands, "param int, lo double, hi double"), session=ALL_DAY, time_stop=TIME_STOP)
    got = {r.fold: r for r in log.collect()}
    for test in (2, 3):
        means = {p: (sum(x) / len(x), len(x)) for p, _, _ in bands if (x := nets.get((test - 2, p), []) + nets.get((test - 1, p), []))}
        best = max(means, key=lambda p: (means[p][0], -p))
        assert got[test].param == best
        assert (got[test].train_mean, got[test].n_train) == pytest.approx(means[best])
    assert trades.count() == sum(len(nets.get((f, r.param), [])) for f, r in got.items())
    feat.unpersist()


def test_folds_are_contiguous_and_round_half_to_even(spark):
    days = spark.range(10).select(F.date_add(F.lit("2026-01-05").cast("date"), F.col("id").cast("int")).alias("session"))
    got = [r.fold for r in history.folds(days, 4).orderBy("session").collect()]
    assert [got.count(k) for k in range(4)] == [2, 3, 3, 2]
    assert got == sorted(got)


def test_rsi_starts_without_a_change(spark):
    closes = [10, 11, 10.5, 12, 12, 11, 13]
    rows = ind.with_rsi(frame(spark, [(c, c, c, c) for c in closes]), 3, "r").orderBy("rn").collect()
    assert [None if r.r is None else round(r.r, 3) for r in rows] == [None, None, 66.667, 83.333, 75.0, 60.0, 66.667]
    flat = ind.with_rsi(frame(spark, [(5, 5, 5, 5)] * 5), 3, "r").collect()
    assert all(r.r is None for r in flat)


def test_ema_equals_the_recursion_over_many_blocks(spark):
    import random

    rng = random.Random(3)
    closes = [100 + rng.random() for _ in range(2500)]
    rows = ind.with_emas(frame(spark, [(c, c, c, c) for c in closes]), {"a": ("close", 5), "b": ("close", 50)}).orderBy("rn").collect()
    a = b = closes[0]
    for r, c in zip(rows, closes, strict=True):
        if r.rn > 1:
            a, b = a + (c - a) * 2 / 6, b + (c - b) * 2 / 51
        assert r.a == pytest.approx(a, abs=1e-9)
        assert r.b == pytest.approx(b, abs=1e-9)


def test_features_do_not_look_ahead(spark, sf):
    from tickloom.operators.features import features

    bars = br.intraday(spark, sf)
    cut = bars.where("session < date'2024-01-15'")
    both = features(bars).where("session < date'2024-01-15'").select("symbol", "rn", F.round("ema20", 8), F.round("vwap_slope", 8), "rsi14", "gap_pct")
    assert both.exceptAll(features(cut).select("symbol", "rn", F.round("ema20", 8), F.round("vwap_slope", 8), "rsi14", "gap_pct")).count() == 0


def test_round_numbers(spark):
    rows = spark.createDataFrame([(999.0, "long"), (1001.0, "short"), (1001.0, "long"), (1250.0, "long")], "close double, d string")
    got = [r[0] for r in rows.select(filters.round_code(F.col("close"), F.col("d"), 0.003)).collect()]
    assert got == ["round_number", "round_number", None, None]


def test_tips(spark):
    m = [("c", 1, "Buy ACME at 412.5 stop 405 target: 430"), ("c", 2, "BUY or SELL ACME"), ("c", 3, "ACME results"), ("c", 4, "go short NIFTY TCS cmp 3500.5 T2 3300")]
    messages = spark.createDataFrame([(*x, START) for x in m], "channel string, msg_id long, text string, ts timestamp_ntz")
    universe = spark.createDataFrame([("ACME",), ("TCS",)], "symbol string")
    got = {r.msg_id: (r.symbol, r.action, r.entry, r.target, r.target2, r.stop_loss) for r in tips.extract_tips(messages, universe).collect()}
    assert got == {1: ("ACME", "BUY", 412.5, 430.0, None, 405.0), 4: ("TCS", "SELL", 3500.5, None, 3300.0, None)}


def test_risk_of_equal_returns_is_unknown(spark):
    r = spark.createDataFrame([(1.0,), (1.0,)], "net double").agg(*metrics.risk()).first()
    assert (r.sharpe, r.t_stat, r.sortino) == (None, None, None)


def test_drawdown(spark):
    rows = [(i, "x", START + dt.timedelta(days=i), v + config.COST_PCT) for i, v in enumerate((1.0, -2.0, 3.0, -1.0))]
    t = spark.createDataFrame(rows, "alert_id long, symbol string, generated_at timestamp_ntz, pnl_pct double")
    assert metrics.max_drawdown(t).first().max_drawdown == pytest.approx(2.0)


def test_files(spark, tmp_path):
    (tmp_path / "d.csv").write_text("SYMBOL , SERIES, DELIV_PER\nabc , EQ, 55.5\nabc, EQ,60\nxyz, BE, 10\nq, EQ, -\n")
    assert [tuple(r) for r in files.delivery(spark, str(tmp_path / "d.csv"), "2026-01-05").select("symbol", "delivery_pct").collect()] == [("ABC", 60.0)]
    (tmp_path / "e.json").write_text('{"x": 1, "data": [{"symbol": "abc", "date": "05-Feb-2026", "purpose": "Financial Results"}, {"symbol": "b", "date": "2026-02-01", "purpose": "Dividend"}]}')
    (tmp_path / "f.json").write_text('[{"symbol": "b", "date": "03-02-2026", "bm_desc": "results"}, {"symbol": "c", "date": "soon", "bm_desc": "results"}]')
    assert [tuple(r) for r in files.results_calendar(spark, str(tmp_path / "e.json")).collect()] == [("ABC", dt.date(2026, 2, 5))]
    assert [tuple(r) for r in files.results_calendar(spark, str(tmp_path / "f.json")).collect()] == [("B", dt.date(2026, 2, 3))]
    with pytest.raises(ValueError, match="unknown interval"):
        br.read_bars(spark, str(tmp_path), "7m")


def plain_swing(alert, bars, horizon):
    """The first event of an alert and the one after it, bar by bar."""
    _, _, way, made, entry, sl, t1, t2 = alert
    up = way == "long"
    over, under = (lambda b, x: b[4] >= x if up else b[5] <= x), (lambda b, x: b[5] <= x if up else b[4] >= x)
    reached = False
    for b in bars:
        if not made.date() < b[2] <= made.date() + dt.timedelta(days=horizon):
            continue
        if not reached:
            if under(b, sl):
                return "sl_hit", b[1]
            reached = over(b, t1)
            if reached and over(b, t2):
                return "t2_hit", b[1]
        elif over(b, t2):
            return "t2_hit", b[1]
        elif under(b, entry):
            return "t1_then_breakeven", b[1]
    return "open", None


@pytest.mark.parametrize(("per_day", "minutes"), [(1, 1440), (40, 1)])
def test_swing_outcomes_meet_few_blocks_and_equal_a_walk_over_all_bars(spark, per_day, minutes):
    import random

    rng, rows, price = random.Random(7), [], 100.0
    for d in range(150):
        for k in range(per_day):
            o, price = price, price * (1 + rng.gauss(0, 0.012 / per_day**0.5))
            ts = dt.datetime(2026, 1, 20) + dt.timedelta(days=d, minutes=minutes * k)
            rows.append(("T", ts, ts.date(), o, max(o, price) * 1.001, min(o, price) * 0.999, price, 1.0))
    made = []
    for i, r in enumerate(rng.choices(rows, k=300)):
        side, unit = rng.choice([1, -1]), r[6] * rng.choice([0.01, 0.04, 0.15])
        made.append((i, "T", "long" if side == 1 else "short", r[1] + dt.timedelta(minutes=1), r[6], r[6] - side * unit, r[6] + 2 * side * unit, r[6] + 3 * side * unit))
    alerts = spark.createDataFrame(made, "alert_id long, symbol string, direction string, generated_at timestamp_ntz, entry double, stop_loss double, target1 double, target2 double")
    bars = spark.createDataFrame(rows, BARS)
    got = {r.alert_id: (r.status, r.exit_time) for r in outcomes.resolve_swing(alerts, bars, 45).collect()}
    want = {a[0]: plain_swing(a, rows, 45) for a in made}
    assert got == want and {s for s, _ in want.values()} == {"sl_hit", "t2_hit", "t1_then_breakeven", "open"}
    met = [df.count() for df in outcomes.narrowed(alerts, outcomes.extremum_blocks(bars), 45)]
    assert sum(met) < 5 * len(made)


def test_supertrend_equals_the_bar_by_bar_rule(spark):
    import random

    rng, rows, price = random.Random(5), [], 100.0
    for k in range(400):
        o, price = price, price * (1 + rng.gauss(0, 0.01) * (5 if k % 17 == 0 else 1))
        rows.append((o, max(o, price), min(o, price), price))
    out = with_supertrend(frame(spark, rows), 5, 0.4)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.orderBy("rn").collect()
    trs = [r[1] - r[2] if k == 0 else max(r[1] - r[2], abs(r[1] - rows[k - 1][3]), abs(r[2] - rows[k - 1][3])) for k, r in enumerate(rows)]
    was = up_was = lo_was = None
    way, carried = 1, 0
    for k, (r, g) in enumerate(zip(rows, got, strict=True)):
        atr = sum(trs[k - 4 : k + 1]) / 5 if k >= 4 else None
        up, lo = (None, None) if atr is None else ((r[1] + r[2]) / 2 + 0.4 * atr, (r[1] + r[2]) / 2 - 0.4 * atr)
        if k and up_was is not None:
            carried += was > up_was or was < lo_was
            up, lo = max(up, up_was) if was > up_was else up, min(lo, lo_was) if was < lo_was else lo
            way = 1 if r[3] > up_was else -1 if r[3] < lo_was else way
        line = (lo if way == 1 else up) if k else None
        assert g.st_dir == way and (g.st_line == pytest.approx(line) if line is not None else g.st_line is None), k
        was, up_was, lo_was = r[3], up, lo
    assert carried > 30


def test_short_histories_are_not_replayed(spark):
    rows = frame(spark, [(100, 101, 99, 100)] * 39, "S").unionByName(frame(spark, [(100, 101, 99, 100)] * 40, "L"))
    assert [r.symbol for r in history.long_enough(rows).select("symbol").distinct().collect()] == ["L"]


def test_values_of_the_day_before(spark):
    from tickloom.operators import score

    d = lambda k: dt.date(2026, 1, k)
    days = spark.createDataFrame([("A", d(5), 1), ("A", d(6), 2), ("B", d(6), 9), ("A", d(9), None)], "symbol string, session date, v int")
    rows = spark.createDataFrame([("A", d(5), 0), ("A", d(6), 1), ("A", d(6), 2), ("A", d(8), 3), ("B", d(6), 4), ("C", d(7), 5), ("A", d(12), 6)], "symbol string, session date, `__day` int")
    got = {r["__day"]: r.v for r in score.of_day_before(rows, days, ["v"]).collect()}
    assert got == {0: None, 1: 1, 2: 1, 3: 2, 4: None, 5: None, 6: None}


def test_alerts_on_daily_bars_move_once_to_arrays_of_quarters(spark, monkeypatch):
    import random

    def refuse(*_):
        raise AssertionError("blocks are not needed for daily bars")

    monkeypatch.setattr(outcomes, "narrowed", refuse)
    rng, rows, price = random.Random(3), [], 100.0
    for d in range(200):
        o, price = price, price * (1 + rng.gauss(0, 0.012))
        ts = dt.datetime(2025, 10, 20) + dt.timedelta(days=d)
        rows.append(("T", ts, ts.date(), o, max(o, price) * 1.001, min(o, price) * 0.999, price, 1.0))
    for horizon in (60, 95):
        made = []
        for i, r in enumerate(rng.choices(rows, k=200)):
            side, unit = rng.choice([1, -1]), r[6] * rng.choice([0.01, 0.04, 0.15])
            made.append((i, "T", "long" if side == 1 else "short", r[1], r[6], r[6] - side * unit, r[6] + 2 * side * unit, r[6] + 3 * side * unit))
        alerts = spark.createDataFrame([*made, (999, "none", *made[0][2:])], "alert_id long, symbol string, direction string, generated_at timestamp_ntz, entry double, stop_loss double, target1 double, target2 double")
        got = {r.alert_id: (r.status, r.exit_time) for r in outcomes.resolve_swing(alerts, spark.createDataFrame(rows, BARS), horizon).collect()}
        assert got == {a[0]: plain_swing(a, rows, horizon) for a in made} | {999: ("open", None)}
