"""The registered queries of the market engine, one or more for each operator, over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.config import GATES, PASS, SWING_CATEGORIES, Gates, Session
from tickloom.functions import indicators as ind
from tickloom.functions.supertrend import with_supertrend
from tickloom.operators import alerts as al
from tickloom.operators import features as ft
from tickloom.operators import filters as fl
from tickloom.operators import history as hi
from tickloom.operators import metrics as me
from tickloom.operators import outcomes as oc
from tickloom.operators import score as sc
from tickloom.operators import signals as sg
from tickloom.operators import tips as tp
from tickloom.operators import universe as un
from tickloom.plans.registry import query, r, rounded, rsql
from tickloom.sources import bars as br
from tickloom.sources import files as fi
from tickloom.sources.shared import saved

KEY = ["symbol", "session", "rn"]
CATEGORIES = ["scan", "manual_intraday", "swing_auto", "manual_swing", "channel_tip", "channel_call"]
TIME_STOP = "180 minutes"
ALL_DAY = Session(0, 1439, 0, 1440, 0, 0, 180)


def _feat(spark: SparkSession, sf: str) -> DataFrame:
    return ft.features(br.intraday(spark, sf))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return sc.score(ft.with_relative_volume(_feat(spark, sf)))


def _voted(spark: SparkSession, sf: str) -> DataFrame:
    return sg.vote(br.daily(spark, sf))


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts at every bar after the warm-up, of each direction and category in turn."""
    rn, turn = F.col("rn"), F.floor(F.col("rn") / 2)
    rows = _feat(spark, sf).where("rn > 30").withColumn("direction", F.when(rn % 2 == 0, "long").otherwise("short"))
    rows = sg.with_levels(rows).withColumn("category", F.element_at(F.array(*map(F.lit, CATEGORIES)), (turn % 6 + 1).cast("int")))
    setup = F.when(turn % 6 == 0, F.concat(F.lit("score"), (75 + rn % 25).cast("string"))).when(turn % 6 == 5, F.concat(F.lit("@ch"), (rn % 3).cast("string"))).otherwise("A")
    return rows.select(F.concat_ws(":", "symbol", rn.cast("string")).alias("alert_id"), "symbol", F.col("session").alias("trade_date"), F.col("ts").alias("generated_at"), "entry", "stop_loss", "target1", "target2", "direction", "category", F.when(turn % 5 != 0, rn % 3).cast("long").alias("user_id"), setup.alias("setup"))


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return oc.resolve_intraday(_alerts(spark, sf), br.intraday(spark, sf), TIME_STOP)


# --- bars and indicators ---------------------------------------------------------------------------------------


@query("SELECT symbol, session, ts, rn, session_no, bar_no, open, high, low, close, volume FROM bar")
def bars_1h(spark, sf):
    return br.intraday(spark, sf).select("symbol", "session", "ts", "rn", "session_no", "bar_no", "open", "high", "low", "close", "volume")


@query("SELECT symbol, session, rn, open, high, low, close, volume FROM day")
def bars_daily(spark, sf):
    return br.daily(spark, sf).select("symbol", "session", "rn", "open", "high", "low", "close", "volume")


@query("SELECT symbol, count(*) AS n_bars, date_diff('day', min(session), max(session))+1 AS span_days, date_diff('day', min(session), max(session))+1 < 0.6*3650 AS is_short FROM day GROUP BY symbol")
def coverage_check(spark, sf):
    return br.coverage(br.daily(spark, sf), 3650)


@query("SELECT symbol, session, rn, close FROM day WHERE session BETWEEN DATE '1998-06-30' - 90 AND DATE '1998-06-30'")
def period_3mo(spark, sf):
    return br.in_period(br.daily(spark, sf), "3mo", "1998-06-30").select(*KEY, "close")


@query(f"SELECT symbol, session, rn, sma_cross, {rsql('sma_short', 'sma_long')} FROM d3")
def sma_cross(spark, sf):
    return rounded(_voted(spark, sf), keep=[*KEY, "sma_cross"], values=["sma_short", "sma_long"])


@query(f"SELECT ema.symbol, ema.rn, {rsql('ema9=e9', 'ema20=e20', 'ema50=e50', digits=5)} FROM ema")
def ema_9_20_50(spark, sf):
    return rounded(_feat(spark, sf), keep=["symbol", "rn"], values=["ema9", "ema20", "ema50"], digits=5)


@query(f"SELECT symbol, rn, {rsql('macd', 'macd_signal=sig', 'macd_hist=macd-sig', digits=4)} FROM dsig")
def macd_12_26_9(spark, sf):
    return rounded(ind.with_macd(br.daily(spark, sf)), keep=["symbol", "rn"], values=["macd", "macd_signal", "macd_hist"], digits=4)


@query(f"SELECT symbol, session, rn, {rsql('rsi14')} FROM feat")
def rsi_14(spark, sf):
    return rounded(ind.with_rsi(br.intraday(spark, sf)), keep=KEY, values=["rsi14"])


@query(f"SELECT symbol, session, rn, {rsql('upper=sma_short+2*dev', 'middle=sma_short', 'lower=sma_short-2*dev')} FROM d1")
def bollinger_20(spark, sf):
    u, m, lo = ind.bollinger("close", 20)
    return rounded(br.daily(spark, sf).withColumns({"upper": u, "middle": m, "lower": lo}), keep=KEY, values=["upper", "middle", "lower"])


@query(f"SELECT symbol, session, rn, {rsql('tr', 'atr14')} FROM f2")
def atr_14(spark, sf):
    return rounded(ind.with_atr(br.intraday(spark, sf)), keep=KEY, values=["tr", "atr14"])


@query(f"SELECT symbol, session, rn, {rsql('vwap', 'vwap_slope')} FROM feat")
def vwap_and_slope(spark, sf):
    return rounded(_feat(spark, sf), keep=KEY, values=["vwap", "vwap_slope"])




@query("""SELECT symbol, rn, st_dir, st_line FROM (WITH RECURSIVE raw AS (SELECT symbol, rn, close, (high+low)/2+0.6*a AS up, (high+low)/2-0.6*a AS lo FROM (SELECT *, CASE WHEN count(*) OVER w = 10 THEN avg(tr) OVER w END AS a FROM f1 WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS 9 PRECEDING))),
  st(symbol, rn, close, up, lo, dir) AS (SELECT symbol, rn, close, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 1 FROM raw WHERE rn = 1 UNION ALL
  SELECT r.symbol, r.rn, r.close, CASE WHEN r.up IS NOT NULL AND st.close > st.up THEN greatest(r.up, st.up) ELSE r.up END, CASE WHEN r.lo IS NOT NULL AND st.close < st.lo THEN least(r.lo, st.lo) ELSE r.lo END,
  CASE WHEN r.close > st.up THEN 1 WHEN r.close < st.lo THEN -1 ELSE st.dir END FROM st JOIN raw r ON r.symbol = st.symbol AND r.rn = st.rn+1)
  SELECT symbol, rn, dir AS st_dir, CASE WHEN rn > 1 THEN round(CASE WHEN dir = 1 THEN lo ELSE up END, 6)+0.0 END AS st_line FROM st)""")
def supertrend_10(spark, sf):
    out = with_supertrend(br.intraday(spark, sf).select("symbol", "session", "ts", "rn", "open", "high", "low", "close"), 10, 0.6)
    return out.select("symbol", "rn", "st_dir", r("st_line").alias("st_line"))


@query(f"SELECT symbol, session, rn, swing_low, swing_high, {rsql('vol_ratio')} FROM f2")
def swing_and_volume_ratio(spark, sf):
    return rounded(_feat(spark, sf), keep=[*KEY, "swing_low", "swing_high"], values=["vol_ratio"])


@query("SELECT symbol, session, rn, orb3_high, orb3_low, orb6_high, orb6_low FROM f2")
def orb_levels(spark, sf):
    return _feat(spark, sf).select(*KEY, "orb3_high", "orb3_low", "orb6_high", "orb6_low")


@query(f"SELECT symbol, session, rn, best.d AS orb_dir, -best.m AS orb_window, {rsql('orb_strength=best.s')} FROM brk")
def orb_breakout(spark, sf):
    return rounded(sc.breakout(_feat(spark, sf)), keep=[*KEY, "orb_dir", "orb_window"], values=["orb_strength"])


@query(f"SELECT symbol, session, rn, {rsql('gap_pct', 'from_open=(close-session_open)/nullif(session_open,0)*100', 'from_prev=(close-prev_close)/nullif(prev_close,0)*100')} FROM feat")
def gap_and_change(spark, sf):
    f, c = _feat(spark, sf), F.col
    f = f.withColumns({"from_open": F.try_divide(c("close") - c("session_open"), c("session_open")) * 100, "from_prev": F.try_divide(c("close") - c("prev_close"), c("prev_close")) * 100})
    return rounded(f, keep=KEY, values=["gap_pct", "from_open", "from_prev"])


@query(f"SELECT symbol, session_no, bar_no, {rsql('rvol')} FROM rv")
def rvol(spark, sf):
    return rounded(ft.relative_volume(br.intraday(spark, sf)), keep=["symbol", "session_no", "bar_no"], values=["rvol"])


@query("SELECT symbol, session, ts, CASE WHEN close > vwap AND close > ema20 THEN 'bullish' WHEN close < vwap AND close < ema20 THEN 'bearish' ELSE 'flat' END AS trend FROM feat WHERE bar_no >= 3")
def index_trend(spark, sf):
    return ft.index_trend(_feat(spark, sf))


@query(f"SELECT symbol, close AS last, prev_close AS prev, {rsql('change=close-prev_close', 'change_pct=(close-prev_close)/nullif(prev_close,0)*100')}, day_high, day_low FROM f2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1 AND prev_close IS NOT NULL")
def index_snapshot(spark, sf):
    s = ft.snapshot(br.intraday(spark, sf))
    return s.select("symbol", "last", "prev", r("change").alias("change"), r("change_pct").alias("change_pct"), "day_high", "day_low")


@query("SELECT event_id, ts + INTERVAL 330 MINUTE AS ts, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS session FROM events")
def market_zone(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.to_date("ts").alias("session"))
    return br.in_market_zone(rows)


@query("SELECT n_name AS index_name, symbol, session, rn, close FROM nation JOIN day ON symbol = n_nationkey")
def index_candles(spark, sf):
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("NATION"), F.col("n_nationkey").cast("string")).alias("alias"), F.concat(F.lit("^"), F.col("n_nationkey").cast("string")).alias("ticker"), F.col("n_name").alias("display"))
    names = n.select(F.lower("alias").alias("symbol")).unionByName(n.select(F.concat(F.lit("SUP"), "alias").alias("symbol")))
    bars = br.daily(spark, sf).withColumn("symbol", F.concat(F.lit("^"), F.col("symbol").cast("string")))
    out = un.index_candles(names, n, bars)
    return out.select("index_name", F.substring("symbol", 2, 20).cast("long").alias("symbol"), "session", "rn", "close")


@query("SELECT symbol, session, rn, close FROM bar QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1")
def last_bar(spark, sf):
    return ind.latest(br.intraday(spark, sf)).select(*KEY, "close")


@query(f"SELECT symbol, session, rn, {rsql('high_52w=h', 'low_52w=l')}, CASE WHEN h > 0 AND (h-close)/h <= 0.03 THEN 'high' WHEN l > 0 AND (close-l)/l <= 0.03 THEN 'low' END AS near FROM (SELECT *, max(high) OVER w AS h, min(low) OVER w AS l FROM day WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS 251 PRECEDING)) WHERE rn >= 30")
def near_52w(spark, sf):
    return rounded(sc.near_extremes(br.daily(spark, sf)), keep=[*KEY, "near"], values=["high_52w", "low_52w"])


# --- gates -----------------------------------------------------------------------------------------------------

TIME_CODE = "CASE WHEN isodow(ts) >= 6 THEN 'weekend' WHEN hour(ts)*60+minute(ts) < 570 THEN 'before_entry' WHEN hour(ts)*60+minute(ts) BETWEEN 720 AND 809 THEN 'lunch' WHEN hour(ts)*60+minute(ts) >= 870 THEN 'after_entry' END"


@query(f"SELECT symbol, ts, event_id, {TIME_CODE} AS code, {TIME_CODE} IS NULL AS in_window, isodow(ts) < 6 AND CAST(ts AS TIME) >= TIME '09:15:00' AND date_trunc('second', ts)::TIME <= TIME '15:30:00' AS is_open FROM tick")
def entry_window(spark, sf):
    ts = F.col("ts")
    return br.event_ticks(spark, sf).select("symbol", "ts", "event_id", fl.time_code(ts).alias("code"), fl.in_entry_window(ts).alias("in_window"), fl.market_open(ts).alias("is_open"))


@query("SELECT symbol, session, rn, CASE WHEN near_long THEN 'round_number' END AS long_code, CASE WHEN near_short THEN 'round_number' END AS short_code FROM codes")
def round_number(spark, sf):
    code = lambda d: fl.round_code(F.col("close"), F.lit(d), GATES.round_distance)
    return _feat(spark, sf).select(*KEY, code("long").alias("long_code"), code("short").alias("short_code"))


@query("SELECT symbol, session, rn, c_atr, c_vol, c_slope, long_code, short_code FROM codes")
def universal_filters(spark, sf):
    return _feat(spark, sf).select(*KEY, fl.atr_code(F.lit(GATES.atr_low), F.lit(GATES.atr_high)).alias("c_atr"), fl.volume_code(GATES.volume_ratio).alias("c_vol"), fl.slope_code(GATES.vwap_slope).alias("c_slope"), fl.reject_code(F.lit("long")).alias("long_code"), fl.reject_code(F.lit("short")).alias("short_code"))


@query(f"SELECT *, round(n*100.0/sum(n) OVER (PARTITION BY symbol), 6)+0.0 AS share FROM (SELECT symbol, coalesce({TIME_CODE}, long_code) AS code, count(*) AS n FROM codes WHERE rn >= 30 AND coalesce({TIME_CODE}, long_code) IS NOT NULL GROUP BY ALL) h")
def reject_histogram(spark, sf):
    rows = _feat(spark, sf).where("rn >= 30").withColumn("code", fl.reject_code(F.lit("long"), check_time=True)).where("code is not null").groupBy("symbol", "code").agg(F.count("*").alias("n"))
    return rows.withColumn("share", r(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy("symbol"))))


@query("SELECT session, code, n, place FROM (SELECT session, long_code AS code, count(*) AS n, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, long_code) AS place FROM codes WHERE long_code IS NOT NULL GROUP BY session, long_code) WHERE place <= 5")
def quiet_day_reasons(spark, sf):
    return me.top_reasons(_feat(spark, sf).withColumn("code", fl.reject_code(F.lit("long"))), ["session"], "code").select("session", "code", "n", "place")


@query("SELECT symbol, session, ts, close, status, CASE WHEN status = 'skip' THEN long_code END AS reason, CASE WHEN status = 'signal' THEN direction END AS direction FROM (SELECT c.*, s.direction, CASE WHEN c.rn < 30 THEN 'insufficient' WHEN c.long_code IS NOT NULL THEN 'skip' WHEN s.direction IS NOT NULL THEN 'signal' ELSE 'no_setup' END AS status FROM codes c LEFT JOIN (SELECT symbol, rn, direction FROM seta) s ON s.symbol = c.symbol AND s.rn = c.rn QUALIFY row_number() OVER (PARTITION BY c.symbol ORDER BY c.rn DESC) = 1)")
def scan_status(spark, sf):
    return sg.scan_status(_feat(spark, sf), fl.reject_code(F.lit("long")))


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN rn < 30 THEN 'insufficient' WHEN long_code IS NOT NULL THEN 'skip' ELSE 'ok' END AS status FROM codes) GROUP BY status")
def scan_status_counts(spark, sf):
    s = F.when(F.col("rn") < 30, "insufficient").when(fl.reject_code(F.lit("long")).isNotNull(), "skip").otherwise("ok")
    return _feat(spark, sf).groupBy(s.alias("status")).agg(F.count("*").alias("n"))


# --- vote, plan, levels, setups --------------------------------------------------------------------------------


@query(f"SELECT symbol, session, rn, vote_sma, vote_rsi, vote_macd, vote_bb, signal, {rsql('confidence', 'change_pct', 'rsi', digits=4)} FROM dv")
def vote_signal(spark, sf):
    return rounded(_voted(spark, sf), keep=[*KEY, "vote_sma", "vote_rsi", "vote_macd", "vote_bb", "signal"], values=["confidence", "change_pct", "rsi"], digits=4)


@query("SELECT symbol, session, signal, confidence, 4 AS n_votes, CASE WHEN sma_cross <> 0 THEN 'SMA Crossover' ELSE 'SMA Trend' END AS first_name, vote_sma AS first_vote FROM dl")
def vote_latest(spark, sf):
    v = ind.latest(_voted(spark, sf)).withColumn("i", sg.indicator_list())
    return v.select("symbol", "session", "signal", "confidence", F.size("i").alias("n_votes"), F.col("i")[0]["name"].alias("first_name"), F.col("i")[0]["vote"].alias("first_vote"))


@query(f"SELECT symbol, session, rn, signal, CASE WHEN risk/close*100 < 1.5 THEN 'Low' WHEN risk/close*100 < 3.5 THEN 'Medium' WHEN risk IS NOT NULL THEN 'High' END AS risk_level, {rsql('stop_loss=stop', 'target1=close+side*risk*1.5', 'target2=close+side*risk*3.0', digits=7)}, round(CASE WHEN signal='HOLD' THEN recent_high*1.002 END, 7)+0.0 AS buy_breakout, round(CASE WHEN signal='HOLD' THEN recent_low*0.998 END, 7)+0.0 AS sell_breakdown FROM plan")
def trade_plan(spark, sf):
    return rounded(sg.trade_plan(_voted(spark, sf)), keep=[*KEY, "signal", "risk_level"], values=["stop_loss", "target1", "target2", "buy_breakout", "sell_breakdown"], digits=7)


@query(f"SELECT symbol, session, rn, direction, {rsql('entry=close', 'stop_loss=close-side*unit', 'target1=close+2*side*unit', 'target2=close+3*side*unit', 'risk=unit', 'rr1=2.0', 'sl_pct=unit/close*100', digits=4)} FROM (SELECT *, CASE WHEN rn%2=0 THEN 'long' ELSE 'short' END AS direction, CASE WHEN rn%2=0 THEN 1 ELSE -1 END AS side FROM lvl)")
def trade_levels(spark, sf):
    rows = sg.signal_metrics(sg.with_levels(_feat(spark, sf).withColumn("direction", F.when(F.col("rn") % 2 == 0, "long").otherwise("short"))))
    return rounded(rows, keep=[*KEY, "direction"], values=["entry", "stop_loss", "target1", "target2", "risk", "rr1", "sl_pct"], digits=4)


@query(f"SELECT symbol, session, rn, direction, 3 AS n_confluences, {rsql('stop_loss=close-side*unit', 'target2=close+3*side*unit', digits=4)} FROM seta")
def setup_a(spark, sf):
    rows = sg.setup_a(_feat(spark, sf)).withColumn("n_confluences", F.size("confluences"))
    return rounded(rows, keep=[*KEY, "direction", "n_confluences"], values=["stop_loss", "target2"], digits=4)


# --- score -----------------------------------------------------------------------------------------------------


@query("SELECT symbol, session, rn, direction, pts_gap, pts_rvol, pts_vwap, pts_ema, pts_orb, pts_vol, score FROM sc")
def score_components(spark, sf):
    return _scored(spark, sf).select(*KEY, "direction", "pts_gap", "pts_rvol", "pts_vwap", "pts_ema", "pts_orb", "pts_vol", "score")


@query(f"SELECT symbol, session, rn, CASE WHEN score >= 80 THEN CASE WHEN direction = 'long' THEN 'Strong Buy' ELSE 'Strong Sell' END WHEN score >= 60 THEN 'Watchlist' ELSE 'Avoid' END AS rating, CASE direction WHEN 'none' THEN 50 WHEN 'long' THEN lean ELSE 100-lean END AS bull_conviction, orb_window FROM (SELECT *, CAST(round_even(least(90.0, greatest(50.0, 45+score*0.42)), 0) AS INT) AS lean FROM sc)")
def score_rating(spark, sf):
    return _scored(spark, sf).select(*KEY, "rating", "bull_conviction", "orb_window")


@query("SELECT symbol, session, rn, score, list_sum(map_values(m)) AS total, cardinality(m) AS components FROM (SELECT *, MAP {'a': pts_gap, 'b': pts_rvol, 'c': pts_vwap, 'd': pts_ema, 'e': pts_orb, 'f': pts_vol} AS m FROM sc)")
def score_breakdown(spark, sf):
    rows = _scored(spark, sf).withColumn("m", sc.breakdown())
    return rows.select(*KEY, "score", F.aggregate(F.map_values("m"), F.lit(0), lambda a, x: a + x).cast("long").alias("total"), F.size("m").alias("components"))


REGIME = """SELECT s.*, coalesce(CASE WHEN s.direction = 'long' THEN t.up ELSE t.down END, true) AS regime_ok FROM sc s LEFT JOIN (SELECT ts, bool_or(close > vwap AND close > ema20) AS up, bool_or(close < vwap AND close < ema20) AS down FROM feat WHERE symbol = 'view' AND bar_no >= 3 GROUP BY ts) t ON t.ts = s.ts"""


def _regime(spark: SparkSession, sf: str) -> DataFrame:
    return sc.with_regime(_scored(spark, sf), ft.index_trend(_feat(spark, sf).where("symbol = 'view'")))


@query(f"SELECT symbol, session, rn, direction, regime_ok FROM ({REGIME})")
def regime_gate(spark, sf):
    return _regime(spark, sf).select(*KEY, "direction", "regime_ok")


RESULTS_DATES = "SELECT ['view','signup','click','error','purchase'][CAST(o_orderkey % 5 + 1 AS BIGINT)] AS symbol, DATE '2024-01-01' + CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 60 AS INT) AS results_date FROM orders"
CALENDAR = "SELECT ['view','signup','click','error','purchase'][n_nationkey % 5 + 1] AS symbol, DATE '2024-01-01' + CAST(n_nationkey * 7 % 31 AS INT) AS results_date FROM nation"
EVENTS = f"SELECT s.*, date_diff('day', s.session, nxt) AS days_to_results, coalesce(NOT (date_diff('day', s.session, nxt) BETWEEN 0 AND 2), true) AS event_ok FROM ({REGIME}) s LEFT JOIN (SELECT session, symbol, min(results_date) AS nxt FROM (SELECT DISTINCT session, symbol FROM sc) JOIN ({CALENDAR}) USING (symbol) WHERE results_date >= session GROUP BY session, symbol) n ON n.symbol = s.symbol AND n.session = s.session"


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Results dates of the symbols, one for each nation."""
    n, names = spark.read.parquet(f"{sf}/nation.parquet"), F.array(*map(F.lit, ["view", "signup", "click", "error", "purchase"]))
    return n.select(F.element_at(names, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_nationkey") * 7 % 31).alias("results_date"))


@query(f"SELECT symbol, session, rn, days_to_results, event_ok FROM ({EVENTS})")
def event_gate(spark, sf):
    return sc.with_events(_scored(spark, sf), _results(spark, sf)).select(*KEY, "days_to_results", "event_ok")


@query(f"SELECT symbol, min(results_date) AS results_date FROM ({RESULTS_DATES}) WHERE results_date >= DATE '2024-01-15' GROUP BY symbol")
def next_results(spark, sf):
    o, names = spark.read.parquet(f"{sf}/orders.parquet"), F.array(*map(F.lit, ["view", "signup", "click", "error", "purchase"]))
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")) % 60
    dates = o.select(F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), day).alias("results_date"))
    return fi.next_results(dates, F.lit("2024-01-15").cast("date"))


def _delivery(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.read.parquet(f"{sf}/part.parquet")
    names = F.array(*map(F.lit, ["view", "signup", "click", "error", "purchase"]))
    rows = p.select(F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("symbol"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("p_partkey") % 31).cast("int")).alias("as_of"), F.when(F.col("p_size") > 10, F.col("p_size") * 1.5).alias("pct"), "p_partkey")
    return rows.groupBy("symbol", "as_of").agg(F.max_by("pct", "p_partkey").alias("delivery_pct"))


#: A symbol lacks its number on some days, on which other symbols have theirs.
DELIVERY = "SELECT symbol, as_of, CASE WHEN arg_max(p_size, p_partkey) > 10 THEN arg_max(p_size, p_partkey)*1.5 END AS delivery_pct FROM (SELECT ['view','signup','click','error','purchase'][CAST(p_partkey%5+1 AS BIGINT)] AS symbol, DATE '2024-01-01'+CAST(p_partkey%31 AS INT) AS as_of, p_size, p_partkey FROM part) GROUP BY symbol, as_of"
NEWEST = f"(SELECT b.session, max(as_of) AS best FROM (SELECT DISTINCT session FROM sc) b JOIN (SELECT DISTINCT as_of FROM ({DELIVERY}) WHERE delivery_pct IS NOT NULL) d ON as_of <= b.session AND as_of >= b.session-5 GROUP BY b.session)"


@query(f"SELECT s.symbol, s.session, s.rn, d.delivery_pct FROM sc s LEFT JOIN {NEWEST} n ON n.session = s.session LEFT JOIN ({DELIVERY}) d ON d.symbol = s.symbol AND d.as_of = n.best")
def delivery_lookup(spark, sf):
    return sc.with_delivery(_scored(spark, sf), _delivery(spark, sf)).select(*KEY, "delivery_pct")


@query(f"SELECT s.symbol, s.session, s.rn, concat_ws('; ', 'delivery ' || CAST(round_even(d.delivery_pct, 0) AS INT) || '%', CASE WHEN d.delivery_pct >= 60 THEN 'strong delivery' END) AS context, array_to_string(list_filter([CASE WHEN NOT s.regime_ok THEN 'counter-trend' END, CASE WHEN d.delivery_pct < 25 THEN 'low delivery' END, CASE WHEN NOT s.event_ok THEN 'results near' END], lambda x: x IS NOT NULL), '; ') AS notes FROM ({EVENTS}) s LEFT JOIN {NEWEST} n ON n.session = s.session LEFT JOIN ({DELIVERY}) d ON d.symbol = s.symbol AND d.as_of = n.best")
def context_notes(spark, sf):
    rows = sc.with_delivery(sc.with_events(_regime(spark, sf), _results(spark, sf)), _delivery(spark, sf))
    rows = sc.context_notes(rows)
    return rows.select(*KEY, F.array_join("context", "; ").alias("context"), F.array_join("notes", "; ").alias("notes"))


#: Daily rows of the intraday symbols: supertrend and extremes of the days so far.
DAYS = "SELECT symbol, session, row_number() OVER w AS rn, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, arg_min(open, ts) AS open FROM bar GROUP BY symbol, session WINDOW w AS (PARTITION BY symbol ORDER BY session)"
LAST_DAY = f"""(WITH RECURSIVE b AS ({DAYS}), t AS (SELECT *, greatest(high-low, abs(high-lag(close) OVER w), abs(low-lag(close) OVER w)) AS tr FROM b WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
  raw AS (SELECT symbol, session, rn, close, (high+low)/2+0.6*a AS up, (high+low)/2-0.6*a AS lo, CASE WHEN rn >= 10 THEN max(high) OVER x END AS hi52, CASE WHEN rn >= 10 THEN min(low) OVER x END AS lo52 FROM (SELECT *, CASE WHEN count(*) OVER w = 10 THEN avg(tr) OVER w END AS a FROM t WINDOW w AS (PARTITION BY symbol ORDER BY rn ROWS 9 PRECEDING)) WINDOW x AS (PARTITION BY symbol ORDER BY rn ROWS 251 PRECEDING)),
  st(symbol, session, rn, close, up, lo, dir, hi52, lo52) AS (SELECT symbol, session, rn, close, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), 1, hi52, lo52 FROM raw WHERE rn = 1 UNION ALL
  SELECT r.symbol, r.session, r.rn, r.close, CASE WHEN r.up IS NOT NULL AND st.close > st.up THEN greatest(r.up, st.up) ELSE r.up END, CASE WHEN r.lo IS NOT NULL AND st.close < st.lo THEN least(r.lo, st.lo) ELSE r.lo END, CASE WHEN r.close > st.up THEN 1 WHEN r.close < st.lo THEN -1 ELSE st.dir END, r.hi52, r.lo52 FROM st JOIN raw r ON r.symbol = st.symbol AND r.rn = st.rn+1)
  SELECT symbol, session, dir AS st_dir, hi52, lo52 FROM st)"""
CONTEXT = f"""SELECT e.symbol, e.session, e.rn, concat_ws('; ', CASE WHEN l.st_dir = 1 THEN 'supertrend bullish' WHEN l.st_dir = -1 THEN 'supertrend bearish' END, 'index ' || i.listed, CASE WHEN hi52 > 0 AND (hi52-close)/hi52 <= 0.03 THEN 'near 52-week high' WHEN lo52 > 0 AND (close-lo52)/lo52 <= 0.03 THEN 'near 52-week low' END, 'delivery ' || CAST(round_even(d.delivery_pct, 0) AS INT) || '%', CASE WHEN d.delivery_pct >= 60 THEN 'strong delivery' END) AS context,
  concat_ws('; ', CASE WHEN (l.st_dir = 1) <> (e.direction = 'long') THEN 'supertrend against direction' END, CASE WHEN NOT e.regime_ok THEN 'counter-trend' END, CASE WHEN d.delivery_pct < 25 THEN 'low delivery' END, CASE WHEN NOT e.event_ok THEN 'results near' END) AS notes
  FROM ({EVENTS}) e ASOF LEFT JOIN {LAST_DAY} l ON l.symbol = e.symbol AND l.session < e.session LEFT JOIN (SELECT ts, string_agg(symbol || ' ' || CASE WHEN close > vwap AND close > ema20 THEN 'bullish' WHEN close < vwap AND close < ema20 THEN 'bearish' ELSE 'flat' END, ', ' ORDER BY symbol) AS listed FROM feat WHERE symbol IN ('click', 'view') AND bar_no >= 3 GROUP BY ts) i ON i.ts = e.ts
  LEFT JOIN {NEWEST} n ON n.session = e.session LEFT JOIN ({DELIVERY}) d ON d.symbol = e.symbol AND d.as_of = n.best"""


@query(CONTEXT)
def context_of_the_day_before(spark, sf):
    days = br.numbered(br.bars_from_ticks(br.event_ticks(spark, sf), "1d"))
    days = with_supertrend(sc.extremes(days, least=1), 10, 0.6).withColumns({x: F.when(F.col("rn") >= 10, F.col(x)) for x in ("high_52w", "low_52w")})
    rows = sc.with_delivery(_gated(spark, sf), _delivery(spark, sf))
    rows = sc.with_index_list(rows, ft.index_trend(_feat(spark, sf).where("symbol in ('click', 'view')")))
    rows = sc.of_day_before(rows, days, ["st_dir", "high_52w", "low_52w"]).withColumn("near", sc.near())
    rows = sc.context_notes(rows)
    return rows.select(*KEY, F.array_join("context", "; ").alias("context"), F.array_join("notes", "; ").alias("notes"))


# --- selection, journal ----------------------------------------------------------------------------------------

LOW = Gates(min_score=45)
GATED = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS place FROM ({EVENTS}) WHERE score >= 45 AND regime_ok AND event_ok) WHERE place <= 5"


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    return sc.with_events(_regime(spark, sf), _results(spark, sf))


@query(f"SELECT session, CASE WHEN score < 45 THEN 'low_score' WHEN NOT regime_ok THEN 'counter_trend' WHEN NOT event_ok THEN 'results_near' ELSE 'ok' END AS reason, count(*) AS n FROM ({EVENTS}) GROUP BY ALL")
def gate_reasons(spark, sf):
    return _gated(spark, sf).groupBy("session", F.coalesce(sc.gate_reason(LOW), F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT symbol, session, rn, score, place FROM ({GATED})")
def autoscan_top5(spark, sf):
    return al.top_per_pass(_gated(spark, sf), LOW).select(*KEY, "score", "place")


FIRED = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, score DESC, symbol) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY symbol, direction, session ORDER BY ts) AS k FROM ({GATED})) WHERE k = 1) WHERE nth <= 3"


@query(f"SELECT symbol, trade_date, setup, direction, signal_key, {rsql('stop_loss', digits=4)} FROM (SELECT symbol, session AS trade_date, 'score' || score AS setup, direction, symbol || ':score:' || direction || ':' || session AS signal_key, close - CASE WHEN direction = 'long' THEN 1 ELSE -1 END*unit AS stop_loss FROM ({FIRED}))")
def daily_cap(spark, sf):
    out = al.autoscan(_gated(spark, sf), Gates(min_score=45, per_day=3))
    return rounded(out, keep=["symbol", "trade_date", "setup", "direction", "signal_key"], values=["stop_loss"], digits=4)


@query("SELECT symbol, session, rn, close FROM seta QUALIFY row_number() OVER (PARTITION BY symbol, session ORDER BY ts) = 1")
def dedup_first_per_session(spark, sf):
    return hi.first_signals(sg.setup_a(_feat(spark, sf)), ["symbol", "setup", "session"]).select(*KEY, "close")


def _watch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users, their watchlists and the universe: stand-ins made of customers, of the suppliers of their orders, and of a list of rich suppliers.

    An urgent order adds its suppliers, a low one removes them, and others tell nothing of
    what a customer watches, so many users watch nothing.
    """
    users = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at"), F.when(F.col("o_orderpriority") == "5-LOW", "remove").when(F.col("o_orderpriority") == "1-URGENT", "add").alias("action"))
    ev = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", F.col("l_suppkey").alias("symbol")).join(o.where("action is not null"), "l_orderkey").drop("l_orderkey")
    universe = spark.read.parquet(f"{sf}/supplier.parquet").where("s_acctbal > 8000").select(F.col("s_suppkey").alias("symbol"))
    return users, al.watchlists(ev), universe


WATCH_EVENTS = "SELECT o_custkey AS user_id, l_suppkey AS symbol, o_orderdate AS seen, o_orderpriority AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"
WATCH = f"SELECT a.user_id, a.symbol, min(a.seen) AS added_at FROM (SELECT * FROM ({WATCH_EVENTS}) WHERE p = '1-URGENT') a LEFT JOIN (SELECT user_id, symbol, max(seen) AS gone FROM ({WATCH_EVENTS}) WHERE p = '5-LOW' GROUP BY ALL) g ON g.user_id = a.user_id AND g.symbol = a.symbol WHERE gone IS NULL OR a.seen > gone GROUP BY a.user_id, a.symbol"
WATCHED = f"SELECT user_id, symbol FROM ({WATCH}) UNION ALL SELECT c_custkey, s_suppkey FROM customer CROSS JOIN supplier WHERE s_acctbal > 8000 AND c_custkey NOT IN (SELECT user_id FROM ({WATCH}))"


@query(WATCH)
def watchlist(spark, sf):
    return _watch(spark, sf)[1]


@query(WATCHED)
def watchlist_fallback(spark, sf):
    return al.watched_or_default(*_watch(spark, sf))


@query(f"SELECT user_id, symbol, signal, confidence, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, symbol) AS place FROM ({WATCHED}) w JOIN dl USING (symbol) WHERE signal IN ('BUY','SELL') AND confidence >= 50) WHERE place <= 5")
def swing_shortlist(spark, sf):
    best, _ = al.swing_shortlist(*_watch(spark, sf), ind.latest(_voted(spark, sf)), Gates(swing_confidence=50))
    return best.select("user_id", "symbol", "signal", "confidence", "place")


@query(f"SELECT user_id, count(*) AS scanned, count(*) FILTER (ok) AS actionable, count(*) FILTER (act AND NOT ok) AS below, greatest(count(*) FILTER (ok)-5, 0) AS cut FROM (SELECT *, signal IN ('BUY','SELL') AS act, signal IN ('BUY','SELL') AND confidence >= 75 AS ok FROM ({WATCHED}) w JOIN dl USING (symbol)) GROUP BY user_id")
def swing_summary(spark, sf):
    return al.swing_shortlist(*_watch(spark, sf), ind.latest(_voted(spark, sf)), Gates(swing_confidence=75))[1]


SHORTLIST = f"SELECT * FROM (SELECT user_id, p.*, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, symbol) AS place FROM ({WATCHED}) w JOIN (SELECT * FROM plan QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1) p USING (symbol) WHERE signal IN ('BUY','SELL') AND confidence >= 50) WHERE place <= 5"


@query(f"SELECT user_id, CAST(symbol AS VARCHAR) AS symbol, 'swing_auto' AS category, signal AS direction, session AS trade_date, 'swing:' || user_id || ':' || symbol || ':' || signal || ':' || session AS signal_key, {rsql('entry=close', 'stop_loss=stop', 'target1=close+side*risk*1.5', 'target2=close+side*risk*3.0', digits=5)} FROM ({SHORTLIST}) WHERE place > 1")
def swing_auto_alerts(spark, sf):
    planned = sg.trade_plan(ind.latest(_voted(spark, sf)))
    best, _ = al.swing_shortlist(*_watch(spark, sf), planned, Gates(swing_confidence=50))
    fired = al.swing_alerts(best.where("place = 1"))  # what an earlier run of the day has sent
    return rounded(al.swing_alerts(best, fired), keep=["user_id", "symbol", "category", "direction", "trade_date", "signal_key"], values=["entry", "stop_loss", "target1", "target2"], digits=5)


@query("SELECT c_custkey AS user_id, alert_id, symbol, direction FROM customer CROSS JOIN (SELECT * FROM al WHERE trade_date = DATE '2024-01-10' AND category = 'scan')")
def fanout(spark, sf):
    subs = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    return al.outbox(_alerts(spark, sf).where("trade_date = date'2024-01-10' and category = 'scan'"), subs)


@query(f"SELECT alert_id, symbol, trade_date, category, user_id, setup, direction, {rsql('entry', 'stop_loss', 'target1', 'target2', digits=4)} FROM al")
def alert_journal(spark, sf):
    return rounded(_alerts(spark, sf), keep=["alert_id", "symbol", "trade_date", "category", "user_id", "setup", "direction"], values=["entry", "stop_loss", "target1", "target2"], digits=4)


def _results_of(spark: SparkSession, sf: str, keep: str) -> DataFrame:
    return _outcomes(spark, sf).where(keep).select("alert_id", "status", "exit_price", "exit_time", "pnl_pct")


@query("SELECT al.alert_id, al.category, oc.status FROM al LEFT JOIN (SELECT * FROM oc WHERE status <> 'no_data') oc ON oc.alert_id = al.alert_id WHERE al.trade_date = DATE '2024-01-12' AND (al.user_id = 1 OR al.user_id IS NULL)")
def alerts_with_outcomes(spark, sf):
    out = al.with_outcomes(_alerts(spark, sf), _results_of(spark, sf, "status <> 'no_data'"), F.lit("2024-01-12").cast("date"), user_id=1)
    return out.select("alert_id", "category", "status")


@query("SELECT alert_id, symbol FROM al WHERE trade_date >= DATE '2024-01-31' - 20 AND alert_id NOT IN (SELECT alert_id FROM oc WHERE status IN ('sl_hit', 't2_hit', 'time_stop'))")
def open_alerts(spark, sf):
    return al.open_alerts(_alerts(spark, sf), _results_of(spark, sf, "status in ('sl_hit', 't2_hit', 'time_stop')"), F.lit("2024-01-31").cast("date"), 20).select("alert_id", "symbol")


@query("SELECT alert_id, category, status FROM oc WHERE user_id = 2 AND category IN ('swing_auto','manual_swing','channel_tip','channel_call')")
def resolved_alerts(spark, sf):
    return al.resolved_alerts(_alerts(spark, sf), _results_of(spark, sf, "true"), SWING_CATEGORIES, 2).select("alert_id", "category", "status")


@query("SELECT alert_id, status FROM oc WHERE user_id IS NOT NULL AND category IN ('swing_auto','manual_swing','channel_tip','channel_call') AND status IN ('t2_hit','t1_then_squareoff','t1_then_breakeven','sl_hit') AND rn3 <> 0".replace("rn3", "CAST(split_part(alert_id, ':', 2) AS BIGINT) % 3"))
def unnotified(spark, sf):
    done = _alerts(spark, sf).where("try_cast(split_part(alert_id, ':', 2) as bigint) % 3 = 0").select("alert_id")
    return al.unnotified(_alerts(spark, sf), _results_of(spark, sf, "true"), done, SWING_CATEGORIES, (*PASS, "sl_hit")).select("alert_id", "status")


@query("SELECT alert_id, version, status FROM (SELECT o_custkey AS alert_id, o_orderkey AS version, o_orderstatus AS status FROM orders) QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY version DESC) = 1")
def upsert_latest(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("alert_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    return al.latest_versions(o, "alert_id", "version")


@query("SELECT symbol, session, count(*) AS n FROM seta WHERE session >= DATE '2024-01-31' - 2 GROUP BY ALL")
def retention(spark, sf):
    return al.kept_days(sg.setup_a(_feat(spark, sf)), F.lit("2024-01-31").cast("date"), 2).groupBy("symbol", "session").agg(F.count("*").alias("n"))


# --- outcomes and performance ----------------------------------------------------------------------------------


@query(f"SELECT alert_id, status, exit_time, {rsql('exit_price', 'pnl_pct', digits=4)} FROM oc")
def resolve_intraday(spark, sf):
    return rounded(_outcomes(spark, sf), keep=["alert_id", "status", "exit_time"], values=["exit_price", "pnl_pct"], digits=4)


SWING_AL = "SELECT symbol || ':' || rn AS alert_id, symbol, session AS gen, close AS entry, close*0.99 AS sl, close*1.02 AS t1, close*1.03 AS t2 FROM day WHERE rn > 60"
#: An alert meets bars by symbol and calendar month, three of which its 60 days touch at most.
SWING_OC = f"""WITH sw_alert AS MATERIALIZED ({SWING_AL}), sw_day AS MATERIALIZED (SELECT symbol, session, high, low, CAST(date_trunc('month', session) AS DATE) AS month FROM day),
  sw_met AS MATERIALIZED (SELECT a.*, d.session, d.high, d.low FROM (SELECT *, CAST(date_trunc('month', gen+1) + to_months(CAST(k AS INT)) AS DATE) AS month FROM sw_alert CROSS JOIN (VALUES (0), (1), (2)) m(k)) a JOIN sw_day d ON d.symbol = a.symbol AND d.month = a.month WHERE d.session > a.gen AND d.session <= a.gen+60)
  SELECT alert_id, status, CAST(exit_time AS TIMESTAMP) AS exit_time, round(exit_price, 4)+0.0 AS exit_price, round(CASE WHEN status IN ('t2_hit','t1_then_breakeven') THEN ((exit_price-entry)/entry*100+(t1-entry)/entry*100)/2 ELSE (exit_price-entry)/entry*100 END, 4)+0.0 AS pnl_pct FROM (
  SELECT *, CASE status WHEN 'sl_hit' THEN sl WHEN 't2_hit' THEN t2 WHEN 't1_then_breakeven' THEN entry END AS exit_price, CASE status WHEN 'sl_hit' THEN tsl WHEN 't2_hit' THEN tt2 WHEN 't1_then_breakeven' THEN tbe END AS exit_time FROM (
  SELECT a.*, g.* EXCLUDE (alert_id), CASE WHEN tsl <= coalesce(tt1, tsl) THEN 'sl_hit' WHEN tt1 IS NULL THEN 'open' WHEN tt2 <= coalesce(tbe, tt2) THEN 't2_hit' WHEN tbe IS NOT NULL THEN 't1_then_breakeven' ELSE 'open' END AS status FROM sw_alert a LEFT JOIN
  (SELECT alert_id, any_value(tt1) AS tt1, min(session) FILTER (low <= sl) AS tsl, min(session) FILTER (session >= tt1 AND high >= t2) AS tt2, min(session) FILTER (session > tt1 AND low <= entry) AS tbe FROM (SELECT *, min(CASE WHEN high >= t1 THEN session END) OVER (PARTITION BY alert_id) AS tt1 FROM sw_met) GROUP BY alert_id) g USING (alert_id)))"""


def _swing_alerts(days: DataFrame) -> DataFrame:
    c = F.col("close")
    return days.where("rn > 60").select(F.concat_ws(":", F.col("symbol").cast("string"), F.col("rn").cast("string")).alias("alert_id"), "symbol", F.lit("long").alias("direction"), F.col("ts").alias("generated_at"), c.alias("entry"), (c * 0.99).alias("stop_loss"), (c * 1.02).alias("target1"), (c * 1.03).alias("target2"))


@query(SWING_OC)
def resolve_swing(spark, sf):
    days = br.daily(spark, sf)
    return rounded(oc.resolve_swing(_swing_alerts(days), days, 60), keep=["alert_id", "status", "exit_time"], values=["exit_price", "pnl_pct"], digits=4)


@query("SELECT alert_id, category, status FROM (SELECT alert_id, category, trade_date, status FROM oc WHERE category IN ('scan','manual_intraday') UNION ALL SELECT alert_id, category, trade_date, status FROM swo WHERE category NOT IN ('scan','manual_intraday')) WHERE trade_date >= DATE '2024-02-05' - 15 AND alert_id NOT IN (SELECT alert_id FROM oc WHERE status = 'sl_hit')")
def resolve_pending(spark, sf):
    a = _alerts(spark, sf).withColumn("direction", F.when(F.col("direction") == "long", "BUY").otherwise("SELL"))
    days = br.numbered(br.bars_from_ticks(br.event_ticks(spark, sf), "1d"))
    out = oc.resolve_pending(a, _results_of(spark, sf, "status = 'sl_hit'"), br.intraday(spark, sf), days, F.lit("2024-02-05").cast("date"), 15, TIME_STOP)
    return out.select("alert_id", "status").join(a.select("alert_id", "category"), "alert_id")


AGG = "count(pnl_pct) AS n, count(*) FILTER (pnl_pct IS NOT NULL AND ok) AS wins, count(*) FILTER (pnl_pct IS NOT NULL AND status='sl_hit') AS losses, count(*) FILTER (pnl_pct IS NOT NULL AND NOT ok AND status<>'sl_hit') AS neutral, round(coalesce(sum(pnl_pct),0)-0.13*count(pnl_pct), 4)+0.0 AS net, round(coalesce(count(*) FILTER (pnl_pct IS NOT NULL AND ok)*100.0/nullif(count(*) FILTER (pnl_pct IS NOT NULL AND (ok OR status='sl_hit')),0),0), 4)+0.0 AS win_rate, round(avg(CASE WHEN pnl_pct IS NOT NULL THEN date_diff('day', CAST(generated_at AS DATE), CAST(exit_time AS DATE)) END), 4)+0.0 AS avg_hold"
OK = "status IN ('t2_hit','t1_then_squareoff','t1_then_breakeven')"
BUCKETS = "CASE WHEN category='scan' THEN CASE WHEN TRY_CAST(setup[6:] AS INT) >= 95 THEN '95-100' WHEN TRY_CAST(setup[6:] AS INT) >= 90 THEN '90-94' WHEN TRY_CAST(setup[6:] AS INT) >= 80 THEN '80-89' ELSE '<80' END END"


@query(f"SELECT CASE grouping_id(category, bucket, channel) WHEN 7 THEN 'overall' WHEN 3 THEN 'category' WHEN 1 THEN 'bucket' ELSE 'channel' END AS slice, category, bucket, channel, {AGG} FROM (SELECT *, {OK} AS ok, {BUCKETS} AS bucket, CASE WHEN category='channel_call' THEN coalesce(setup, '?') END AS channel FROM oc) GROUP BY GROUPING SETS ((), (category), (category, bucket), (category, channel)) HAVING grouping_id(category, bucket, channel) IN (7, 3) OR bucket IS NOT NULL OR channel IS NOT NULL")
def perf_grouping_sets(spark, sf):
    out = me.performance(_outcomes(spark, sf))
    return out.select("slice", "category", "bucket", "channel", "n", "wins", "losses", "neutral", r("net", 4).alias("net"), r("win_rate", 4).alias("win_rate"), r("avg_hold", 4).alias("avg_hold"))


@query("""SELECT category, count(net) AS trades, round(avg(net), 6)+0.0 AS mean, round(coalesce(stddev_samp(net), 0), 6)+0.0 AS std, round(avg(net)/nullif(stddev_samp(net), 0), 6)+0.0 AS sharpe, round(CASE WHEN count(net) >= 2 THEN avg(net)/nullif(sqrt(avg(least(net, 0)*least(net, 0))), 0) END, 6)+0.0 AS sortino,
  round(avg(net)-1.96*stddev_samp(net)/sqrt(count(net)), 6)+0.0 AS ci_low, round(avg(net)+1.96*stddev_samp(net)/sqrt(count(net)), 6)+0.0 AS ci_high, round(avg(net)/nullif(stddev_samp(net)/sqrt(count(net)), 0), 6)+0.0 AS t_stat, coalesce(avg(net)-1.96*stddev_samp(net)/sqrt(count(net)) > 0 OR avg(net)+1.96*stddev_samp(net)/sqrt(count(net)) < 0, false) AS edge FROM (SELECT *, pnl_pct-0.13 AS net FROM oc) GROUP BY category""")
def risk_metrics(spark, sf):
    out = _outcomes(spark, sf).withColumn("net", me.net()).groupBy("category").agg(*me.risk())
    return rounded(out, keep=["category", "trades", "edge"], values=["mean", "std", "sharpe", "sortino", "ci_low", "ci_high", "t_stat"])


@query("SELECT symbol, round(max(greatest(0, peak)-equity), 4)+0.0 AS max_drawdown FROM (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY generated_at, alert_id ROWS UNBOUNDED PRECEDING) AS peak FROM (SELECT *, sum(pnl_pct-0.13) OVER (PARTITION BY symbol ORDER BY generated_at, alert_id ROWS UNBOUNDED PRECEDING) AS equity FROM oc WHERE pnl_pct IS NOT NULL)) GROUP BY symbol")
def max_drawdown(spark, sf):
    return rounded(me.max_drawdown(_outcomes(spark, sf)), keep=["symbol"], values=["max_drawdown"], digits=4)


@query("SELECT symbol, status, count(*) AS n, round(count(*)*100.0/sum(count(*)) OVER (PARTITION BY symbol), 6)+0.0 AS pct FROM oc GROUP BY symbol, status")
def status_breakdown(spark, sf):
    return rounded(me.status_breakdown(_outcomes(spark, sf)), keep=["symbol", "status", "n"], values=["pct"])


@query("SELECT status, count(*) AS n FROM oc GROUP BY status")
def status_counts(spark, sf):
    return _outcomes(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT symbol, grouping(symbol)::INT AS is_total, count(pnl_pct) AS n, count(*) FILTER (pnl_pct > 0) AS wins, count(*) FILTER (pnl_pct < 0) AS losses, count(*) FILTER (pnl_pct = 0) AS break_even, round(coalesce(count(*) FILTER (pnl_pct > 0)*100.0/nullif(count(pnl_pct), 0), 0), 4)+0.0 AS hit_rate, round(coalesce(avg(pnl_pct), 0), 4)+0.0 AS gross_avg, round(coalesce(avg(pnl_pct), 0)-0.13, 4)+0.0 AS net_avg, round(sum(pnl_pct), 4)+0.0 AS gross_total, round(sum(pnl_pct)-0.13*count(pnl_pct), 4)+0.0 AS net_total, round(coalesce(avg(pnl_pct) FILTER (pnl_pct > 0), 0), 4)+0.0 AS avg_win, round(coalesce(avg(pnl_pct) FILTER (pnl_pct < 0), 0), 4)+0.0 AS avg_loss FROM oc GROUP BY ROLLUP (symbol)")
def symbol_summary(spark, sf):
    out = me.symbol_summary(_outcomes(spark, sf))
    return rounded(out, keep=["symbol", "is_total", "n", "wins", "losses", "break_even"], values=["hit_rate", "gross_total", "gross_avg", "net_total", "net_avg", "avg_win", "avg_loss"], digits=4).orderBy(F.desc("net_total"))


@query("SELECT symbol, row_number() OVER (ORDER BY net_total DESC, symbol) AS place FROM (SELECT symbol, round(sum(pnl_pct)-0.13*count(pnl_pct), 4) AS net_total FROM oc GROUP BY symbol)")
def symbols_by_net(spark, sf):
    rows = me.symbol_summary(_outcomes(spark, sf)).where("is_total = 0").select("symbol", F.round("net_total", 4).alias("net_total"))
    return rows.select("symbol", F.row_number().over(W.orderBy(F.desc("net_total"), "symbol")).alias("place"))  # a row for each symbol


@query("SELECT alert_id, trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY generated_at, alert_id) AS place FROM al")
def journal_places(spark, sf):
    kept = al.journal_order(_alerts(spark, sf).repartition(5)).withColumn("i", F.monotonically_increasing_id())
    return kept.select("alert_id", "trade_date", F.row_number().over(W.partitionBy("trade_date").orderBy("i")).alias("place"))


@query(f"SELECT user_id, count(*) FILTER ({OK}) AS wins, count(*) FILTER (status='sl_hit') AS losses, count(*) FILTER (NOT {OK} AND status<>'sl_hit') AS neutral, round(count(*) FILTER ({OK})*100.0/count(*), 4)+0.0 AS win_rate, round(sum(pnl_pct-0.13), 4)+0.0 AS net, round(avg(date_diff('day', CAST(generated_at AS DATE), CAST(exit_time AS DATE))), 4)+0.0 AS avg_hold FROM oc WHERE pnl_pct IS NOT NULL GROUP BY user_id")
def swing_record(spark, sf):
    return rounded(me.swing_record(_outcomes(spark, sf)), keep=["user_id", "wins", "losses", "neutral"], values=["win_rate", "net", "avg_hold"], digits=4)


@query(f"SELECT trade_date, category, count(*) AS total, count(*) FILTER ({OK}) AS passed, count(*) FILTER (status='sl_hit') AS failed, count(*) FILTER (NOT {OK} AND status<>'sl_hit') AS neutral, round(coalesce(sum(pnl_pct), 0), 4)+0.0 AS pnl_sum, round(avg(pnl_pct), 4)+0.0 AS pnl_avg FROM oc GROUP BY trade_date, category")
def day_report(spark, sf):
    return rounded(me.day_report(_alerts(spark, sf), _results_of(spark, sf, "true")), keep=["trade_date", "category", "total", "passed", "failed", "neutral"], values=["pnl_sum", "pnl_avg"], digits=4)


@query(f"SELECT trade_date, CASE WHEN category IN ('scan', 'manual_intraday') THEN category ELSE 'swing' END AS section, count(*) AS total, count(*) FILTER ({OK}) AS passed, count(*) FILTER (status='sl_hit') AS failed, count(*) FILTER (NOT {OK} AND status<>'sl_hit') AS neutral, round(coalesce(sum(pnl_pct), 0), 4)+0.0 AS pnl_sum, round(avg(pnl_pct), 4)+0.0 AS pnl_avg FROM oc GROUP BY ALL")
def day_report_sections(spark, sf):
    return rounded(me.day_sections(_alerts(spark, sf), _results_of(spark, sf, "true")), keep=["trade_date", "section", "total", "passed", "failed", "neutral"], values=["pnl_sum", "pnl_avg"], digits=4)


@query(f"SELECT u.alert_id, u.user_id, round(r.net, 4)+0.0 AS record_net, r.wins AS record_wins FROM oc u LEFT JOIN (SELECT user_id, sum(pnl_pct-0.13) AS net, count(*) FILTER ({OK}) AS wins FROM oc WHERE pnl_pct IS NOT NULL GROUP BY user_id) r ON r.user_id = u.user_id WHERE u.user_id IS NOT NULL AND u.status = 't2_hit'")
def swing_completions(spark, sf):
    rows = _outcomes(spark, sf)
    return rounded(al.completions(rows.where("user_id is not null and status = 't2_hit'").select("alert_id", "user_id"), me.swing_record(rows)), keep=["alert_id", "user_id", "record_wins"], values=["record_net"], digits=4)


@query("SELECT symbol, round(CASE WHEN count(*) >= 2 THEN (arg_max(close, ts)-arg_min(close, ts))/nullif(arg_min(close, ts), 0)*100 END, 6)+0.0 AS hold_pct FROM day WHERE session BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY symbol")
def benchmark_return(spark, sf):
    rows = br.daily(spark, sf).where("session between date'1997-01-01' and date'1998-12-31'")
    return rounded(me.benchmark(rows), keep=["symbol"], values=["hold_pct"])


# --- history and walk-forward ----------------------------------------------------------------------------------

TRADE = f"status, exit_time, {rsql('stop_loss', 'exit_price', digits=4)}, round(coalesce(pnl_pct, 0), 4)+0.0 AS pnl_pct"


def _history(trades: DataFrame, *more: str) -> DataFrame:
    kept = trades.withColumn("pnl_pct", F.coalesce("pnl_pct", F.lit(0.0)))
    return rounded(kept, keep=["alert_id", "symbol", "direction", *more, "status", "exit_time"], values=["stop_loss", "exit_price", "pnl_pct"], digits=4)


@query(f"SELECT alert_id, symbol, direction, {TRADE} FROM hoc")
def signal_history(spark, sf):
    return _history(hi.setup_history(_feat(spark, sf), session=ALL_DAY, time_stop=TIME_STOP))


@query(f"SELECT alert_id, symbol, direction, {TRADE} FROM doc")
def signal_history_usual_hours(spark, sf):
    return _history(hi.setup_history(_feat(spark, sf)))


@query(f"SELECT alert_id, symbol, direction, score, {TRADE} FROM soc")
def score_history(spark, sf):
    return _history(hi.score_history(_scored(spark, sf), br.intraday(spark, sf), 60, ALL_DAY, TIME_STOP), "score")


@query("SELECT session, (i >= round_even(m/4.0, 0))::INT + (i >= round_even(2*m/4.0, 0))::INT + (i >= round_even(3*m/4.0, 0))::INT AS fold FROM (SELECT session, row_number() OVER (ORDER BY session)-1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT session FROM bar))")
def folds(spark, sf):
    return hi.folds(br.intraday(spark, sf), 4)


FOLDS = "SELECT session, (i >= round_even(m/4.0, 0))::INT + (i >= round_even(2*m/4.0, 0))::INT + (i >= round_even(3*m/4.0, 0))::INT AS fold FROM (SELECT session, row_number() OVER (ORDER BY session)-1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT session FROM bar))"
PARAM_TRADES = f"SELECT fold, param, coalesce(pnl_pct, 0)-0.13 AS net FROM woc JOIN ({FOLDS}) f ON f.session = woc.trade_date"


@query(f"SELECT l.fold, l.param, round(train_mean, 6)+0.0 AS train_mean, n_train, n_test, round(test_mean, 6)+0.0 AS test_mean FROM (SELECT test AS fold, param, avg(net) AS train_mean, count(*) AS n_train FROM ({PARAM_TRADES}) JOIN (VALUES (2), (3)) v(test) ON fold >= test-2 AND fold < test GROUP BY test, param QUALIFY row_number() OVER (PARTITION BY test ORDER BY avg(net) DESC, param) = 1) l LEFT JOIN (SELECT fold, param, count(*) AS n_test, avg(net) AS test_mean FROM ({PARAM_TRADES}) GROUP BY fold, param) t ON t.fold = l.fold AND t.param = l.param")
def walk_forward(spark, sf):
    grid = spark.createDataFrame([(0, 0.002, 0.02), (1, 0.004, 0.015), (2, 0.003, 0.012)], "param int, lo double, hi double")
    trades, log = hi.walk_forward(_feat(spark, sf), grid, session=ALL_DAY, time_stop=TIME_STOP)
    per = trades.groupBy("fold", "param").agg(F.count("*").alias("n_test"), F.avg("net").alias("test_mean"))
    return rounded(log.join(per, ["fold", "param"], "left"), keep=["fold", "param", "n_train", "n_test"], values=["train_mean", "test_mean"])


# --- universe --------------------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return br.daily(spark, sf).select(F.trunc("session", "month").alias("as_of"), "symbol").distinct()


SNAP = "SELECT DISTINCT CAST(date_trunc('month', session) AS DATE) AS as_of, symbol FROM day"


@query(f"SELECT d, best AS as_of, s.symbol, best IS NULL AS survivorship_biased FROM (SELECT d, max(as_of) AS best FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) - 400 AS d FROM orders) LEFT JOIN (SELECT DISTINCT as_of FROM ({SNAP})) ON as_of <= d GROUP BY d) LEFT JOIN ({SNAP}) s ON s.as_of = best")
def asof_universe(spark, sf):
    dates = spark.read.parquet(f"{sf}/orders.parquet").select(F.date_sub(F.to_date("o_orderdate"), 400).alias("d"))
    return un.as_of(_snapshots(spark, sf), dates)


#: A month's snapshot lists what traded in the month before it.
LISTED = "SELECT DISTINCT CAST(date_trunc('month', session) + INTERVAL 1 MONTH AS DATE) AS as_of, symbol FROM day"


@query(f"SELECT v.symbol, v.session, v.rn, v.signal, CASE WHEN a.as_of IS NOT NULL THEN s.symbol IS NOT NULL END AS member, a.as_of IS NULL AS survivorship_biased FROM (SELECT * FROM dv WHERE signal <> 'HOLD') v ASOF LEFT JOIN (SELECT DISTINCT as_of FROM ({LISTED}) WHERE as_of >= (SELECT min(as_of) + 400 FROM ({LISTED}))) a ON a.as_of <= v.session LEFT JOIN ({LISTED}) s ON s.as_of = a.as_of AND s.symbol = v.symbol")
def signal_membership(spark, sf):
    days = br.daily(spark, sf)
    listed = days.select(F.add_months(F.trunc("session", "month"), 1).alias("as_of"), "symbol").distinct()
    least = listed.agg(F.date_add(F.min("as_of"), 400).alias("least"))
    listed = listed.crossJoin(F.broadcast(least)).where("as_of >= least").select("as_of", "symbol")
    return un.with_membership(sg.vote(days).where("signal <> 'HOLD'").select("symbol", "session", "rn", "signal"), listed)


@query("SELECT DATE '2024-01-31' AS as_of, symbol FROM (SELECT s_suppkey AS symbol FROM supplier UNION SELECT l_suppkey FROM lineitem)")
def universe_snapshot(spark, sf):
    a = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("symbol"))
    b = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_suppkey").alias("symbol"))
    return un.snapshot(a.union(b), F.lit("2024-01-31").cast("date"))


def _master(spark: SparkSession, sf: str) -> DataFrame:
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    name = F.concat(F.lit("SUP"), F.col("s_suppkey").cast("string"))
    cash = s.select(F.when(F.col("s_nationkey") % 2 == 0, "NSE").otherwise("BSE").alias("exch_seg"), F.concat(name, F.lit("-EQ")).alias("symbol"), name.alias("name"), F.lit("").alias("instrumenttype"), F.col("s_suppkey").cast("string").alias("token"))
    fut = s.where("s_acctbal > 2000").select(F.lit("NFO").alias("exch_seg"), F.concat(name, F.lit("24JANFUT")).alias("symbol"), name.alias("name"), F.lit("FUTSTK").alias("instrumenttype"), (F.col("s_suppkey") + 100000).cast("string").alias("token"))
    return cash.union(fut)


@query("SELECT 'SUP' || s_suppkey AS symbol FROM supplier WHERE s_nationkey % 2 = 0 AND s_acctbal > 2000")
def fno_universe(spark, sf):
    return un.tradable(_master(spark, sf)).select("symbol")


@query("SELECT 'SUP' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '.BO' ELSE '.NS' END AS symbol, CASE WHEN s_suppkey % 3 = 0 THEN 'BSE' ELSE 'NSE' END AS exch, CASE WHEN (s_nationkey % 2 = 0) = (s_suppkey % 3 <> 0) THEN CAST(s_suppkey AS VARCHAR) END AS token FROM supplier")
def instrument_tokens(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("SUP"), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, ".BO").otherwise(".NS")).alias("symbol"))
    found, missing = un.instruments(s, _master(spark, sf))
    return found.select("symbol", "exch", "token").unionByName(missing.select("symbol", "exch", F.lit(None).cast("string").alias("token")))


@query("SELECT symbol, row_number() OVER (ORDER BY i, pos, symbol) AS place FROM (SELECT symbol, i, pos FROM (SELECT s_suppkey AS symbol, 0 AS i, s_suppkey AS pos FROM supplier WHERE s_nationkey < 10 UNION ALL SELECT s_suppkey, 1, s_suppkey FROM supplier WHERE s_nationkey BETWEEN 5 AND 15) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i, pos) = 1)")
def union_lists(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    one = lambda c: s.where(c).select(F.col("s_suppkey").alias("symbol"), F.col("s_suppkey").alias("pos"))
    return un.union_lists([one("s_nationkey < 10"), one("s_nationkey between 5 and 15")])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN '^IDX' WHEN s_suppkey % 5 = 0 THEN '^NATION' || s_nationkey ELSE 'SUP' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '.BO' ELSE '.NS' END END AS ticker FROM supplier")
def symbol_normalisation(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    k = F.col("s_suppkey")
    names = F.when(k % 7 == 0, "^idx").when(k % 5 == 0, F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string"))).otherwise(F.concat(F.lit(" sup"), k.cast("string"), F.when(k % 3 == 0, ".bo").otherwise("")))
    n = spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("NATION"), F.col("n_nationkey").cast("string")).alias("alias"), F.concat(F.lit("^NATION"), F.col("n_nationkey").cast("string")).alias("ticker"), F.col("n_name").alias("display"))
    return un.normalize_symbols(s.select("s_suppkey", names.alias("symbol")), n).select("s_suppkey", "ticker")


# --- tips and news ---------------------------------------------------------------------------------------------


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Tips composed of order rows, every seventh with words of both sides, and real documents that are none."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("long") % 9000 + 1000
    words = F.when(k % 7 == 0, "BUY or SELL").when(k % 2 == 0, "buy").otherwise("Go short")
    text = F.concat(words, F.lit(" SUP"), (k % 90).cast("string"), F.lit(" @ "), price.cast("string"), F.when(k % 3 != 0, F.concat(F.lit(", SL "), (price - 12).cast("string"))).otherwise(""), F.lit(" TGT "), (price + 13).cast("string"))
    tips = o.select(F.concat(F.lit("ch"), (k % 4).cast("string")).alias("channel"), k.alias("msg_id"), F.col("o_orderdate").alias("ts"), text.alias("text"))
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.lit("docs").alias("channel"), F.col("doc_id").alias("msg_id"), F.lit("1999-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), "text")
    return tips.unionByName(d)


def _tickers(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("SUP"), F.col("s_suppkey").cast("string")).alias("symbol"))


TIPS = "SELECT 'ch' || (o_orderkey % 4) AS channel, o_orderkey AS msg_id, o_orderdate AS ts, 'SUP' || (o_orderkey % 90) AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS action, p AS entry, p+13 AS target, CAST(NULL AS DOUBLE) AS target2, CASE WHEN o_orderkey % 3 <> 0 THEN p-12 END AS stop_loss FROM (SELECT *, CAST(CAST(floor(o_totalprice) AS BIGINT) % 9000 + 1000 AS DOUBLE) AS p FROM orders) WHERE o_orderkey % 7 <> 0 AND (o_orderkey % 90) IN (SELECT s_suppkey FROM supplier)"


@query(f"SELECT channel, msg_id, symbol, action, entry, target, target2, stop_loss FROM ({TIPS})")
def tips_extract(spark, sf):
    return tp.extract_tips(_messages(spark, sf), _tickers(spark, sf)).select("channel", "msg_id", "symbol", "action", "entry", "target", "target2", "stop_loss")


def _gated_tips(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("SUP"), F.col("symbol").cast("string"))
    latest = saved(sg.trade_plan(ind.latest(_voted(spark, sf))).select("symbol", "session", "signal", "confidence", "entry", "stop_loss", "target1", "target2"), "latest")
    ends = latest.agg(F.max("session").alias("end"))  # a symbol whose bars ended a week before can't be analysed
    plan = latest.crossJoin(F.broadcast(ends)).select((F.col("session") >= F.date_sub("end", 7)).alias("known"), name.alias("symbol"), "signal", "confidence", F.col("entry").alias("plan_entry"), F.col("stop_loss").alias("plan_stop"), F.col("target1").alias("plan_target1"), F.col("target2").alias("plan_target2"))
    v, planned = plan.where("known").select("symbol", "signal", "confidence"), plan.drop("known", "signal", "confidence")
    codes = _tickers(spark, sf).select("symbol", F.lit("long").alias("direction"), F.when(F.col("symbol").endswith("4"), "atr_low").alias("code")).where("code is not null")
    return tp.gate(tp.extract_tips(_messages(spark, sf), _tickers(spark, sf)), v, codes, 50.0).join(planned, "symbol", "left")


GATE = f"SELECT t.*, v.signal, CASE WHEN v.signal IS NULL THEN 'error' WHEN NOT (v.signal IN ('BUY','SELL') AND confidence >= 50) THEN 'low_confidence' WHEN action = 'BUY' AND t.symbol LIKE '%4' THEN 'failed_filter' ELSE 'passed' END AS outcome, CASE WHEN v.signal IS NULL THEN NULL WHEN action = v.signal THEN 'Agreement' WHEN v.signal = 'HOLD' THEN 'Neutral' ELSE 'Conflict' END AS agreement FROM ({TIPS}) t LEFT JOIN (SELECT 'SUP' || symbol AS symbol, signal, confidence FROM dl WHERE session >= (SELECT max(session) - 7 FROM dl)) v ON v.symbol = t.symbol"


@query(f"SELECT channel, msg_id, signal, outcome, agreement FROM ({GATE})")
def tip_gate(spark, sf):
    return _gated_tips(spark, sf).select("channel", "msg_id", "signal", "outcome", "agreement")


@query(f"SELECT channel, CAST((rn-1)//10 AS BIGINT) AS run, outcome, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts, msg_id) AS rn FROM ({GATE})) GROUP BY ALL")
def tip_digest(spark, sf):
    return tp.digest(_gated_tips(spark, sf))


@query(f"SELECT 'channel_call' AS category, '@' || channel AS setup, count(*) AS n, round(sum(entry), 2)+0.0 AS entries FROM ({GATE}) WHERE outcome = 'passed' AND stop_loss IS NOT NULL GROUP BY ALL UNION ALL SELECT 'channel_tip', '@' || channel, count(*), round(sum(p.close), 2)+0.0 FROM ({GATE}) g JOIN dl p ON 'SUP' || p.symbol = g.symbol WHERE outcome = 'passed' AND p.signal <> 'HOLD' GROUP BY ALL")
def channel_scorecard(spark, sf):
    a = tp.scorecard_alerts(_gated_tips(spark, sf).where("outcome = 'passed'"))
    return a.groupBy("category", "setup").agg(F.count("*").alias("n"), r(F.sum("entry"), 2).alias("entries"))


@query("SELECT symbol, page_id, place, title FROM (SELECT page_id % 20 AS symbol, page_id, row_number() OVER (PARTITION BY page_id % 20 ORDER BY page_id DESC, url) AS place, substring(url, 1, 40) AS title FROM pages WHERE url IS NOT NULL) WHERE place <= 3")
def news_top3(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet").select((F.col("page_id") % 20).alias("symbol"), F.col("page_id").alias("published_at"), "page_id", F.col("url").alias("title"), F.lit("web").alias("source"), "url")
    return fi.newest_news(p, 3, 40).select("symbol", "page_id", "place", "title")
