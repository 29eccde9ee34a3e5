"""Queries by name, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Named parts of oracle SQL, in an order in which each needs only earlier ones.
PARTS: dict[str, str] = {
    "tick": """SELECT event_type AS symbol, ts, event_id, round(100*exp(5e-7*sum(CAST(round(value*100) AS BIGINT)-4963) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),2) AS px,
      CAST(json_extract_string(props, '$.k') AS BIGINT)+1 AS volume FROM events""",
    "bar0": """SELECT symbol, CAST(date_trunc('hour', ts) AS DATE) AS session, date_trunc('hour', ts) AS ts, arg_min(px, (ts, event_id)) AS open, max(px) AS high, min(px) AS low, arg_max(px, (ts, event_id)) AS close, CAST(sum(volume) AS DOUBLE) AS volume
      FROM tick GROUP BY ALL""",
    "bar": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session, ts) AS rn, dense_rank() OVER (PARTITION BY symbol ORDER BY session) AS session_no, row_number() OVER (PARTITION BY symbol, session ORDER BY ts) AS bar_no FROM bar0""",
    "item": """SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS session, l_quantity AS q, row_number() OVER w AS k, round(100*exp(0.00005*sum(CAST(l_quantity*10 AS BIGINT)-255) OVER (w ROWS UNBOUNDED PRECEDING)),2) AS px
      FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)""",
    "day0": """SELECT symbol, session, CAST(session AS TIMESTAMP) AS ts, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close, sum(q) AS volume FROM item GROUP BY symbol, session""",
    "day": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session) AS rn, row_number() OVER (PARTITION BY symbol ORDER BY session) AS session_no, 1 AS bar_no FROM day0""",
    "ema(symbol, rn, e9, e20, e50)": """SELECT symbol, rn, close, close, close FROM bar WHERE rn = 1 UNION ALL
      SELECT b.symbol, b.rn, e9*0.8+b.close*0.2, e20*(1-2/21.0)+b.close*2/21.0, e50*(1-2/51.0)+b.close*2/51.0 FROM ema e JOIN bar b ON b.symbol = e.symbol AND b.rn = e.rn+1""",
    "f1": """SELECT *, lag(close) OVER w AS prev_close, greatest(high-low, abs(high-lag(close) OVER w), abs(low-lag(close) OVER w)) AS tr FROM bar WINDOW w AS (PARTITION BY symbol ORDER BY rn)""",
    "f2": """SELECT *, CASE WHEN count(*) OVER w14 = 14 THEN avg(tr) OVER w14 END AS atr14, greatest(coalesce(close-prev_close,0),0) AS up, greatest(coalesce(prev_close-close,0),0) AS down,
      sum((high+low+close)/3*volume) OVER cum / nullif(sum(volume) OVER cum, 0) AS vwap, CASE WHEN rn > 12 AND avg(volume) OVER w12 > 0 THEN volume / avg(volume) OVER w12 END AS vol_ratio,
      CASE WHEN rn > 5 THEN min(low) OVER w5 ELSE min(low) OVER allw END AS swing_low, CASE WHEN rn > 5 THEN max(high) OVER w5 ELSE max(high) OVER allw END AS swing_high,
      CASE WHEN bar_no > 3 THEN max(CASE WHEN bar_no <= 3 THEN high END) OVER cum END AS orb3_high, CASE WHEN bar_no > 3 THEN min(CASE WHEN bar_no <= 3 THEN low END) OVER cum END AS orb3_low,
      CASE WHEN bar_no > 6 THEN max(CASE WHEN bar_no <= 6 THEN high END) OVER cum END AS orb6_high, CASE WHEN bar_no > 6 THEN min(CASE WHEN bar_no <= 6 THEN low END) OVER cum END AS orb6_low,
      first_value(open) OVER cum AS session_open, first_value(prev_close) OVER cum AS before_close, max(high) OVER cum AS day_high, min(low) OVER cum AS day_low
      FROM f1 WINDOW w14 AS (PARTITION BY symbol ORDER BY rn ROWS 13 PRECEDING), w12 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
      allw AS (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING), cum AS (PARTITION BY symbol, session ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
    "feat": """SELECT f2.*, e9 AS ema9, e20 AS ema20, e50 AS ema50, CASE WHEN count(*) OVER w14 < 14 THEN NULL WHEN avg(down) OVER w14 > 0 THEN 100-100/(1+avg(up) OVER w14/avg(down) OVER w14) WHEN avg(up) OVER w14 > 0 THEN 100 END AS rsi14,
      CASE WHEN count(vwap) OVER w6 = 6 THEN regr_slope(vwap, f2.rn) OVER w6 / nullif(avg(vwap) OVER w6, 0) * 100 END AS vwap_slope, (session_open-before_close)/nullif(before_close, 0)*100 AS gap_pct
      FROM f2 JOIN ema ON ema.symbol = f2.symbol AND ema.rn = f2.rn WINDOW w14 AS (PARTITION BY f2.symbol ORDER BY f2.rn ROWS 13 PRECEDING), w6 AS (PARTITION BY f2.symbol ORDER BY f2.rn ROWS 5 PRECEDING)""",
    "lvl": """SELECT *, CASE WHEN atr14 > 0 THEN atr14*1.5 ELSE close*0.01 END AS unit FROM feat""",
    "gated": """SELECT *, atr14/nullif(close,0) AS atr_share, CASE WHEN close < 100 THEN 25 WHEN close < 500 THEN 50 WHEN close < 1000 THEN 100 ELSE 500 END AS step,
      CASE WHEN atr14 IS NULL THEN 'atr_missing' WHEN atr14/nullif(close,0) < 0.004 THEN 'atr_low' WHEN atr14/nullif(close,0) > 0.015 THEN 'atr_high' END AS c_atr, CASE WHEN vol_ratio IS NULL THEN 'volume_missing' WHEN vol_ratio < 1.5 THEN 'volume_low' END AS c_vol,
      CASE WHEN vwap_slope IS NULL THEN 'slope_missing' WHEN abs(vwap_slope) < 0.02 THEN 'slope_flat' END AS c_slope FROM lvl""",
    "near": """SELECT symbol, rn, bool_or(lvl > 0 AND (lvl-close)/close > 0 AND (lvl-close)/close < 0.003) AS near_long, bool_or(lvl > 0 AND (lvl-close)/close < 0 AND (lvl-close)/close > -0.003) AS near_short
      FROM (SELECT symbol, rn, close, unnest([(round_even(close/step,0)-1)*step, round_even(close/step,0)*step, (round_even(close/step,0)+1)*step]) AS lvl FROM gated) GROUP BY symbol, rn""",
    "codes": """SELECT g.*, near_long, near_short, coalesce(c_atr, c_vol, c_slope, CASE WHEN near_long THEN 'round_number' END) AS long_code, coalesce(c_atr, c_vol, c_slope, CASE WHEN near_short THEN 'round_number' END) AS short_code FROM gated g JOIN near USING (symbol, rn)""",
    "seta": """SELECT *, CASE WHEN direction = 'long' THEN 1 ELSE -1 END AS side FROM (SELECT *, CASE WHEN bar_no >= 4 AND (orb3_high-orb3_low)/orb3_low <= 0.012 THEN CASE WHEN close > orb3_high THEN 'long' WHEN close < orb3_low THEN 'short' END END AS direction FROM codes)
      WHERE (direction = 'long' AND close > vwap AND ema9 > ema20 AND rsi14 BETWEEN 55 AND 70) OR (direction = 'short' AND close < vwap AND ema9 < ema20 AND rsi14 BETWEEN 30 AND 45)""",
    "al": """SELECT symbol || ':' || rn AS alert_id, symbol, session AS trade_date, ts AS generated_at, close AS entry, close-side*unit AS stop_loss, close+2*side*unit AS target1, close+3*side*unit AS target2, CASE WHEN side = 1 THEN 'long' ELSE 'short' END AS direction,
      ['scan','manual_intraday','swing_auto','manual_swing','channel_tip','channel_call'][CAST((rn//2)%6+1 AS BIGINT)] AS category, CASE WHEN (rn//2)%5 <> 0 THEN rn%3 END AS user_id,
      CASE (rn//2)%6 WHEN 0 THEN 'score' || (75+rn%25) WHEN 5 THEN '@ch' || (rn%3) ELSE 'A' END AS setup FROM (SELECT *, CASE WHEN rn%2 = 0 THEN 1 ELSE -1 END AS side FROM lvl WHERE rn > 30)""",
    "tch": """SELECT *, (direction='long' AND high>=target1) OR (direction='short' AND low<=target1) AS i1, (direction='long' AND high>=target2) OR (direction='short' AND low<=target2) AS i2, (direction='long' AND low<=stop_loss) OR (direction='short' AND high>=stop_loss) AS isl,
      (direction='long' AND low<=entry) OR (direction='short' AND high>=entry) AS ibe, min(CASE WHEN (direction='long' AND high>=target1) OR (direction='short' AND low<=target1) THEN ts END) OVER (PARTITION BY alert_id) AS t1
      FROM (SELECT al.*, b.ts, b.high, b.low, b.close FROM al JOIN bar b ON b.symbol = al.symbol AND b.session = al.trade_date AND b.ts > al.generated_at)""",
    "tg": """SELECT alert_id, min(ts) FILTER (ts > generated_at + INTERVAL 180 MINUTE) AS tl, arg_min(close, ts) FILTER (ts > generated_at + INTERVAL 180 MINUTE) AS cl, any_value(t1) AS t1, min(ts) FILTER (isl) AS tsl, min(ts) FILTER (ts >= t1 AND i2) AS t2, min(ts) FILTER (ts > t1 AND ibe) AS tbe, max(ts) AS tend, arg_max(close, ts) AS cend FROM tch GROUP BY alert_id""",
    "oc0": """SELECT al.*, tg.* EXCLUDE (alert_id), CASE WHEN tend IS NULL THEN 'no_data' WHEN tl <= coalesce(tsl, tl) AND tl <= coalesce(t1, tl) THEN 'time_stop' WHEN tsl <= coalesce(t1, tsl) THEN 'sl_hit' WHEN t1 IS NULL THEN 'squareoff_no_t1' WHEN t2 <= coalesce(tbe, t2) THEN 't2_hit' WHEN tbe IS NOT NULL THEN 't1_then_breakeven' ELSE 't1_then_squareoff' END AS status
      FROM al LEFT JOIN tg USING (alert_id)""",
    "oc1": """SELECT *, CASE status WHEN 'time_stop' THEN cl WHEN 'sl_hit' THEN stop_loss WHEN 't2_hit' THEN target2 WHEN 't1_then_breakeven' THEN entry WHEN 'no_data' THEN NULL ELSE cend END AS exit_price, CASE status WHEN 'time_stop' THEN tl WHEN 'sl_hit' THEN tsl WHEN 't2_hit' THEN t2 WHEN 't1_then_breakeven' THEN tbe WHEN 'no_data' THEN NULL ELSE tend END AS exit_time FROM oc0""",
    "oc": """SELECT *, CASE WHEN status IN ('t2_hit','t1_then_squareoff','t1_then_breakeven') THEN (w+h)/2 ELSE w END AS pnl_pct FROM (SELECT *, CASE WHEN direction='long' THEN 1 ELSE -1 END*(exit_price-entry)/nullif(entry,0)*100 AS w, CASE WHEN direction='long' THEN 1 ELSE -1 END*(target1-entry)/nullif(entry,0)*100 AS h FROM oc1)""",
    "eday": """SELECT symbol, session, max(high) AS high, min(low) AS low FROM bar GROUP BY symbol, session""",
    "swt": """SELECT *, (direction='long' AND high>=target1) OR (direction='short' AND low<=target1) AS i1, (direction='long' AND high>=target2) OR (direction='short' AND low<=target2) AS i2, (direction='long' AND low<=stop_loss) OR (direction='short' AND high>=stop_loss) AS isl,
      (direction='long' AND low<=entry) OR (direction='short' AND high>=entry) AS ibe, min(CASE WHEN (direction='long' AND high>=target1) OR (direction='short' AND low<=target1) THEN session END) OVER (PARTITION BY alert_id) AS t1 FROM (SELECT al.*, d.session, d.high, d.low FROM al JOIN eday d ON d.symbol = al.symbol AND d.session > al.trade_date AND d.session <= al.trade_date+60)""",
    "swo": """SELECT al.*, CASE WHEN tsl <= coalesce(t1, tsl) THEN 'sl_hit' WHEN t1 IS NULL THEN 'open' WHEN t2 <= coalesce(tbe, t2) THEN 't2_hit' WHEN tbe IS NOT NULL THEN 't1_then_breakeven' ELSE 'open' END AS status
      FROM al LEFT JOIN (SELECT alert_id, any_value(t1) AS t1, min(session) FILTER (isl) AS tsl, min(session) FILTER (session >= t1 AND i2) AS t2, min(session) FILTER (session > t1 AND ibe) AS tbe FROM swt GROUP BY alert_id) g USING (alert_id)""",
    "rv": """SELECT c.symbol, c.session_no, c.bar_no, CASE WHEN avg(p.so_far) FILTER (p.so_far > 0) > 0 THEN any_value(c.so_far)/avg(p.so_far) FILTER (p.so_far > 0) END AS rvol
      FROM (SELECT symbol, session_no, bar_no, sum(volume) OVER (PARTITION BY symbol, session_no ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS so_far FROM bar) c JOIN (SELECT symbol, session_no, bar_no, max(bar_no) OVER (PARTITION BY symbol, session_no) AS n, sum(volume) OVER (PARTITION BY symbol, session_no ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS so_far FROM bar) p
      ON p.symbol = c.symbol AND p.session_no BETWEEN c.session_no-4 AND c.session_no-1 AND p.bar_no = least(c.bar_no, p.n) GROUP BY c.symbol, c.session_no, c.bar_no""",
    "brk": """SELECT feat.*, rvol, unnest(CASE WHEN len(b) = 0 THEN [NULL] ELSE [list_max(b)] END) AS best FROM (SELECT *, list_filter([CASE WHEN close > orb3_high THEN {'s': (close-orb3_high)/orb3_high*100, 'm': -15, 'd': 'long'} END, CASE WHEN close < orb3_low THEN {'s': (orb3_low-close)/orb3_low*100, 'm': -15, 'd': 'short'} END,
      CASE WHEN close > orb6_high THEN {'s': (close-orb6_high)/orb6_high*100, 'm': -30, 'd': 'long'} END, CASE WHEN close < orb6_low THEN {'s': (orb6_low-close)/orb6_low*100, 'm': -30, 'd': 'short'} END], lambda x: x IS NOT NULL) AS b FROM lvl) feat LEFT JOIN rv USING (symbol, session_no, bar_no)""",
    "sc0": """SELECT *, best.d AS orb_dir, best.s AS orb_strength, -best.m AS orb_window, CASE WHEN gap_pct IS NULL THEN 0 WHEN gap_pct > 0 THEN 1 ELSE -1 END + CASE WHEN close > vwap THEN 1 ELSE -1 END + CASE WHEN ema20 > ema50 THEN 1 ELSE -1 END + CASE best.d WHEN 'long' THEN 1 WHEN 'short' THEN -1 ELSE 0 END AS votes FROM brk WHERE session_no >= 2 AND bar_no >= 4""",
    "sc1": """SELECT *, CASE WHEN votes > 0 THEN 'long' WHEN votes < 0 THEN 'short' ELSE 'none' END AS direction, coalesce(CASE WHEN votes > 0 THEN gap_pct ELSE -gap_pct END, 0) AS fav FROM sc0""",
    "sc2": """SELECT *, CASE WHEN direction = 'none' THEN 0 WHEN fav >= 2 THEN 20 WHEN fav >= 1.5 THEN 15 WHEN fav >= 1 THEN 10 WHEN fav >= 0.5 THEN 5 ELSE 0 END AS pts_gap, CASE WHEN direction = 'none' THEN 0 WHEN rvol >= 2 THEN 25 WHEN rvol >= 1.5 THEN 18 WHEN rvol >= 1.2 THEN 10 ELSE 0 END AS pts_rvol,
      CASE WHEN (direction = 'long' AND close > vwap) OR (direction = 'short' AND close < vwap) THEN 15 ELSE 0 END AS pts_vwap, CASE WHEN (direction = 'long' AND ema20 > ema50) OR (direction = 'short' AND ema20 < ema50) THEN 15 ELSE 0 END AS pts_ema,
      CASE WHEN direction <> 'none' AND orb_dir = direction THEN CASE WHEN orb_strength >= 0.10 THEN 15 ELSE 8 END ELSE 0 END AS pts_orb, CASE WHEN direction = 'none' THEN 0 WHEN vol_ratio >= 1.5 THEN 10 WHEN vol_ratio >= 1.2 THEN 5 ELSE 0 END AS pts_vol FROM sc1""",
    "sc": """SELECT *, pts_gap+pts_rvol+pts_vwap+pts_ema+pts_orb+pts_vol AS score FROM sc2""",
    "dema(symbol, rn, f, s)": """SELECT symbol, rn, close, close FROM day WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, f*(1-2/13.0)+b.close*2/13.0, s*(1-2/27.0)+b.close*2/27.0 FROM dema e JOIN day b ON b.symbol = e.symbol AND b.rn = e.rn+1""",
    "dsig(symbol, rn, macd, sig)": """SELECT symbol, rn, f-s, f-s FROM dema WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, b.f-b.s, sig*0.8+(b.f-b.s)*0.2 FROM dsig e JOIN dema b ON b.symbol = e.symbol AND b.rn = e.rn+1""",
    "d1": """SELECT *, lag(close) OVER w AS prev_close, greatest(high-low, abs(high-lag(close) OVER w), abs(low-lag(close) OVER w)) AS tr, CASE WHEN count(*) OVER w20 = 20 THEN avg(close) OVER w20 END AS sma_short, CASE WHEN count(*) OVER w50 = 50 THEN avg(close) OVER w50 END AS sma_long,
      CASE WHEN count(*) OVER w20 = 20 THEN stddev_samp(close) OVER w20 END AS dev, max(high) OVER w20 AS recent_high, min(low) OVER w20 AS recent_low FROM day WINDOW w AS (PARTITION BY symbol ORDER BY rn), w20 AS (PARTITION BY symbol ORDER BY rn ROWS 19 PRECEDING), w50 AS (PARTITION BY symbol ORDER BY rn ROWS 49 PRECEDING)""",
    "d2": """SELECT d1.*, macd, sig, CASE WHEN count(*) OVER w14 = 14 THEN avg(tr) OVER w14 END AS atr, lag(sma_short) OVER w AS ps, lag(sma_long) OVER w AS pl, lag(macd) OVER w AS pm, lag(sig) OVER w AS pg, CASE WHEN count(*) OVER w14 < 14 THEN NULL WHEN avg(greatest(coalesce(prev_close-close,0),0)) OVER w14 > 0
      THEN 100-100/(1+avg(greatest(coalesce(close-prev_close,0),0)) OVER w14/avg(greatest(coalesce(prev_close-close,0),0)) OVER w14) WHEN avg(greatest(coalesce(close-prev_close,0),0)) OVER w14 > 0 THEN 100 END AS rsi
      FROM d1 JOIN dsig ON dsig.symbol = d1.symbol AND dsig.rn = d1.rn WINDOW w AS (PARTITION BY d1.symbol ORDER BY d1.rn), w14 AS (PARTITION BY d1.symbol ORDER BY d1.rn ROWS 13 PRECEDING)""",
    "d3": """SELECT *, CASE WHEN sma_short > sma_long AND ps <= pl THEN 1 WHEN sma_short < sma_long AND ps >= pl THEN -1 ELSE 0 END AS sma_cross, CASE WHEN macd > sig AND pm <= pg THEN 1 WHEN macd < sig AND pm >= pg THEN -1 ELSE 0 END AS macd_cross, CASE WHEN sma_short > sma_long THEN 'BUY' ELSE 'SELL' END AS vote_sma, CASE WHEN rsi < 30 THEN 'BUY' WHEN rsi > 70 THEN 'SELL' ELSE 'HOLD' END AS vote_rsi,
      CASE WHEN macd > sig AND pm <= pg THEN 'BUY' WHEN macd < sig AND pm >= pg THEN 'SELL' WHEN macd-sig > 0 THEN 'BUY' ELSE 'SELL' END AS vote_macd, CASE WHEN close < sma_short-2*dev THEN 'BUY' WHEN close > sma_short+2*dev THEN 'SELL' ELSE 'HOLD' END AS vote_bb, (close-prev_close)/nullif(prev_close,0)*100 AS change_pct FROM d2 WHERE rn >= 52""",
    "d4": """SELECT *, (vote_sma='BUY')::INT+(vote_rsi='BUY')::INT+(vote_macd='BUY')::INT+(vote_bb='BUY')::INT AS buys, (vote_sma='SELL')::INT+(vote_rsi='SELL')::INT+(vote_macd='SELL')::INT+(vote_bb='SELL')::INT AS sells FROM d3""",
    "d5": """SELECT *, CASE WHEN buys > sells AND buys >= 2 THEN 'BUY' WHEN sells > buys AND sells >= 2 THEN 'SELL' ELSE 'HOLD' END AS signal FROM d4""",
    "dv": """SELECT *, CASE WHEN signal = 'HOLD' THEN 50.0 ELSE greatest(buys, sells)/4*100 END AS confidence FROM d5""",
    "dl": """SELECT * FROM dv QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY rn DESC) = 1""",
    "plan0": """SELECT *, CASE signal WHEN 'BUY' THEN 1 WHEN 'SELL' THEN -1 END AS side, CASE signal WHEN 'BUY' THEN greatest(close-atr*1.5, recent_low*0.995) WHEN 'SELL' THEN least(close+atr*1.5, recent_high*1.005) END AS stop FROM dv""",
    "plan": """SELECT *, side*(close-stop) AS risk FROM plan0""",
}

#: Alerts of the histories: the first signal of each symbol and session (hal: any time of a working day; dal: the usual entry window), of the score, and of each parameter of a grid.
_FIRST = "SELECT {id} AS alert_id, symbol, session AS trade_date, ts AS generated_at, close AS entry, close-s*unit AS stop_loss, close+2*s*unit AS target1, close+3*s*unit AS target2, direction{more} FROM (SELECT *, CASE WHEN direction = 'long' THEN 1 ELSE -1 END AS s FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY ts) = 1)"
_GATED = "symbol IN (SELECT symbol FROM bar GROUP BY symbol HAVING count(*) >= 40) AND rn >= 30 AND isodow(ts) < 6 AND coalesce(c_vol, c_slope) IS NULL AND NOT near_long AND NOT (direction = 'short' AND near_short)"
_USUAL = "hour(ts)*60+minute(ts) BETWEEN 570 AND 869 AND NOT hour(ts)*60+minute(ts) BETWEEN 720 AND 809"
_MORE = {
    "h": _FIRST.format(id="symbol || ':A:' || rn", more="", rows=f"SELECT * FROM seta WHERE {_GATED} AND c_atr IS NULL", by="symbol, session"),
    "d": _FIRST.format(id="symbol || ':A:' || rn", more="", rows=f"SELECT * FROM seta WHERE {_GATED} AND c_atr IS NULL AND {_USUAL}", by="symbol, session"),
    "s": _FIRST.format(id="symbol || ':' || rn", more=", score", rows="SELECT sc.* FROM sc JOIN (SELECT symbol, session, max(bar_no) AS n FROM bar GROUP BY ALL) b USING (symbol, session) WHERE symbol IN (SELECT symbol FROM bar GROUP BY symbol HAVING count(*) >= 40) AND score >= 60 AND direction <> 'none' AND bar_no < n AND isodow(ts) < 6", by="symbol, session"),
    "w": _FIRST.format(id="param || ':' || symbol || ':A:' || rn", more=", param", rows=f"SELECT seta.*, param FROM seta CROSS JOIN (VALUES (0, 0.002, 0.02), (1, 0.004, 0.015), (2, 0.003, 0.012)) g(param, lo, hi) WHERE {_GATED} AND atr_share BETWEEN lo AND hi", by="param, symbol, session"),
}
for _k, _alerts in _MORE.items():
    PARTS[f"{_k}al"] = _alerts
    for _name in ("tch", "tg", "oc0", "oc1", "oc"):
        _text = re.sub(r"\b(al|tch|tg|oc0|oc1)\b", rf"{_k}\1", PARTS[_name])
        PARTS[f"{_k}{_name}"] = _text.replace("INTERVAL 180 MINUTE", "INTERVAL 45 MINUTE") if _k == "d" else _text


def _names() -> list[str]:
    return [k.split("(")[0] for k in PARTS]


def sql(select: str) -> str:
    """The select with the parts that it needs in front."""
    need, names = set(), dict(zip(_names(), PARTS, strict=True))

    def add(text: str) -> None:
        for word in set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", text)):
            if word in names and word not in need:
                need.add(word)
                add(PARTS[names[word]])

    add(select)
    parts = ",\n".join(f"{names[n]} AS {'' if '(' in names[n] else 'MATERIALIZED '}({PARTS[names[n]]})" for n in names if n in need)
    if parts and select.startswith("WITH "):  # the select's own parts come last
        return f"WITH RECURSIVE {parts},\n{select.removeprefix('WITH ')}"
    return f"WITH RECURSIVE {parts}\n{select}" if parts else select


def query(oracle: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = sql(oracle)
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; never negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *, keep: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *(r(v, digits).alias(v) for v in values))


def rsql(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n.split('=')[-1]}, {digits})+0.0 AS {n.split('=')[0]}" for n in names)
