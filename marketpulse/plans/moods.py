"""Queries over scored posts: aggregates, index, signals, flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.functions.numeric import num, round_columns
from marketpulse.operators import fear_greed as fg
from marketpulse.operators import flow as fl
from marketpulse.operators import indicators as ind
from marketpulse.operators import sentiment as se
from marketpulse.operators import signals as sg
from marketpulse.operators.timeframes import rolling_time_mean, time_momentum
from marketpulse.plans.sqlkit import HOURLY, PRICE_SENT, SENT_HOURLY, SENTIMENT, lag, rnd, strict, with_
from marketpulse.session import materialise
from marketpulse.sources import adapters as src

AS_OF_WINDOW = 86400

_INFLUENCE = """least(CASE WHEN verified THEN 1.2 ELSE 1 END::DOUBLE
    * CASE WHEN followers > 100 THEN 1 + log10(followers) * 0.1 ELSE 1 END
    * CASE WHEN karma > 100 THEN 1 + log10(karma) * 0.1 ELSE 1 END, 3)"""
_CREDIBILITY = """CASE source WHEN 'twitter' THEN CASE WHEN verified THEN 1.2 ELSE 1.0 END
    WHEN 'reddit' THEN CASE WHEN karma > 1000 THEN 1.1 ELSE 1.0 END WHEN 'news' THEN 1.5 ELSE 1.0 END::DOUBLE"""


def _decay(age: str) -> str:
    return f"exp(-ln(2.0::DOUBLE) * greatest({age}, 0) / 14400)"


def q_sentiment_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    out = se.aggregate_sentiment(src.sentiment(spark, sf), window=AS_OF_WINDOW)
    parts = F.transform(F.map_entries("breakdown"), lambda e: F.concat(
        e["key"], F.lit("="), F.format_string("%.6f", F.round(e["value"], 6))))
    out = out.withColumn("breakdown", F.array_join(parts, ","))
    return round_columns(out, {"score": 6, "fear_greed_score": 6, "confidence": 6})


SQL_SENTIMENT_AGGREGATE = with_(SENTIMENT, "newest AS (SELECT max(ts) AS as_of FROM sentiment)", f"""w AS (
  SELECT asset, source, score, {_CREDIBILITY} * {_INFLUENCE} * {_decay("date_diff('microsecond', ts, as_of) / 1e6")} AS w
  FROM sentiment, newest WHERE ts >= as_of - INTERVAL {AS_OF_WINDOW} SECOND)""", """both_ AS (
  SELECT * FROM w UNION ALL SELECT 'OVERALL', source, score, w FROM w)""", """br AS (
  SELECT asset, string_agg(source || '=' || printf('%.6f', round(m, 6) + 0.0), ',' ORDER BY source) AS breakdown
  FROM (SELECT asset, source, avg(score) AS m FROM both_ GROUP BY 1, 2) GROUP BY 1)""", """a AS (
  SELECT asset, least(greatest(sum(score * w) / sum(w), -1), 1) AS score, count(*) AS volume FROM both_ GROUP BY 1)""",
    "b AS (SELECT *, (score + 1) / 2 * 100 AS idx, least(volume / 50.0::DOUBLE, 1) AS conf FROM a JOIN br USING (asset))") + f"""
SELECT asset, {rnd('score')}, {rnd('idx', 6, 'fear_greed_score')}, volume, {rnd('conf', 6, 'confidence')}, breakdown FROM b"""


def q_sentiment_series(spark: SparkSession, sf: str) -> DataFrame:
    out = se.sentiment_series(src.sentiment(spark, sf), step=1800, window=3600)
    out = out.select("asset", "as_of", "score", "fear_greed_score", "volume", "momentum")
    return round_columns(out, {"score": 6, "fear_greed_score": 6, "momentum": 6})


SQL_SENTIMENT_SERIES = with_(SENTIMENT, """grid AS (
  SELECT *, epoch_us(ts) AS t, unnest(generate_series(CAST(ceil(epoch_us(ts) / 1.8e9) AS BIGINT),
    CAST(floor((epoch_us(ts) + 3600000000) / 1.8e9) AS BIGINT))) AS slot FROM sentiment)""", f"""w AS (
  SELECT asset, source, score, slot, {_CREDIBILITY} * {_INFLUENCE} * {_decay('(slot * 1800000000 - t) / 1e6')} AS w FROM grid)""",
    """a AS (SELECT asset, slot, least(greatest(sum(score * w) / sum(w), -1), 1) AS score, count(*) AS volume
  FROM w GROUP BY 1, 2)""", """m AS (
  SELECT *, coalesce(score - last(score) OVER (PARTITION BY asset ORDER BY slot RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING), 0)
    AS momentum, (score + 1) / 2 * 100 AS idx FROM a)""") + f"""
SELECT asset, make_timestamp(slot * 1800000000) AS as_of, {rnd('score')}, {rnd('idx', 6, 'fear_greed_score')}, volume,
  {rnd('momentum')} FROM m"""


def q_rolling_time_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    sent = src.sentiment(spark, sf)
    means = rolling_time_mean(sent, "score")
    moved = time_momentum(means, "mean_1h")
    return round_columns(moved, {"mean_1h": 9, "mean_4h": 9, "mean_24h": 9, "momentum": 9})


def _range(x: str, hours: int) -> str:
    return (f"OVER (PARTITION BY asset ORDER BY t RANGE BETWEEN {hours * 3600 * 1000000 - 1} PRECEDING AND CURRENT ROW)")


SQL_ROLLING_TIME_SENTIMENT = with_(SENTIMENT, """m AS (
  SELECT asset, ts, epoch_us(ts) AS t, sum(score) AS s, count(*) AS n FROM sentiment GROUP BY 1, 2)""", """a AS (
  SELECT asset, ts, t, """ + ", ".join(
    f"sum(s) {_range('s', h)} / sum(n) {_range('n', h)} AS mean_{h}h" for h in (1, 4, 24)) + " FROM m)", """b AS (
  SELECT *, coalesce(mean_1h - last(mean_1h) OVER (PARTITION BY asset ORDER BY t
    RANGE BETWEEN 3600000000 PRECEDING AND 900000000 PRECEDING), 0) AS momentum FROM a)""") + f"""
SELECT asset, ts, {rnd('mean_1h', 9)}, {rnd('mean_4h', 9)}, {rnd('mean_24h', 9)}, {rnd('momentum', 9)} FROM b"""


def q_sentiment_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(se.sentiment_heatmap(src.sentiment(spark, sf)), {"mean_score": 6})


SQL_SENTIMENT_HEATMAP = with_(SENTIMENT, """h AS (
  SELECT source, date_trunc('hour', ts)::TIMESTAMP AS hour, avg(score) AS m FROM sentiment GROUP BY 1, 2)""") + f"""
SELECT source, hour, {rnd('m', 6, 'mean_score')} FROM h"""


def q_source_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(se.source_breakdown(src.sentiment(spark, sf)), {"mean_score": 6})


SQL_SOURCE_BREAKDOWN = with_(SENTIMENT, "b AS (SELECT asset, source, avg(score) AS m, count(*) AS n FROM sentiment GROUP BY 1, 2)") + f"""
SELECT asset, source, {rnd('m', 6, 'mean_score')}, n FROM b"""


def _index_input(spark: SparkSession, sf: str) -> DataFrame:
    hourly = src.sentiment_hourly(spark, sf).select("symbol", "ts", "sentiment", F.col("posts").alias("mentions"))
    bars = src.bars_hourly(spark, sf).select("symbol", "ts", F.col("close").alias("price"), "volume")
    shares = F.lit(40.0) + F.col("volume") % 31
    return bars.join(hourly, ["symbol", "ts"]).withColumn("dominance", shares)


def q_fear_greed_index(spark: SparkSession, sf: str) -> DataFrame:
    out = fg.fear_greed_index(_index_input(spark, sf))
    cols = [f"c_{k}" for k in fg.WEIGHTS]
    out = out.select("symbol", "ts", "fear_greed_index", "label", *cols)
    return round_columns(out, {c: 6 for c in ["fear_greed_index", *cols]})


def _ratio(x: str) -> str:
    r = f"({x} / nullif(avg({x}) OVER b, 0))"
    return f"CASE WHEN {r} IS NULL THEN 50 WHEN {r} < 0.5 THEN 0 WHEN {r} > 2 THEN 100 ELSE ({r} - 0.5) / 1.5 * 100 END::DOUBLE"


INDEX_CTES = [HOURLY, SENTIMENT, SENT_HOURLY, """ii AS (
  SELECT symbol, ts, close AS price, volume, sentiment, posts::DOUBLE AS mentions, 40.0 + volume % 31 AS dom
  FROM hourly JOIN sent_hourly USING (symbol, ts))""", f"""comp AS (
  SELECT symbol, ts, sentiment, (least(greatest(sentiment, -1), 1) + 1) / 2 * 100 AS c_sentiment,
    {_ratio('volume')} AS c_volume_momentum, {_ratio('mentions')} AS c_social_volume,
    CASE WHEN count(*) OVER c < 5 THEN 50 WHEN stddev_pop(price) OVER c / nullif(avg(price) OVER c, 0) >= 0.05 THEN 0
      WHEN avg(price) OVER c = 0 THEN 50
      ELSE (1 - stddev_pop(price) OVER c / avg(price) OVER c / 0.05) * 100 END::DOUBLE AS c_volatility,
    CASE WHEN dom >= 70 THEN 0 WHEN dom <= 40 THEN 100 ELSE (70 - dom) / 30 * 100 END::DOUBLE AS c_dominance,
    50.0::DOUBLE AS c_trends FROM ii
  WINDOW b AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING),
    c AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))""", """idx AS (
  SELECT *, least(greatest(c_sentiment * 0.25 + c_volume_momentum * 0.25 + c_volatility * 0.15 + c_social_volume * 0.15
    + c_dominance * 0.1 + c_trends * 0.1, 0), 100) AS fear_greed_index FROM comp)"""]
SQL_FEAR_GREED_INDEX = with_(*INDEX_CTES) + f"""
SELECT symbol, ts, {rnd('fear_greed_index')}, CASE WHEN fear_greed_index < 25 THEN 'Extreme Fear'
    WHEN fear_greed_index < 45 THEN 'Fear' WHEN fear_greed_index <= 55 THEN 'Neutral'
    WHEN fear_greed_index <= 75 THEN 'Greed' ELSE 'Extreme Greed' END AS label,
  {', '.join(rnd(f'c_{k}') for k in fg.WEIGHTS)} FROM idx"""


def trade_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of the hourly sentiment; every post counts as a source."""
    hourly = src.sentiment_hourly(spark, sf).select(
        "symbol", "ts", F.col("sentiment").alias("sentiment_score"), F.col("posts").alias("source_count"))
    return sg.signals(hourly, min_confidence=0.5)


SIGNAL_CTES = [SENTIMENT, SENT_HOURLY, """s1 AS (
  SELECT symbol, ts, sentiment AS s, posts, (least(greatest(sentiment, -1), 1) - (-1)) / 2 * 100 AS fgi FROM sent_hourly)""",
    """s2 AS (SELECT *, CASE WHEN fgi > 75 THEN 'STRONG_BUY' WHEN fgi > 60 THEN 'BUY' WHEN fgi > 40 THEN 'HOLD'
      WHEN fgi > 25 THEN 'SELL' ELSE 'STRONG_SELL' END AS action,
    CASE WHEN fgi > 75 THEN least((fgi - 75) / 25, 1) WHEN fgi > 60 THEN (fgi - 60) / 15 * 0.8 WHEN fgi > 40 THEN 0.5
      WHEN fgi > 25 THEN (1 - (fgi - 25) / 15) * 0.8 ELSE least(1 - fgi / 25, 1) END::DOUBLE AS strength,
    least((1 - abs((fgi - 50) / 50 - s) / 2) * 0.4 + least(posts / 10.0::DOUBLE, 1) * 0.3 + abs(s) * 0.3, 1) AS confidence
  FROM s1)""", """sig AS (
  SELECT *, least(greatest(strength * confidence * 0.05, 0.02), 0.10) AS position_size FROM s2 WHERE confidence >= 0.5)"""]


def q_signals(spark: SparkSession, sf: str) -> DataFrame:
    out = trade_signals(spark, sf)
    out = out.select("symbol", "ts", "action", "strength", "confidence", "position_size", "fear_greed_index",
                     "sentiment_score", "reasoning")
    return round_columns(out, {c: 6 for c in ["strength", "confidence", "position_size", "fear_greed_index",
                                              "sentiment_score"]})


SQL_SIGNALS = with_(*SIGNAL_CTES) + f"""
SELECT symbol, ts, action, {rnd('strength')}, {rnd('confidence')}, {rnd('position_size')},
  {rnd('fgi', 6, 'fear_greed_index')}, {rnd('s', 6, 'sentiment_score')},
  'Market shows ' || CASE WHEN fgi < 25 THEN 'extreme fear' WHEN fgi < 40 THEN 'fear' WHEN fgi < 60 THEN 'neutral'
    WHEN fgi < 75 THEN 'greed' ELSE 'extreme greed' END || ' (FGI: ' || printf('%.1f', fgi) || ') with ' ||
  CASE WHEN s < -0.3 THEN 'very negative' WHEN s < -0.1 THEN 'negative' WHEN s < 0.1 THEN 'neutral'
    WHEN s < 0.3 THEN 'positive' ELSE 'very positive' END || ' sentiment (score: ' || printf('%.2f', s) || '). '
  || action || ' signal generated with ' || CASE WHEN confidence > 0.7 THEN 'high' WHEN confidence > 0.5 THEN 'moderate'
    ELSE 'low' END || ' confidence (' || printf('%.2f', confidence) || ').' AS reasoning
FROM sig"""


def q_signals_cooled(spark: SparkSession, sf: str) -> DataFrame:
    hourly = src.sentiment_hourly(spark, sf).select(
        "symbol", "ts", F.col("sentiment").alias("sentiment_score"), F.col("posts").alias("source_count"))
    out = sg.signals(hourly, min_confidence=0.5, cooldown=150, max_per_day=3)
    return round_columns(out.select("symbol", "ts", "action", "confidence"), {"confidence": 6})


# The check walks from signal to signal.
SQL_SIGNALS_COOLED = "WITH RECURSIVE " + ",\n".join([*SIGNAL_CTES, "act AS (SELECT * FROM sig WHERE action <> 'HOLD')", """walk AS (
  SELECT symbol, min(ts) AS ts FROM act GROUP BY 1
  UNION ALL
  SELECT w.symbol, n.ts FROM walk w, LATERAL (SELECT min(a.ts) AS ts FROM act a
    WHERE a.symbol = w.symbol AND a.ts >= w.ts + INTERVAL 150 MINUTE) n WHERE n.ts IS NOT NULL)""", """lft AS (
  SELECT * FROM sig WHERE action = 'HOLD' UNION ALL SELECT act.* FROM act JOIN walk USING (symbol, ts))""", """dy AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) AS rn FROM lft)"""]) + f"""
SELECT symbol, ts, action, {rnd('confidence')} FROM dy WHERE rn <= 3"""


def q_signal_summary(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(sg.signal_summary(trade_signals(spark, sf)), {"avg_confidence": 6})


_COUNTS = ", ".join(f"count(*) FILTER (action = '{a}') AS {a.lower()}" for a in sg.ACTIONS)
SQL_SIGNAL_SUMMARY = with_(*SIGNAL_CTES, f"""t AS (
  SELECT symbol, count(*) AS total, {_COUNTS}, avg(confidence) AS c, last(action ORDER BY ts) AS last_action
  FROM sig GROUP BY 1)""") + f"""
SELECT symbol, total, {', '.join(a.lower() for a in sg.ACTIONS)}, {rnd('c', 6, 'avg_confidence')}, last_action FROM t"""


def q_signals_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return sg.signals_per_day(trade_signals(spark, sf))


SQL_SIGNALS_PER_DAY = with_(*SIGNAL_CTES) + f"SELECT date_trunc('day', ts)::TIMESTAMP AS day, {_COUNTS} FROM sig GROUP BY 1"


def q_recent_signals(spark: SparkSession, sf: str) -> DataFrame:
    out = sg.recent_signals(trade_signals(spark, sf), 100).select("symbol", "ts", "action", "confidence")
    return round_columns(out, {"confidence": 6})


SQL_RECENT_SIGNALS = with_(*SIGNAL_CTES, """r AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM sig)""") + f"""
SELECT symbol, ts, action, {rnd('confidence')} FROM r WHERE rn <= 100"""


def q_ma_sentiment_signal(spark: SparkSession, sf: str) -> DataFrame:
    out = sg.ma_sentiment_signal(src.price_sentiment(spark, sf), threshold=0.1)
    return out.select("symbol", "ts", F.col("signal").cast("bigint").alias("signal"))


MA_CTES = [HOURLY, SENTIMENT, SENT_HOURLY, PRICE_SENT, f"""ma AS (
  SELECT *, ({strict('avg', 'close', 20)}) - ({strict('avg', 'close', 50)}) AS gap,
    row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM price_sent)""", """masig AS (
  SELECT symbol, ts, close, CASE WHEN rn > 50 AND gap > 0 AND sentiment > 0.1 THEN 1
    WHEN rn > 50 AND gap < 0 AND sentiment < -0.1 THEN -1 ELSE 0 END::BIGINT AS signal FROM ma)"""]
SQL_MA_SENTIMENT_SIGNAL = with_(*MA_CTES) + "SELECT symbol, ts, signal FROM masig"


def q_signal_returns(spark: SparkSession, sf: str) -> DataFrame:
    sig = materialise(sg.ma_sentiment_signal(src.price_sentiment(spark, sf), threshold=0.1), "signals")
    rets = materialise(ind.signal_returns(sig).where(F.col("signal_ret").isNotNull()), "returns")
    out = ind.cum_growth(rets, "signal_ret").select("symbol", "ts", "signal_ret", "growth")
    return round_columns(out, {"signal_ret": 6, "growth": 6})


SQL_SIGNAL_RETURNS = with_(*MA_CTES, """sr AS (
  SELECT symbol, ts, CASE WHEN signal <> 0 THEN signal * (lead(close) OVER w / nullif(close, 0) - 1) END AS signal_ret
  FROM masig WINDOW w AS (PARTITION BY symbol ORDER BY ts))""", """g AS (
  SELECT *, product(1 + signal_ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    AS gr, min(1 + signal_ret) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lo
  FROM sr WHERE signal_ret IS NOT NULL)""", "gg AS (SELECT *, CASE WHEN lo <= 0 THEN 0 ELSE gr END AS growth FROM g)") + f"""
SELECT symbol, ts, {rnd('signal_ret')}, {rnd('growth')} FROM gg"""


def q_fund_flow(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["net_flow", "inflow", "outflow", "exchange_netflow", "correlation_score"]
    return round_columns(fl.fund_flow(src.bars_hourly(spark, sf)), {c: 6 for c in cols})


FLOW_CTES = [HOURLY, f"""r1 AS (
  SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM hourly)""", """r2 AS (
  SELECT *, count(*) OVER f AS n, avg(volume) OVER f AS av, avg(ret) OVER g AS mom, stddev_samp(ret) OVER g AS vol,
    covar_pop(volume, close) OVER f / nullif(stddev_pop(volume) OVER f * stddev_pop(close) OVER f, 0) AS r,
    list(volume) OVER f AS vs FROM r1
  WINDOW f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
    g AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 22 PRECEDING AND CURRENT ROW))""", """r3 AS (
  SELECT *, volume * mom * CASE WHEN av > 0 THEN volume / av ELSE 1 END AS net_flow FROM r2 WHERE n >= 24)""", """flow AS (
  SELECT symbol, ts, net_flow, greatest(net_flow, 0) AS inflow, CASE WHEN net_flow > 0 THEN 0 ELSE abs(net_flow) END AS outflow,
    len(list_filter(vs, lambda x: x > av * 2)) AS whale_transactions, -net_flow * vol AS exchange_netflow,
    coalesce(r, 0) AS correlation_score FROM r3)"""]
SQL_FUND_FLOW = with_(*FLOW_CTES) + f"""
SELECT symbol, ts, {rnd('net_flow')}, {rnd('inflow')}, {rnd('outflow')}, whale_transactions, {rnd('exchange_netflow')},
  {rnd('correlation_score')} FROM flow"""


def _scaled_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Flows in single units are far below the billions of the rule: scale them up."""
    flow = fl.fund_flow(src.bars_hourly(spark, sf))
    return flow.withColumn("net_flow", F.col("net_flow") * num(1e9))


def q_flow_signal(spark: SparkSession, sf: str) -> DataFrame:
    out = fl.flow_change(fl.flow_signal(materialise(_scaled_flow(spark, sf), "flow")))
    out = out.select("symbol", "ts", "flow_score", "flow_strength", "recommendation", "flow_change_pct")
    return round_columns(out, {"flow_score": 6, "flow_strength": 6, "flow_change_pct": 4})


SQL_FLOW_SIGNAL = with_(*FLOW_CTES, """f1 AS (
  SELECT *, net_flow * 1e9::DOUBLE AS nf FROM flow)""", """f2 AS (
  SELECT *, CASE WHEN nf > 0 THEN 1 ELSE -1 END * least(abs(nf) / 1e9, 1) * abs(correlation_score) AS fs,
    (abs(correlation_score) + least(whale_transactions / 10.0::DOUBLE, 1)) / 2 AS st,
    lag(nf, 23) OVER (PARTITION BY symbol ORDER BY ts) AS old FROM f1)""", """f3 AS (
  SELECT *, coalesce((nf - old) / nullif(abs(old), 0) * 100, 0) AS ch, CASE WHEN fs > 0.3 AND st > 0.5 THEN 'STRONG_BUY'
    WHEN fs > 0.1 THEN 'BUY' WHEN fs < -0.3 AND st > 0.5 THEN 'STRONG_SELL' WHEN fs < -0.1 THEN 'SELL'
    ELSE 'NEUTRAL' END AS recommendation FROM f2)""") + f"""
SELECT symbol, ts, {rnd('fs', 6, 'flow_score')}, {rnd('st', 6, 'flow_strength')}, recommendation,
  {rnd('ch', 4, 'flow_change_pct')} FROM f3"""


def q_flow_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(fl.flow_correlation(fl.fund_flow(src.bars_hourly(spark, sf))), {"correlation": 6})


SQL_FLOW_CORRELATION = with_(*FLOW_CTES, """t AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM flow)""", """p AS (
  SELECT a.symbol AS market1, b.symbol AS market2, count(*) AS n,
    covar_pop(a.net_flow, b.net_flow) / nullif(stddev_pop(a.net_flow) * stddev_pop(b.net_flow), 0) AS r
  FROM t a JOIN t b ON a.ts = b.ts AND a.symbol < b.symbol WHERE a.rn <= 24 AND b.rn <= 24 GROUP BY 1, 2)""",
    "q AS (SELECT *, CASE WHEN n >= 10 THEN coalesce(r, 0) ELSE 0 END AS correlation FROM p)") + f"""
SELECT market1, market2, {rnd('correlation')}, n FROM q"""


QUERIES = {
    "sentiment_aggregate": (q_sentiment_aggregate, SQL_SENTIMENT_AGGREGATE),
    "sentiment_series": (q_sentiment_series, SQL_SENTIMENT_SERIES),
    "rolling_time_sentiment": (q_rolling_time_sentiment, SQL_ROLLING_TIME_SENTIMENT),
    "sentiment_heatmap": (q_sentiment_heatmap, SQL_SENTIMENT_HEATMAP),
    "source_breakdown": (q_source_breakdown, SQL_SOURCE_BREAKDOWN),
    "fear_greed_index": (q_fear_greed_index, SQL_FEAR_GREED_INDEX),
    "signals": (q_signals, SQL_SIGNALS),
    "signals_cooled": (q_signals_cooled, SQL_SIGNALS_COOLED),
    "signal_summary": (q_signal_summary, SQL_SIGNAL_SUMMARY),
    "signals_per_day": (q_signals_per_day, SQL_SIGNALS_PER_DAY),
    "recent_signals": (q_recent_signals, SQL_RECENT_SIGNALS),
    "ma_sentiment_signal": (q_ma_sentiment_signal, SQL_MA_SENTIMENT_SIGNAL),
    "signal_returns": (q_signal_returns, SQL_SIGNAL_RETURNS),
    "fund_flow": (q_fund_flow, SQL_FUND_FLOW),
    "flow_signal": (q_flow_signal, SQL_FLOW_SIGNAL),
    "flow_correlation": (q_flow_correlation, SQL_FLOW_CORRELATION),
}
