"""Queries over bars: indicators, regimes, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.functions import frames as fr
from marketpulse.functions.numeric import num, round_columns
from marketpulse.operators import indicators as ind
from marketpulse.operators.joins import resample_ffill
from marketpulse.operators.series import over_series, running
from marketpulse.plans.sqlkit import DAILY, HOURLY, lag, rnd, strict, with_
from marketpulse.session import materialise
from marketpulse.sources import adapters as src
from marketpulse.sources.bars import day_stats


def q_bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return src.bars_hourly(spark, sf)


SQL_BARS_HOURLY = with_(HOURLY) + "SELECT * FROM hourly"


def q_day_stats(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(day_stats(src.bars_hourly(spark, sf)), {"price_change_24h": 6})


SQL_DAY_STATS = with_(HOURLY, """d AS (
  SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS ts, max(high) AS high_24h, min(low) AS low_24h,
         sum(volume) AS volume_24h, first(close ORDER BY ts) AS f, last(close ORDER BY ts) AS price
  FROM hourly GROUP BY 1, 2)""", """e AS (
  SELECT *, CASE WHEN f > 0 THEN (price - f) / f * 100 ELSE 0 END AS chg FROM d)""") + f"""
SELECT symbol, ts, high_24h, low_24h, volume_24h, price, {rnd('chg', 6, 'price_change_24h')} FROM e"""


def q_returns_and_sma(spark: SparkSession, sf: str) -> DataFrame:
    def step(d, w):
        d = ind.add_hl_ratio(ind.add_sma_distance(ind.add_returns(d, w), w))
        return d.withColumns({"ret_10": fr.change(F.col("close"), 10, w), "ret_20": fr.change(F.col("close"), 20, w),
                              "sma_5_filled": F.coalesce(fr.sma(F.col("close"), 5, w), num(0))})
    out = over_series(src.bars_daily(spark, sf), step, 199)
    cols = ["ret", "log_ret", "ret_10", "ret_20", "hl_ratio", "price_to_sma_20", "price_to_sma_50",
            "price_to_sma_200", "sma_20_50_cross", "sma_50_200_cross"]
    money = ["sma_20", "sma_50", "sma_200", "sma_5_filled"]
    out = out.select("symbol", "ts", *cols, *money)
    return round_columns(out, {c: 6 for c in cols + money})


SQL_RETURNS_AND_SMA = with_(DAILY, f"""a AS (
  SELECT symbol, ts, close, high, low, close / {lag('close')} - 1 AS ret, ln(close / {lag('close')}) AS log_ret,
    close / {lag('close', 10)} - 1 AS ret_10, close / {lag('close', 20)} - 1 AS ret_20,
    (high - low) / close AS hl_ratio, {strict('avg', 'close', 20)} AS sma_20, {strict('avg', 'close', 50)} AS sma_50,
    {strict('avg', 'close', 200)} AS sma_200, coalesce({strict('avg', 'close', 5)}, 0) AS sma_5_filled FROM daily)""",
    """b AS (SELECT *, (close - sma_20) / sma_20 AS price_to_sma_20, (close - sma_50) / sma_50 AS price_to_sma_50,
    (close - sma_200) / sma_200 AS price_to_sma_200, (sma_20 - sma_50) / sma_50 AS sma_20_50_cross,
    (sma_50 - sma_200) / sma_200 AS sma_50_200_cross FROM a)""") + "SELECT symbol, ts, " + ", ".join(
    [rnd(c) for c in ["ret", "log_ret", "ret_10", "ret_20", "hl_ratio", "price_to_sma_20", "price_to_sma_50",
                      "price_to_sma_200", "sma_20_50_cross", "sma_50_200_cross"]]
    + [rnd(c) for c in ["sma_20", "sma_50", "sma_200", "sma_5_filled"]]) + " FROM b"


def q_rolling_stats(spark: SparkSession, sf: str) -> DataFrame:
    def step(d, w):
        d = ind.add_returns(d, w)
        d = d.withColumns({
            "std_10": fr.std(F.col("ret"), 10, w), "std_24": fr.std(F.col("ret"), 24, w),
            "sum_5": fr.total(F.col("ret"), 5, w), "mean_20": fr.mean_partial(F.col("close"), 20, w),
            "volume_ratio_10": fr.volume_ratio(F.col("volume"), 10, w),
            "volume_ratio_24": fr.volume_ratio(F.col("volume"), 24, w),
            "close_diff": fr.diff(F.col("close"), w),
        })
        return d.withColumns({"close_diff2": fr.diff(F.col("close_diff"), w),
                              "annual_vol": F.col("std_24") * F.sqrt(num(24))})
    out = over_series(src.bars_hourly(spark, sf), step, 25)
    cols = ["std_10", "std_24", "sum_5", "mean_20", "volume_ratio_10", "volume_ratio_24", "close_diff",
            "close_diff2", "annual_vol"]
    return round_columns(out.select("symbol", "ts", *cols), {c: 5 for c in cols})


SQL_ROLLING_STATS = with_(HOURLY, f"""a AS (
  SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret, close - {lag('close')} AS close_diff,
    {strict('avg', 'volume', 10)} AS v10, {strict('avg', 'volume', 24)} AS v24,
    avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean_20
  FROM hourly)""", f"""b AS (
  SELECT *, {strict('stddev_samp', 'ret', 10)} AS std_10, {strict('stddev_samp', 'ret', 24)} AS std_24,
    {strict('sum', 'ret', 5)} AS sum_5, close_diff - {lag('close_diff')} AS close_diff2,
    volume / CASE WHEN v10 = 0 THEN 1 ELSE v10 END AS volume_ratio_10,
    volume / CASE WHEN v24 = 0 THEN 1 ELSE v24 END AS volume_ratio_24 FROM a)""",
    "c AS (SELECT *, std_24 * sqrt(24) AS annual_vol FROM b)") + "SELECT symbol, ts, " + ", ".join(
    rnd(c, 5) for c in ["std_10", "std_24", "sum_5", "mean_20", "volume_ratio_10", "volume_ratio_24", "close_diff",
                        "close_diff2", "annual_vol"]) + " FROM c"


def q_rsi_bollinger(spark: SparkSession, sf: str) -> DataFrame:
    def step(d, w):
        d = ind.add_rsi(d, w, 14)
        d = ind.add_rsi(d, w, 14, zero_loss="hundred", out="rsi_hundred")
        return ind.add_bollinger(d, w)
    out = over_series(src.bars_hourly(spark, sf), step, 20)
    return round_columns(out.select("symbol", "ts", "rsi", "rsi_hundred", "bb_position"),
                         {"rsi": 5, "rsi_hundred": 5, "bb_position": 5})


SQL_RSI_BOLLINGER = with_(HOURLY, f"a AS (SELECT *, close - {lag('close')} AS m FROM hourly)", f"""b AS (
  SELECT *, avg(CASE WHEN m > 0 THEN m ELSE 0 END) OVER r AS up, avg(CASE WHEN m < 0 THEN -m ELSE 0 END) OVER r AS dn,
    count(*) OVER r AS n, count(m) OVER r AS nm, {strict('avg', 'close', 20)} AS mid,
    {strict('stddev_samp', 'close', 20)} AS dev
  FROM a WINDOW r AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))""", """c AS (
  SELECT symbol, ts,
    CASE WHEN n >= 14 THEN 100 - 100 / (1 + up / CASE WHEN dn = 0 THEN 1 ELSE dn END) END AS rsi,
    CASE WHEN nm < 14 THEN 0 WHEN dn = 0 THEN 100 ELSE 100 - 100 / (1 + up / nullif(dn, 0)) END AS rsi_hundred,
    CASE WHEN dev IS NOT NULL THEN least(greatest((close - (mid - 2 * dev)) /
      CASE WHEN (mid + 2 * dev) - (mid - 2 * dev) = 0 THEN 1 ELSE (mid + 2 * dev) - (mid - 2 * dev) END, 0), 1)
      END AS bb_position
  FROM b)""") + "SELECT symbol, ts, " + ", ".join(rnd(c, 5) for c in ["rsi", "rsi_hundred", "bb_position"]) + " FROM c"


def q_macd_ewm(spark: SparkSession, sf: str) -> DataFrame:
    out = ind.macd(src.bars_hourly(spark, sf)).select("symbol", "ts", "macd", "macd_signal")
    return round_columns(out, {"macd": 5, "macd_signal": 5})


# The check walks the recursion row by row: sum and weight of each mean.
SQL_MACD_EWM = "WITH RECURSIVE " + ",\n".join([HOURLY, """r AS (
  SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM hourly)""", """s AS (
  SELECT symbol, ts, rn, close AS f, 1.0::DOUBLE AS fw, close AS s, 1.0::DOUBLE AS sw, 0.0::DOUBLE AS macd,
         0.0::DOUBLE AS g, 1.0::DOUBLE AS gw FROM r WHERE rn = 1
  UNION ALL
  SELECT symbol, ts, rn, f, fw, s, sw, f / fw - s / sw, (f / fw - s / sw) + g * 0.8::DOUBLE, 1 + gw * 0.8::DOUBLE
  FROM (SELECT r.symbol, r.ts, r.rn, r.close + s.f * (11.0::DOUBLE / 13) AS f, 1 + s.fw * (11.0::DOUBLE / 13) AS fw,
               r.close + s.s * (25.0::DOUBLE / 27) AS s, 1 + s.sw * (25.0::DOUBLE / 27) AS sw, s.g, s.gw
        FROM s JOIN r ON r.symbol = s.symbol AND r.rn = s.rn + 1))""",
    "t AS (SELECT symbol, ts, macd, g / gw AS macd_signal FROM s)"]) + f"""
SELECT symbol, ts, {rnd('macd', 5)}, {rnd('macd_signal', 5)} FROM t"""


def q_atr_adx(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["true_range", "atr", "plus_di", "minus_di", "dx", "adx"]
    return round_columns(ind.adx(src.bars_hourly(spark, sf)).select("symbol", "ts", *cols), {c: 5 for c in cols})


def adx_ctes(source: str, keep: str = "") -> list[str]:
    """CTEs ending in ``adx_rows``."""
    return [f"""x1 AS (
  SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS true_range,
    high - {lag('high')} AS up, {lag('low')} - low AS dn FROM {source})""", f"""x2 AS (
  SELECT *, {strict('avg', 'true_range', 14)} AS atr, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm,
    CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM x1)""", f"""x3 AS (
  SELECT *, 100 * ({strict('avg', 'pdm', 14)}) / CASE WHEN atr = 0 THEN 1 ELSE atr END AS plus_di,
    100 * ({strict('avg', 'mdm', 14)}) / CASE WHEN atr = 0 THEN 1 ELSE atr END AS minus_di FROM x2)""",
    """x4 AS (SELECT *, 100 * abs(plus_di - minus_di) /
    CASE WHEN plus_di + minus_di = 0 THEN 1 ELSE plus_di + minus_di END AS dx FROM x3)""",
    f"adx_rows AS (SELECT *, {strict('avg', 'dx', 14)} AS adx FROM x4)"]


SQL_ATR_ADX = with_(HOURLY, *adx_ctes("hourly")) + "SELECT symbol, ts, " + ", ".join(
    rnd(c, 5) for c in ["true_range", "atr", "plus_di", "minus_di", "dx", "adx"]) + " FROM adx_rows"


def q_resample_ffill(spark: SparkSession, sf: str) -> DataFrame:
    return resample_ffill(src.bars_hourly(spark, sf), "30 minutes").select("symbol", "ts", "bar_ts", "close")


SQL_RESAMPLE_FFILL = with_(HOURLY, """span AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM hourly GROUP BY 1)""",
                           """grid AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 30 MINUTE))::TIMESTAMP AS ts
  FROM span)""") + """
SELECT g.symbol, g.ts, h.ts AS bar_ts, h.close
FROM grid g ASOF JOIN hourly h ON g.symbol = h.symbol AND g.ts >= h.ts"""


def q_standardise_outliers(spark: SparkSession, sf: str) -> DataFrame:
    bars = ind.momentum(src.bars_hourly(spark, sf), n=14).select("symbol", "ts", "close", "volume", "momentum")
    bars = materialise(bars, "bars")
    out = ind.percentile_rank(ind.outliers(ind.standardise(bars, ["close", "volume"]), "close"), "close")
    return round_columns(out, {"momentum": 6, "z_close": 6, "z_volume": 6, "pct_rank": 6})


SQL_STANDARDISE_OUTLIERS = with_(HOURLY, f"""a AS (
  SELECT symbol, ts, close, volume,
    coalesce((close - {lag('close', 14)}) / nullif(abs({lag('close', 14)}), 0), 0) AS momentum,
    avg(close) OVER p AS mc, stddev_pop(close) OVER p AS sc, avg(volume) OVER p AS mv, stddev_pop(volume) OVER p AS sv,
    count(*) OVER p AS n, cume_dist() OVER (PARTITION BY symbol ORDER BY close) * 100 AS pct_rank
  FROM hourly WINDOW p AS (PARTITION BY symbol))""", """b AS (
  SELECT *, (close - mc) / CASE WHEN sc = 0 THEN 1 ELSE sc END AS z_close,
    (volume - mv) / CASE WHEN sv = 0 THEN 1 ELSE sv END AS z_volume,
    coalesce(n >= 3 AND abs(close - mc) / nullif(sc, 0) > 3, false) AS is_outlier FROM a)""") + f"""
SELECT symbol, ts, close, volume, {rnd('momentum')}, {rnd('z_close')}, {rnd('z_volume')}, is_outlier,
  {rnd('pct_rank')} FROM b"""


def q_ewm_spans(spark: SparkSession, sf: str) -> DataFrame:
    d = src.bars_hourly(spark, sf).select("symbol", "ts", "close")
    for span in (2, 3, 9, 26, 1000):
        d = ind.ewm(d, "close", span)
    names = [f"ewm_{s}" for s in (2, 3, 9, 26, 1000)]
    return round_columns(d.select("symbol", "ts", *names), {n: 7 for n in names})


# The check sums the weights of all earlier rows of each row.
SQL_EWM_SPANS = with_(HOURLY, """r AS (
  SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM hourly)""", "t AS (SELECT a.symbol, a.ts, " + ", ".join(
    f"sum(b.close * pow(1 - 2.0::DOUBLE / {s + 1}, a.rn - b.rn)) / sum(pow(1 - 2.0::DOUBLE / {s + 1}, a.rn - b.rn)) AS ewm_{s}" for s in (2, 3, 9, 26, 1000))
    + " FROM r a JOIN r b ON a.symbol = b.symbol AND b.rn <= a.rn GROUP BY 1, 2)") + "SELECT symbol, ts, " + ", ".join(
    rnd(f"ewm_{s}", 7) for s in (2, 3, 9, 26, 1000)) + " FROM t"


def _with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Events of which one type has no name and each 97th no time."""
    return src.table(spark, sf, "events").select(
        "event_id", F.expr("nullif(event_type, 'view')").alias("symbol"),
        F.expr("CASE WHEN event_id % 97 <> 0 THEN ts END").alias("ts"), "value")


def q_null_keys(spark: SparkSession, sf: str) -> DataFrame:
    order = ("ts", "event_id")
    counted = running(_with_nulls(spark, sf), {"seen": ("count", F.col("event_id")), "top": ("max", F.col("value"))}, order=order)
    return over_series(counted, lambda d, w: d.withColumn("before", F.lag("event_id", 2).over(w)), 2, order=order, numbered=True).select(
        "event_id", "symbol", "ts", "seen", "top", "before", F.col("_rn").alias("place"))


SQL_NULL_KEYS = """
WITH d AS (SELECT event_id, nullif(event_type, 'view') AS symbol, CASE WHEN event_id % 97 <> 0 THEN ts END AS ts, value FROM events)
SELECT event_id, symbol, ts, count(*) OVER w AS seen, max(value) OVER w AS top,
  lag(event_id, 2) OVER (PARTITION BY symbol ORDER BY ts NULLS FIRST, event_id) AS before,
  row_number() OVER (PARTITION BY symbol ORDER BY ts NULLS FIRST, event_id) AS place
FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts NULLS FIRST, event_id ROWS UNBOUNDED PRECEDING)"""


QUERIES = {
    "ewm_spans": (q_ewm_spans, SQL_EWM_SPANS),
    "null_keys": (q_null_keys, SQL_NULL_KEYS),
    "bars_hourly": (q_bars_hourly, SQL_BARS_HOURLY),
    "day_stats": (q_day_stats, SQL_DAY_STATS),
    "returns_and_sma": (q_returns_and_sma, SQL_RETURNS_AND_SMA),
    "rolling_stats": (q_rolling_stats, SQL_ROLLING_STATS),
    "rsi_bollinger": (q_rsi_bollinger, SQL_RSI_BOLLINGER),
    "macd_ewm": (q_macd_ewm, SQL_MACD_EWM),
    "atr_adx": (q_atr_adx, SQL_ATR_ADX),
    "resample_ffill": (q_resample_ffill, SQL_RESAMPLE_FFILL),
    "standardise_outliers": (q_standardise_outliers, SQL_STANDARDISE_OUTLIERS),
}
