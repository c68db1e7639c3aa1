"""Queries over trades, equity and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.functions.numeric import round_columns
from marketpulse.operators import indicators as ind
from marketpulse.operators import risk
from marketpulse.operators import trades as tr
from marketpulse.operators.joins import asof_join
from marketpulse.plans.moods import SIGNAL_CTES, trade_signals
from marketpulse.plans.sqlkit import HOURLY, PRICE_SENT, lag, rnd, with_
from marketpulse.session import materialise
from marketpulse.sources import adapters as src

STOP, TAKE = 0.5, 2.0


def q_asof_price(spark: SparkSession, sf: str) -> DataFrame:
    sig = trade_signals(spark, sf).select("symbol", "ts", "action")
    shifted = sig.withColumn("ts", F.col("ts") + F.expr("interval 90 minutes"))
    return asof_join(shifted, src.bars_hourly(spark, sf), ("close",), tolerance=3600)


SQL_ASOF_PRICE = with_(HOURLY, *SIGNAL_CTES, """e AS (
  SELECT symbol, ts + INTERVAL 90 MINUTE AS ts, action FROM sig)""", """j AS (
  SELECT e.*, h.ts AS bar_ts, h.close FROM e ASOF LEFT JOIN hourly h ON e.symbol = h.symbol AND e.ts >= h.ts)""") + """
SELECT symbol, ts, action, CASE WHEN ts - bar_ts <= INTERVAL 1 HOUR THEN bar_ts END AS bar_ts,
  CASE WHEN ts - bar_ts <= INTERVAL 1 HOUR THEN close END AS close FROM j"""


def _trades(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    bars = materialise(src.bars_hourly(spark, sf), "bars")
    return tr.extract_trades(trade_signals(spark, sf), bars, stop=STOP, take=TAKE), bars


def done_trades(spark: SparkSession, sf: str) -> DataFrame:
    return _trades(spark, sf)[0]


def trade_ctes(check: str = "bars") -> list[str]:
    checks = "SELECT symbol, ts, close FROM hourly" if check == "bars" else "SELECT symbol, ts, close FROM px"
    return [HOURLY, *SIGNAL_CTES, """px AS (
  SELECT g.*, CASE WHEN action IN ('BUY', 'STRONG_BUY') THEN 1 WHEN action IN ('SELL', 'STRONG_SELL') THEN -1 ELSE 0 END AS side,
    h.close FROM sig g ASOF JOIN hourly h ON g.symbol = h.symbol AND g.ts >= h.ts)""", """runs AS (
  SELECT *, lag(side) OVER (PARTITION BY symbol ORDER BY ts) AS was FROM px WHERE side <> 0)""", """opened AS (
  SELECT symbol, ts, action, side, confidence, fgi, least(position_size, 0.25) AS size,
    CASE WHEN side > 0 THEN close * (1 + 0.0005) ELSE close * (1 - 0.0005) END::DOUBLE AS ep,
    lead(ts) OVER w AS turn_ts, lead(close) OVER w AS turn_close
  FROM runs WHERE was IS NULL OR was <> side WINDOW w AS (PARTITION BY symbol ORDER BY ts))""", f"""checks AS ({checks})""",
    f"""hit0 AS (
  SELECT o.symbol, o.ts AS entry_time, c.ts, c.close,
    CASE WHEN o.side > 0 THEN c.close / o.ep ELSE o.ep / nullif(c.close, 0) END - 1 AS mv
  FROM opened o JOIN checks c ON c.symbol = o.symbol AND c.ts > o.ts AND (o.turn_ts IS NULL OR c.ts < o.turn_ts))""", f"""hits AS (
  SELECT symbol, entry_time, min(ts) AS hit_ts, first(close ORDER BY ts) AS hit_close,
    first(CASE WHEN mv <= -{STOP} THEN 'stop' ELSE 'take' END ORDER BY ts) AS reason
  FROM hit0 WHERE mv <= -{STOP} OR mv >= {TAKE} GROUP BY 1, 2)""", """ends AS (
  SELECT symbol, max(ts) AS end_ts, last(close ORDER BY ts) AS end_close FROM hourly GROUP BY 1)""", """t1 AS (
  SELECT o.*, coalesce(h.reason, CASE WHEN turn_ts IS NOT NULL THEN 'reversal' ELSE 'end' END) AS exit_reason,
    coalesce(hit_ts, turn_ts, greatest(end_ts, o.ts)) AS exit_time, coalesce(hit_close, turn_close, end_close) AS mk
  FROM opened o LEFT JOIN hits h ON h.symbol = o.symbol AND h.entry_time = o.ts JOIN ends e ON e.symbol = o.symbol)""", """t2 AS (
  SELECT *, 100000.0::DOUBLE * size / ep AS qty, CASE WHEN exit_reason = 'end' THEN mk WHEN side < 0 THEN mk * (1 + 0.0005)
    ELSE mk * (1 - 0.0005) END::DOUBLE AS xp FROM t1)""", """trades AS (
  SELECT ts AS entry_time, exit_time, symbol, action, ep AS entry_price, xp AS exit_price, size AS position_size,
    qty AS quantity, CASE WHEN side > 0 THEN xp - ep ELSE ep - xp END * qty AS pnl,
    (CASE WHEN side > 0 THEN xp / ep ELSE ep / nullif(xp, 0) END - 1) * 100 AS pnl_percent, confidence,
    fgi AS fear_greed_index, 'CLOSED' AS status, exit_reason, side, abs(ep * qty * 0.001::DOUBLE) AS entry_fee,
    CASE WHEN exit_reason = 'end' THEN 0 ELSE abs(xp * qty * 0.001::DOUBLE) END AS exit_fee FROM t2)"""]


NUMBERS = {"entry_price": 6, "exit_price": 6, "position_size": 6, "quantity": 6, "pnl": 6, "pnl_percent": 6,
            "confidence": 6, "fear_greed_index": 6, "entry_fee": 6, "exit_fee": 6}
_TRADE_TEXT = "entry_time, exit_time, symbol, action, status, exit_reason, side::BIGINT AS side"


def q_trades(spark: SparkSession, sf: str) -> DataFrame:
    out = done_trades(spark, sf).withColumn("side", F.col("side").cast("bigint"))
    return round_columns(out, NUMBERS)


SQL_TRADES = with_(*trade_ctes()) + f"SELECT {_TRADE_TEXT}, {', '.join(rnd(c) for c in NUMBERS)} FROM trades"


def q_trades_on_signals(spark: SparkSession, sf: str) -> DataFrame:
    bars = materialise(src.bars_hourly(spark, sf), "bars")
    out = tr.extract_trades(trade_signals(spark, sf), bars, stop=STOP, take=TAKE, check_on="signals")
    return round_columns(out.withColumn("side", F.col("side").cast("bigint")), NUMBERS)


SQL_TRADES_ON_SIGNALS = with_(*trade_ctes("signals")) + f"SELECT {_TRADE_TEXT}, {', '.join(rnd(c) for c in NUMBERS)} FROM trades"


def q_pnl_by_symbol(spark: SparkSession, sf: str) -> DataFrame:
    done = materialise(done_trades(spark, sf), "trades")
    both = tr.pnl_by(done, "symbol").select(F.lit("symbol").alias("kind"), F.col("symbol").alias("key"), "total_pnl",
                                            "trades", "win_rate")
    acts = tr.pnl_by(done, "action").select(F.lit("action").alias("kind"), F.col("action").alias("key"), "total_pnl",
                                            "trades", "win_rate")
    return round_columns(both.unionByName(acts), {"total_pnl": 4, "win_rate": 6})


SQL_PNL_BY_SYMBOL = with_(*trade_ctes(), """p AS (
  SELECT 'symbol' AS kind, symbol AS key, sum(pnl) AS s, count(*) AS trades, avg((pnl > 0)::INT) * 100 AS w FROM trades GROUP BY 2
  UNION ALL SELECT 'action', action, sum(pnl), count(*), avg((pnl > 0)::INT) * 100 FROM trades GROUP BY 2)""") + f"""
SELECT kind, key, {rnd('s', 4, 'total_pnl')}, trades, {rnd('w', 6, 'win_rate')} FROM p"""


def q_top_trades(spark: SparkSession, sf: str) -> DataFrame:
    done = materialise(done_trades(spark, sf), "trades").select("symbol", "entry_time", "pnl")
    best = tr.top_trades(done, 3).withColumn("list", F.lit("best"))
    worst = tr.top_trades(done, 3, best=False).withColumn("list", F.lit("worst"))
    return round_columns(best.unionByName(worst), {"pnl": 6})


SQL_TOP_TRADES = with_(*trade_ctes(), """u AS (
  (SELECT symbol, entry_time, pnl, 'best' AS list FROM trades ORDER BY pnl DESC, symbol, entry_time LIMIT 3)
  UNION ALL (SELECT symbol, entry_time, pnl, 'worst' FROM trades ORDER BY pnl, symbol, entry_time LIMIT 3))""") + f"""
SELECT symbol, entry_time, {rnd('pnl')}, list FROM u"""


def q_cum_pnl(spark: SparkSession, sf: str) -> DataFrame:
    out = tr.cum_pnl(materialise(done_trades(spark, sf), "trades")).select("symbol", "entry_time", "trade_no", "cum_pnl")
    return round_columns(out, {"cum_pnl": 4})


SQL_CUM_PNL = with_(*trade_ctes(), """c AS (
  SELECT symbol, entry_time, row_number() OVER w AS trade_no, sum(pnl) OVER w AS cum_pnl FROM trades
  WINDOW w AS (PARTITION BY symbol ORDER BY entry_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""") + f"""
SELECT symbol, entry_time, trade_no, {rnd('cum_pnl', 4)} FROM c"""


def _curve(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    done, bars = _trades(spark, sf)
    done = materialise(done, "trades")
    return done, materialise(tr.equity_curve(done, bars), "equity")


def q_equity_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = ind.drawdown(_curve(spark, sf)[1])
    return round_columns(out, {"equity": 4, "peak": 4, "drawdown": 4, "drawdown_pct": 6})


# The check marks every symbol at every bar time of the portfolio.
EQUITY_CTES = ["""booked AS (
  SELECT *, sum(pnl - entry_fee - exit_fee) OVER (PARTITION BY symbol ORDER BY entry_time
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM trades)""",
    "times AS (SELECT DISTINCT ts FROM hourly)", "syms AS (SELECT DISTINCT symbol FROM hourly)", """lastbar AS (
  SELECT s.symbol, t.ts, h.ts AS bts, h.close FROM times t CROSS JOIN syms s
  ASOF JOIN hourly h ON h.symbol = s.symbol AND t.ts >= h.ts)""", """held AS (
  SELECT l.symbol, l.ts, l.bts, l.close, b.entry_time, b.exit_time, b.side, b.entry_price, b.quantity, b.entry_fee, b.upto,
    b.upto - (b.pnl - b.entry_fee - b.exit_fee) AS before
  FROM lastbar l ASOF LEFT JOIN booked b ON b.symbol = l.symbol AND l.bts >= b.entry_time)""", """prof AS (
  SELECT ts, CASE WHEN entry_time IS NULL THEN 0 WHEN bts >= exit_time THEN upto ELSE before
    + CASE WHEN side > 0 THEN close - entry_price ELSE entry_price - close END * quantity - entry_fee END AS p FROM held)""",
    "equity AS (SELECT 'main' AS portfolio_id, ts, 100000 + sum(p) AS equity FROM prof GROUP BY 2)", """dd AS (
  SELECT *, max(equity) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak,
    row_number() OVER (ORDER BY ts) AS rn, equity / nullif(lag(equity) OVER (ORDER BY ts), 0) - 1 AS ret FROM equity)""",
    "ddp AS (SELECT *, equity - peak AS drawdown, (equity - peak) / peak * 100 AS drawdown_pct FROM dd)"]
SQL_EQUITY_CURVE = with_(*trade_ctes(), *EQUITY_CTES) + f"""
SELECT portfolio_id, ts, {rnd('equity', 4)}, {rnd('peak', 4)}, {rnd('drawdown', 4)}, {rnd('drawdown_pct')} FROM ddp"""


def q_backtest_summary(spark: SparkSession, sf: str) -> DataFrame:
    done, equity = _curve(spark, sf)
    out = risk.backtest_summary(done, equity, tr.CAPITAL)
    digits = {c: 4 for c in ["final_capital", "max_drawdown", "max_drawdown_percent", "sharpe_ratio", "sortino_ratio",
                             "total_return", "total_return_percent", "win_rate", "avg_win", "avg_loss", "largest_win",
                             "largest_loss", "profit_factor", "avg_duration_seconds"]}
    return round_columns(out, digits)


_RATIO = "(avg(ret) * 8760 - 0.04)"
SQL_BACKTEST_SUMMARY = with_(*trade_ctes(), *EQUITY_CTES, f"""f AS (
  SELECT portfolio_id, min(ts) AS start_date, max(ts) AS end_date, last(equity ORDER BY ts) AS fc, min(drawdown) AS mdd,
    abs(min(drawdown_pct)) AS mddp, coalesce({_RATIO} / nullif(stddev_samp(ret) * sqrt(8760), 0), 0) AS sh,
    CASE WHEN count(*) FILTER (ret < 0) = 0 THEN coalesce({_RATIO} / nullif(stddev_samp(ret) * sqrt(8760), 0), 0)
      ELSE coalesce({_RATIO} / nullif(stddev_samp(ret) FILTER (ret < 0) * sqrt(8760), 0), 0) END AS so
  FROM ddp GROUP BY 1)""", """s AS (
  SELECT count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl < 0) AS losing_trades,
    count(*) FILTER (pnl > 0) / count(*)::DOUBLE * 100 AS wr, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS aw,
    coalesce(avg(pnl) FILTER (pnl < 0), 0) AS al, coalesce(max(pnl) FILTER (pnl > 0), 0) AS lw,
    coalesce(min(pnl) FILTER (pnl < 0), 0) AS ll,
    sum(pnl) FILTER (pnl > 0) / nullif(abs(sum(pnl) FILTER (pnl < 0)), 0) AS pf,
    avg(date_diff('microsecond', entry_time, exit_time)) / 1e6 AS ad FROM trades)""") + f"""
SELECT portfolio_id, start_date, end_date, 100000.0::DOUBLE AS initial_capital, {rnd('fc', 4, 'final_capital')},
  {rnd('mdd', 4, 'max_drawdown')}, {rnd('mddp', 4, 'max_drawdown_percent')}, {rnd('sh', 4, 'sharpe_ratio')},
  {rnd('so', 4, 'sortino_ratio')}, {rnd('(fc - 100000)', 4, 'total_return')},
  {rnd('((fc - 100000) / 100000 * 100)', 4, 'total_return_percent')}, total_trades, winning_trades, losing_trades,
  {rnd('wr', 4, 'win_rate')}, {rnd('aw', 4, 'avg_win')}, {rnd('al', 4, 'avg_loss')}, {rnd('lw', 4, 'largest_win')},
  {rnd('ll', 4, 'largest_loss')}, {rnd('pf', 4, 'profit_factor')}, {rnd('ad', 4, 'avg_duration_seconds')} FROM f, s"""


def q_risk_report(spark: SparkSession, sf: str) -> DataFrame:
    done, equity = _curve(spark, sf)
    out = risk.performance_report(done, equity, sentiment="fear_greed_index")
    digits = {c: 6 for c in ["total_return", "sharpe_ratio", "volatility", "annualized_return", "max_drawdown",
                             "value_at_risk", "conditional_var", "win_rate", "loss_rate", "profit_factor",
                             "sentiment_price_correlation"]}
    return round_columns(out, digits)


SQL_RISK_REPORT = with_(*trade_ctes(), *EQUITY_CTES, """f AS (
  SELECT portfolio_id, count(*) AS n, last(equity ORDER BY ts) / first(equity ORDER BY ts) - 1 AS tot,
    coalesce((avg(ret) - 0.02 / 252) / nullif(stddev_samp(ret), 0) * sqrt(252), 0) AS sh,
    coalesce(stddev_pop(ret) * sqrt(252), 0) AS vol FROM ddp GROUP BY 1)""", """trough AS (
  SELECT rn AS low_rn, peak AS pk, drawdown_pct / 100 AS mdd FROM ddp ORDER BY drawdown_pct, rn LIMIT 1)""", """dur AS (
  SELECT first(mdd) AS mdd, coalesce(min(rn) FILTER (equity >= pk AND rn >= low_rn), max(rn)) - min(rn) FILTER (equity = pk AND rn <= low_rn)
    AS rows_ FROM ddp, trough)""", """srt AS (
  SELECT ret, row_number() OVER (ORDER BY ret) - 1 AS i, count(*) OVER () AS m FROM ddp WHERE ret IS NOT NULL)""", """tail AS (
  SELECT -max(ret) FILTER (i = floor((1 - 0.95::DOUBLE) * m)) AS v, -avg(ret) FILTER (i <= floor((1 - 0.95::DOUBLE) * m)) AS c FROM srt)""",
    """dec_ AS (SELECT count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, count(*) AS num_trades,
    sum(pnl) FILTER (pnl > 0) / nullif(abs(sum(pnl) FILTER (pnl < 0)), 0) AS pf,
    covar_pop(fear_greed_index, pnl) / nullif(stddev_pop(fear_greed_index) * stddev_pop(pnl), 0) AS r FROM trades)""") + f"""
SELECT portfolio_id, n AS analysis_period_days, {rnd('tot', 6, 'total_return')}, {rnd('sh', 6, 'sharpe_ratio')},
  {rnd('vol', 6, 'volatility')}, {rnd('((1 + tot) ** (365.0::DOUBLE / n) - 1)', 6, 'annualized_return')},
  {rnd('mdd', 6, 'max_drawdown')}, rows_ AS drawdown_rows, {rnd('v', 6, 'value_at_risk')}, {rnd('c', 6, 'conditional_var')},
  wins, losses, {rnd('(wins / (wins + losses)::DOUBLE)', 6, 'win_rate')},
  {rnd('(losses / (wins + losses)::DOUBLE)', 6, 'loss_rate')}, num_trades, {rnd('pf', 6, 'profit_factor')},
  {rnd('r', 6, 'sentiment_price_correlation')}, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate'
    WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'none' END AS correlation_significance,
  CASE WHEN r > 0.1 THEN 'positive' WHEN r < -0.1 THEN 'negative' ELSE 'neutral' END AS correlation_direction,
  CASE WHEN sh > 2 THEN 'Excellent' WHEN sh > 1 THEN 'Good' WHEN sh > 0.5 THEN 'Fair' ELSE 'Poor' END AS rating
FROM f, dur, tail, dec_"""


def q_sentiment_price_corr(spark: SparkSession, sf: str) -> DataFrame:
    d = ind.pct_change(src.price_sentiment(spark, sf), "close", 1, "ret")
    return round_columns(risk.labelled_corr(d, "sentiment", "ret", ["symbol"]), {"correlation": 6})


SQL_SENTIMENT_PRICE_CORR = with_(HOURLY, *SIGNAL_CTES[:2], PRICE_SENT, f"""r AS (
  SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret FROM price_sent)""", """c AS (
  SELECT symbol, count(ret) AS pairs, covar_pop(sentiment, ret) / nullif(stddev_pop(sentiment) FILTER (ret IS NOT NULL)
    * stddev_pop(ret), 0) AS r FROM r GROUP BY 1)""") + f"""
SELECT symbol, pairs, {rnd('coalesce(r, 0)', 6, 'correlation')}, CASE WHEN pairs < 10 THEN 'insufficient_data'
    WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'none' END AS significance,
  CASE WHEN pairs >= 10 AND r > 0.1 THEN 'positive' WHEN pairs >= 10 AND r < -0.1 THEN 'negative' ELSE 'neutral' END AS direction
FROM c"""


def q_latency_report(spark: SparkSession, sf: str) -> DataFrame:
    stages = src.table(spark, sf, "events").select(
        F.col("event_type").alias("stage"), F.col("value").alias("latency_ms"))
    out = risk.latency_report(stages, targets={"click": 100.0, "view": 150.0, "purchase": 500.0})
    return round_columns(out, {c: 6 for c in ["avg", "p50", "p95", "p99", "max"]})


SQL_LATENCY_REPORT = with_("""l AS (
  SELECT event_type AS stage, count(value) AS n, avg(value) AS a, max(value) AS mx, quantile_cont(value, 0.5) AS p5,
    quantile_cont(value, 0.95) AS p9, quantile_cont(value, 0.99) AS p99_ FROM events GROUP BY 1)""") + f"""
SELECT stage, n, {rnd('a', 6, 'avg')}, {rnd('mx', 6, 'max')}, {rnd('p5', 6, 'p50')}, {rnd('p9', 6, 'p95')},
  {rnd('p99_', 6, 'p99')}, p9 < CASE stage WHEN 'click' THEN 100 WHEN 'view' THEN 150 WHEN 'purchase' THEN 500 END AS meets_target
FROM l"""


def q_histogram(spark: SparkSession, sf: str) -> DataFrame:
    stages = src.table(spark, sf, "events").select(F.col("event_type").alias("stage"), "value")
    return round_columns(risk.histogram(stages, "value", 20, ["stage"]), {"bin_start": 6})


SQL_HISTOGRAM = with_("b AS (SELECT event_type AS stage, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1)", """h AS (
  SELECT stage, least(floor((value - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n, lo, hi
  FROM events JOIN b ON stage = event_type GROUP BY ALL)""", "hh AS (SELECT *, lo + (hi - lo) / 20 * bin AS s FROM h)") + f"""
SELECT stage, bin, {rnd('s', 6, 'bin_start')}, n FROM hh"""


def q_describe(spark: SparkSession, sf: str) -> DataFrame:
    out = risk.describe(src.price_sentiment(spark, sf), ["close", "sentiment", "volume"], ["symbol"])
    return round_columns(out, {c: 6 for c in out.columns if c != "symbol"})


SQL_DESCRIBE = with_(HOURLY, *SIGNAL_CTES[:2], PRICE_SENT, "d AS (SELECT symbol, " + ", ".join(
    f"{f}({c}) AS {f}_{c}" for c in ["close", "sentiment", "volume"] for f in ["min", "max", "avg"])
    + " FROM price_sent GROUP BY 1)") + "SELECT symbol, " + ", ".join(
    rnd(f"{f}_{c}") for c in ["close", "sentiment", "volume"] for f in ["min", "max", "avg"]) + " FROM d"


QUERIES = {
    "asof_price": (q_asof_price, SQL_ASOF_PRICE),
    "trades": (q_trades, SQL_TRADES),
    "trades_on_signals": (q_trades_on_signals, SQL_TRADES_ON_SIGNALS),
    "pnl_by_symbol": (q_pnl_by_symbol, SQL_PNL_BY_SYMBOL),
    "top_trades": (q_top_trades, SQL_TOP_TRADES),
    "cum_pnl": (q_cum_pnl, SQL_CUM_PNL),
    "equity_curve": (q_equity_curve, SQL_EQUITY_CURVE),
    "backtest_summary": (q_backtest_summary, SQL_BACKTEST_SUMMARY),
    "risk_report": (q_risk_report, SQL_RISK_REPORT),
    "sentiment_price_corr": (q_sentiment_price_corr, SQL_SENTIMENT_PRICE_CORR),
    "latency_report": (q_latency_report, SQL_LATENCY_REPORT),
    "histogram": (q_histogram, SQL_HISTOGRAM),
    "describe": (q_describe, SQL_DESCRIBE),
}
