"""Queries over walk-forward, outcomes, execution costs, models, metric series and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse import schemas
from marketpulse.functions.numeric import num, round_columns, softmax, tanh_score
from marketpulse.operators import cross as cr
from marketpulse.operators import impact as im
from marketpulse.operators import models as mo
from marketpulse.operators import outcomes as oc
from marketpulse.operators import strategies as sg
from marketpulse.operators import walkforward as wf
from marketpulse.plans.moods import _CREDIBILITY, _INFLUENCE, _decay
from marketpulse.plans.sqlkit import DAILY, HOURLY, SENT_HOURLY, SENTIMENT, lag, rnd, strict, with_
from marketpulse.session import materialise
from marketpulse.sources import adapters as src
from marketpulse.sources import metrics as me
from marketpulse.streaming import streams as st

GRID = [(5, 20), (10, 30), (10, 50), (20, 50)]


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    strategy = wf.ma_cross_returns(src.bars_daily(spark, sf), GRID)
    return wf.walk_forward(materialise(strategy, "strategy"), ["fast", "slow"])


_WF_COLS = ["in_sample_return", "in_sample_sharpe", "out_of_sample_return", "out_of_sample_sharpe"]


def q_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    out = _windows(spark, sf).withColumns({c: F.col(c).cast("bigint") for c in ("window_id", "param_id", "fast", "slow")})
    return round_columns(out, {c: 6 for c in _WF_COLS})


def _grown(r: str) -> str:
    return f"CASE WHEN min(1 + {r}) > 0 THEN product(1 + {r}) ELSE 0 END - 1"


WF_CTES = [DAILY, "m AS (SELECT symbol, ts, close, " + ", ".join(
    f"{strict('avg', 'close', n)} AS m{n}" for n in sorted({x for g in GRID for x in g}))
    + f", close / {lag('close')} - 1 AS ret FROM daily)", "p AS (" + " UNION ALL ".join(
    f"SELECT symbol, ts, {i} AS param_id, {a} AS fast, {b} AS slow, coalesce(lag(coalesce((m{a} > m{b})::INT, 0)) "
    f"OVER (PARTITION BY symbol ORDER BY ts) * ret, 0) AS r FROM m" for i, (a, b) in enumerate(GRID)) + ")", """sp AS (
  SELECT symbol, min(ts) AS a, max(ts) AS b FROM daily GROUP BY 1)""", """wn AS (
  SELECT symbol, k + 1 AS window_id, a + INTERVAL (k * 30) DAY AS s, a + INTERVAL (k * 30 + 90) DAY AS e,
    a + INTERVAL (k * 30 + 120) DAY AS o
  FROM (SELECT symbol, a, b, unnest(generate_series(0, 1000)) AS k FROM sp) WHERE a + INTERVAL (k * 30 + 120) DAY <= b)""", f"""sc AS (
  SELECT w.symbol, window_id, CASE WHEN p.ts < e THEN 'in' ELSE 'out' END AS seg, param_id, fast, slow, count(*) AS n,
    {_grown('r')} AS returns, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS sharpe
  FROM wn w JOIN p ON p.symbol = w.symbol AND p.ts >= s AND p.ts < o GROUP BY 1, 2, 3, 4, 5, 6)""", """bst AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, window_id ORDER BY round(sharpe, 9) DESC, param_id) AS k
  FROM sc WHERE seg = 'in' AND n >= 10)""", """wf AS (
  SELECT b.symbol, b.window_id, b.param_id, b.fast, b.slow, b.returns AS in_sample_return, b.sharpe AS in_sample_sharpe,
    o.returns AS out_of_sample_return, o.sharpe AS out_of_sample_sharpe
  FROM bst b JOIN sc o ON o.symbol = b.symbol AND o.window_id = b.window_id AND o.param_id = b.param_id
  WHERE b.k = 1 AND o.seg = 'out' AND o.n >= 5)"""]
SQL_WALK_FORWARD = with_(*WF_CTES) + f"""
SELECT symbol, window_id, param_id::BIGINT AS param_id, fast::BIGINT AS fast, slow::BIGINT AS slow,
  {', '.join(rnd(c) for c in _WF_COLS)} FROM wf"""


def q_walk_forward_strategy(spark: SparkSession, sf: str) -> DataFrame:
    grid = {"fast": [5, 10], "slow": [20, 30, 50]}
    out = sg.walk_forward_strategy(src.bars_daily(spark, sf), sg.ma_cross, grid, share=4)
    out = out.withColumns({c: F.col(c).cast("bigint") for c in ("window_id", "param_id", "fast", "slow")})
    return round_columns(out, {c: 6 for c in _WF_COLS})


_IN_WINDOW = "PARTITION BY symbol, window_id, seg ORDER BY ts"
_SG_GRID = [(a, b) for a in (5, 10) for b in (20, 30, 50)]
SQL_WALK_FORWARD_STRATEGY = with_(DAILY, WF_CTES[3], WF_CTES[4], """sg AS (
  SELECT w.symbol, window_id, CASE WHEN d.ts < e THEN 'in' ELSE 'out' END AS seg, d.ts, d.close
  FROM wn w JOIN daily d ON d.symbol = w.symbol AND d.ts >= s AND d.ts < o)""", "m AS (SELECT *, " + ", ".join(
    f"CASE WHEN row_number() OVER ({_IN_WINDOW}) >= {n} THEN avg(close) OVER ({_IN_WINDOW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) "
    f"END AS m{n}" for n in (5, 10, 20, 30, 50)) + f", close / nullif(lag(close) OVER ({_IN_WINDOW}), 0) - 1 AS ret FROM sg)", "p AS ("
    + " UNION ALL ".join(
        f"SELECT symbol, window_id, seg, ts, {i} AS param_id, {a} AS fast, {b} AS slow, "
        f"coalesce(lag(coalesce((m{a} > m{b})::INT, 0)) OVER ({_IN_WINDOW}) * ret, 0) AS r FROM m"
        for i, (a, b) in enumerate(_SG_GRID)) + ")", f"""sc AS (
  SELECT symbol, window_id, seg, param_id, fast, slow, count(*) AS n,
    {_grown('r')} AS returns, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS sharpe
  FROM p GROUP BY 1, 2, 3, 4, 5, 6)""", WF_CTES[6], WF_CTES[7]) + f"""
SELECT symbol, window_id, param_id::BIGINT AS param_id, fast::BIGINT AS fast, slow::BIGINT AS slow,
  {', '.join(rnd(c) for c in _WF_COLS)}, 0::BIGINT AS failed FROM wf"""


def q_walk_forward_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = wf.walk_forward_summary(_windows(spark, sf), ["fast", "slow"])
    return round_columns(out, {c: 6 for c in ["total_return", "sharpe_ratio", "max_drawdown", "efficiency_ratio",
                                              "parameter_stability"]})


SQL_WALK_FORWARD_SUMMARY = with_(*WF_CTES, """g AS (
  SELECT *, CASE WHEN min(1 + out_of_sample_return) OVER w <= 0 THEN 0 ELSE product(1 + out_of_sample_return) OVER w END AS gr
  FROM wf WINDOW w AS (PARTITION BY symbol ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", """h AS (
  SELECT *, max(gr) OVER (PARTITION BY symbol ORDER BY window_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pk FROM g)""",
    """pa AS (SELECT symbol, (CASE WHEN max(fast) = min(fast) THEN 1 ELSE 1 / (1 + stddev_pop(fast) / (abs(avg(fast)) + 1e-6)) END
    + CASE WHEN max(slow) = min(slow) THEN 1 ELSE 1 / (1 + stddev_pop(slow) / (abs(avg(slow)) + 1e-6)) END) / 2 AS st
  FROM wf GROUP BY 1)""", """sm AS (
  SELECT symbol, count(*) AS windows, sum(out_of_sample_return) AS total_return,
    avg(out_of_sample_return) / (stddev_pop(out_of_sample_return) + 1e-6) * sqrt(252) AS sharpe_ratio,
    min((gr - pk) / nullif(pk, 0)) AS max_drawdown,
    avg(out_of_sample_sharpe) / (avg(in_sample_sharpe) + 1e-6) AS efficiency_ratio FROM h GROUP BY 1)""") + f"""
SELECT symbol, windows, {rnd('total_return')}, {rnd('sharpe_ratio')}, {rnd('max_drawdown')}, {rnd('efficiency_ratio')},
  {rnd('st', 6, 'parameter_stability')} FROM sm JOIN pa USING (symbol)"""


# --- outcomes ----------------------------------------------------------------

SIMS = 200
_STATS = ["mean_return", "median_return", "std_return", "probability_profit", "probability_loss_gt_10", "worst_case",
          "best_case", "var_95", "cvar_95", *[f"ci{lv}_{s}" for lv in oc.LEVELS for s in ("low", "high")]]


def _small_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly returns scaled down to the size of real ones."""
    rets = cr.returns(src.bars_hourly(spark, sf))
    return materialise(rets.withColumn("ret", F.tanh("ret") / 50), "returns")


def q_bootstrap_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    out = oc.bootstrap_outcomes(_small_returns(spark, sf), sims=SIMS)
    return round_columns(out, {"final_return": 6})


BOOT_CTES = [HOURLY, f"""rr AS (
  SELECT symbol, ts, tanh(ret) / 50 AS ret FROM (SELECT symbol, ts, close / nullif({lag('close')}, 0) - 1 AS ret FROM hourly)
  WHERE ret IS NOT NULL)""", """nn AS (
  SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rr)""",
    "sz AS (SELECT symbol, count(*) AS n FROM rr GROUP BY 1)", f"""dr AS (
  SELECT symbol, n, sim, unnest(generate_series(0, n - 1)) AS step
  FROM sz, (SELECT unnest(generate_series(0, {SIMS - 1})) AS sim))""", """hx AS (
  SELECT *, ('0x' || substr(md5('42:' || sim || ':' || step), 1, 8))::BIGINT % n AS i FROM dr)""", """fin AS (
  SELECT hx.symbol, sim, CASE WHEN min(1 + ret) > 0 THEN product(1 + ret) - 1 ELSE -1 END AS final_return
  FROM hx JOIN nn ON nn.symbol = hx.symbol AND nn.i = hx.i GROUP BY 1, 2)"""]
SQL_BOOTSTRAP_OUTCOMES = with_(*BOOT_CTES) + f"SELECT symbol, sim, {rnd('final_return')} FROM fin"


def q_outcome_stats(spark: SparkSession, sf: str) -> DataFrame:
    paths = materialise(oc.bootstrap_outcomes(_small_returns(spark, sf), sims=SIMS), "paths")
    return round_columns(oc.outcome_stats(paths, ["symbol"]), {c: 6 for c in _STATS})


SQL_OUTCOME_STATS = with_(*BOOT_CTES, "cut AS (SELECT symbol, quantile_cont(final_return, 0.05) AS c5 FROM fin GROUP BY 1)", """os AS (
  SELECT symbol, count(*) AS simulations, avg(final_return) AS mean_return, median(final_return) AS median_return,
    stddev_pop(final_return) AS std_return, avg((final_return > 0)::INT) AS probability_profit,
    avg((final_return < -0.1)::INT) AS probability_loss_gt_10, min(final_return) AS worst_case, max(final_return) AS best_case,
    -any_value(c5) AS var_95, -avg(final_return) FILTER (final_return <= c5) AS cvar_95, """ + ", ".join(
    f"quantile_cont(final_return, {(100 - lv) / 200}) AS ci{lv}_low, quantile_cont(final_return, {1 - (100 - lv) / 200}) AS ci{lv}_high"
    for lv in oc.LEVELS) + " FROM fin JOIN cut USING (symbol) GROUP BY 1)") + f"""
SELECT symbol, simulations, {', '.join(rnd(c) for c in _STATS)} FROM os"""


# --- execution ---------------------------------------------------------------

def _orders(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("l_linenumber") % 2 == 0, "sell").otherwise("buy")
    lines = src.spread(src.table(spark, sf, "lineitem"), "l_orderkey")
    return lines.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_id"), (F.col("l_suppkey") % 50).alias("book_id"),
        side.alias("side"), (F.col("l_quantity") * 1000).cast("double").alias("size"))


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    """Ten levels a side per book around the mean price of the book's lines."""
    books = src.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("book_id")).agg(
        F.round(F.avg("l_extendedprice")).alias("mid"), F.round(F.avg("l_quantity") * 400).alias("depth"))
    levels = books.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("level"))
    gap = F.col("mid") * 0.001
    away = gap / 2 + F.col("level") * gap * 0.1
    sides = F.array(
        F.struct(F.lit("bid").alias("side"), (F.col("mid") - away).alias("price")),
        F.struct(F.lit("ask").alias("side"), (F.col("mid") + away).alias("price")))
    return levels.select("book_id", "level", F.inline(sides), (F.col("depth") * (1 - F.col("level") * 0.08)).alias("volume"))


_BOOK = ["executed", "intended_price", "execution_price", "slippage", "slippage_pct", "impact_cost", "temporary_impact",
         "permanent_impact"]


def q_walk_book(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(im.walk_book(_orders(spark, sf), _levels(spark, sf)), {c: 5 for c in _BOOK})


ORDER_CTES = ["""ord AS (
  SELECT row_number() OVER () AS rid, l_orderkey * 10 + l_linenumber AS order_id, l_suppkey % 50 AS book_id,
    CASE WHEN l_linenumber % 2 = 0 THEN 'sell' ELSE 'buy' END AS side, (l_quantity * 1000)::DOUBLE AS size FROM lineitem)""", """bk AS (
  SELECT l_suppkey % 50 AS book_id, round(avg(l_extendedprice)) AS mid, round(avg(l_quantity) * 400) AS depth FROM lineitem GROUP BY 1)""",
    """lv AS (SELECT book_id, side, level, mid + CASE side WHEN 'bid' THEN -1 ELSE 1 END * (mid * 0.001::DOUBLE / 2
      + level * (mid * 0.001::DOUBLE) * 0.1::DOUBLE) AS price, depth * (1 - level * 0.08::DOUBLE) AS volume
  FROM bk, (SELECT unnest(generate_series(0, 9)) AS level), (SELECT unnest(['bid', 'ask']) AS side))""", """lb AS (
  SELECT *, coalesce(sum(volume) OVER (PARTITION BY book_id, side ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS before FROM lv)""", """tops AS (
  SELECT book_id, max(price) FILTER (side = 'bid') AS bid, min(price) FILTER (side = 'ask') AS ask, max(volume) AS depth FROM lv GROUP BY 1)""",
    """fl AS (SELECT rid, o.order_id, o.book_id, o.side, o.size, sum(least(volume, greatest(o.size - before, 0))) AS executed,
    sum(least(volume, greatest(o.size - before, 0)) * price) AS cost
  FROM ord o JOIN lb ON lb.book_id = o.book_id AND lb.side = CASE o.side WHEN 'buy' THEN 'ask' ELSE 'bid' END GROUP BY 1, 2, 3, 4, 5)""",
    """ex AS (SELECT fl.*, (bid + ask) / 2 AS mid, coalesce(cost / nullif(executed, 0), (bid + ask) / 2) AS xp, bid, ask, depth
  FROM fl JOIN tops USING (book_id))""", """ey AS (
  SELECT *, (xp - mid) * CASE side WHEN 'buy' THEN 1 ELSE -1 END AS sl, 0.1::DOUBLE * pow(size / depth, 0.6) * ((ask - bid) / mid) AS tmp
  FROM ex)"""]
SQL_WALK_BOOK = with_(*ORDER_CTES) + f"""
SELECT order_id, book_id, side, size, {rnd('executed', 5)}, {rnd('mid', 5, 'intended_price')}, {rnd('xp', 5, 'execution_price')},
  {rnd('sl', 5, 'slippage')}, {rnd('(sl / mid)', 5, 'slippage_pct')}, {rnd('abs(sl * size)', 5, 'impact_cost')},
  {rnd('(tmp * mid)', 5, 'temporary_impact')}, {rnd('(tmp * 0.5 * mid)', 5, 'permanent_impact')} FROM ey"""


def q_execution_slices(spark: SparkSession, sf: str) -> DataFrame:
    orders = _orders(spark, sf)
    fast = im.execution_slices(orders, 5, 1.0).withColumn("schedule", F.lit("decay"))
    even = im.execution_slices(orders, 5, 0.2).withColumn("schedule", F.lit("even"))
    out = fast.unionByName(even).withColumn("t", F.col("t").cast("bigint"))
    return round_columns(out, {"slice": 5})


SQL_EXECUTION_SLICES = with_(ORDER_CTES[0], """w AS (
  SELECT t, exp(-0.5 * t / 5) AS d FROM (SELECT unnest(generate_series(0, 4))::BIGINT AS t))""", """s AS (
  SELECT order_id, t, size * d / (SELECT sum(d) FROM w) AS slice, 'decay' AS schedule FROM ord, w
  UNION ALL SELECT order_id, t, size / 5, 'even' FROM ord, w)""") + f"SELECT order_id, t, {rnd('slice', 5)}, schedule FROM s"


def q_vwap_cost(spark: SparkSession, sf: str) -> DataFrame:
    bars = src.bars_hourly(spark, sf)
    out = im.vwap_cost(bars, 500.0).join(im.liquidity(bars, 20, 1.0), "symbol")
    return round_columns(out, {c: 6 for c in out.columns if c != "symbol"})


SQL_VWAP_COST = with_(HOURLY, """v AS (
  SELECT symbol, first(close ORDER BY ts) AS bp, sum(close * volume) / sum(volume) AS vwap, avg(volume) AS lq FROM hourly GROUP BY 1)""",
    """t AS (SELECT symbol, greatest(avg(volume) / (1 + stddev_samp(volume) / avg(volume)), 1) AS l
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM hourly) WHERE rn <= 20 GROUP BY 1)""", """c AS (
  SELECT *, vwap - bp AS sl, 0.1 * (500 / lq) * bp AS ic FROM v JOIN t USING (symbol))""") + f"""
SELECT symbol, {rnd('bp', 6, 'benchmark_price')}, {rnd('vwap')}, {rnd('sl', 6, 'slippage')}, {rnd('(sl / bp)', 6, 'slippage_pct')},
  {rnd('ic', 6, 'impact_cost')}, {rnd('(abs(sl * 500) + ic)', 6, 'total_cost')}, {rnd('l', 6, 'liquidity')} FROM c"""


# --- models ------------------------------------------------------------------

def _features(spark: SparkSession, sf: str) -> DataFrame:
    bars = materialise(src.bars_hourly(spark, sf), "bars")
    return mo.price_features(bars, src.sentiment_hourly(spark, sf).select("symbol", "ts", "sentiment"))


def _digits(name: str) -> int:
    """Means of few short decimals fall on rounding ties at 5 or 6 digits."""
    return 9 if name.startswith("sentiment") else 6


def q_price_features(spark: SparkSession, sf: str) -> DataFrame:
    out = _features(spark, sf).select("symbol", "ts", *mo.FEATURES)
    return round_columns(out, {c: _digits(c) for c in mo.FEATURES})


_ROLL = ", ".join(
    f"sum(s) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN {h * 3600000000 - 1} PRECEDING AND CURRENT ROW) / "
    f"sum(1) OVER (PARTITION BY symbol ORDER BY t RANGE BETWEEN {h * 3600000000 - 1} PRECEDING AND CURRENT ROW) AS sentiment_{h}h"
    for h in (1, 4, 24))
FEATURE_CTES = [HOURLY, SENTIMENT, SENT_HOURLY, f"""sr AS (
  SELECT symbol, ts, {_ROLL} FROM (SELECT symbol, ts, epoch_us(ts) AS t, sentiment AS s FROM sent_hourly))""", f"""p1 AS (
  SELECT *, close / nullif({lag('close')}, 0) - 1 AS returns_1h, close / nullif({lag('close', 4)}, 0) - 1 AS returns_4h,
    close / nullif({lag('close', 24)}, 0) - 1 AS returns_24h, {strict('avg', 'volume', 24)} AS av, close - {lag('close')} AS mv,
    {strict('avg', 'close', 20)} AS mid, {strict('stddev_samp', 'close', 20)} AS dev,
    row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM hourly)""", f"""p2 AS (
  SELECT *, {strict('stddev_samp', 'returns_1h', 24)} AS volatility_24h, volume / CASE WHEN av = 0 THEN 1 ELSE av END AS volume_ratio,
    avg(CASE WHEN mv > 0 THEN mv ELSE 0 END) OVER r AS up, avg(CASE WHEN mv < 0 THEN -mv ELSE 0 END) OVER r AS dn
  FROM p1 WINDOW r AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))""", """mc AS (
  SELECT symbol, ts, rn, close AS f, 1.0::DOUBLE AS fw, close AS s, 1.0::DOUBLE AS sw, 0.0::DOUBLE AS macd,
    0.0::DOUBLE AS g, 1.0::DOUBLE AS gw FROM p1 WHERE rn = 1
  UNION ALL
  SELECT symbol, ts, rn, f, fw, s, sw, f / fw - s / sw, (f / fw - s / sw) + g * 0.8::DOUBLE, 1 + gw * 0.8::DOUBLE
  FROM (SELECT r.symbol, r.ts, r.rn, r.close + m.f * (11.0::DOUBLE / 13) AS f, 1 + m.fw * (11.0::DOUBLE / 13) AS fw,
      r.close + m.s * (25.0::DOUBLE / 27) AS s, 1 + m.sw * (25.0::DOUBLE / 27) AS sw, m.g, m.gw
    FROM mc m JOIN p1 r ON r.symbol = m.symbol AND r.rn = m.rn + 1))""", """p3 AS (
  SELECT p2.symbol, p2.ts, returns_1h, returns_4h, returns_24h, volatility_24h, volume_ratio, macd, g / gw AS macd_signal,
    CASE WHEN p2.rn >= 14 THEN 100 - 100 / (1 + up / CASE WHEN dn = 0 THEN 1 ELSE dn END) END AS rsi_14,
    CASE WHEN dev IS NOT NULL THEN least(greatest((close - (mid - 2 * dev)) / CASE WHEN (mid + 2 * dev) - (mid - 2 * dev) = 0
      THEN 1 ELSE (mid + 2 * dev) - (mid - 2 * dev) END, 0), 1) END AS bb_position, sentiment_1h, sentiment_4h, sentiment_24h
  FROM p2 JOIN mc USING (symbol, ts) LEFT JOIN sr USING (symbol, ts))""", "p4 AS (SELECT symbol, ts, " + ", ".join(
    f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS {c}"
    for c in mo.FEATURES) + " FROM p3)"]
SQL_PRICE_FEATURES = "WITH RECURSIVE " + ",\n".join(FEATURE_CTES) + f"""
SELECT symbol, ts, {', '.join(rnd(c, _digits(c)) for c in mo.FEATURES)} FROM p4"""


def q_forecast(spark: SparkSession, sf: str) -> DataFrame:
    out = mo.forecast(_features(spark, sf)).drop("current_price")
    return round_columns(out, {"predicted_change": 3, "predicted_price": 2, "confidence": 4})


def _solve_ctes(first: str, width: int) -> list[str]:
    """Gauss-Jordan steps on columns a<row>_<column> of ``first``, a linear system per row; the last column is the right side."""
    name, ctes = first, []
    for k in range(width):
        later = [*range(k + 1, width + 1)]
        cells = ", ".join([f"a{i}_{i}" for i in range(k + 1)] + [f"a{k}_{j}" for j in later] + [
            f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} AS a{i}_{j}" for i in range(width) if i != k for j in later])
        ctes.append(f"{first}{k} AS MATERIALIZED (SELECT symbol, horizon, day, n, {cells}, " + ", ".join(
            f"m{i}, d{i}" for i in range(width)) + f", my FROM {name})")
        name = f"{first}{k}"
    return ctes


def _forecast_sql() -> str:
    x, width = mo.FEATURES, len(mo.FEATURES)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    parts = ["count(y) AS n", "sum(y) AS sy", *[f"sum({c}) FILTER (y IS NOT NULL) AS s{i}" for i, c in enumerate(x)],
             *[f"sum({x[i]} * {x[j]}) FILTER (y IS NOT NULL) AS p{i}_{j}" for i, j in pairs], *[f"sum({c} * y) AS q{i}" for i, c in enumerate(x)]]
    names = [p.rsplit(" ", 1)[1] for p in parts]
    cov = {(i, j): f"(p{i}_{j} / n - s{i} / n * (s{j} / n))" for i, j in pairs}
    cells = ", ".join(f"{cov[min(i, j), max(i, j)]} / d{i} / d{j} + {0.01 if i == j else 0} AS a{i}_{j}" for i in range(width) for j in range(width))
    ctes = [*FEATURE_CTES, "fa AS (SELECT p4.*, close FROM p4 JOIN hourly USING (symbol, ts))", "fh AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT *, {h} AS horizon, (lead(close, {h}) OVER w / close - 1) * 100 AS y, (lead(ts, {h}) OVER w)::DATE AS known FROM fa "
        "WINDOW w AS (PARTITION BY symbol ORDER BY ts)" for h in mo.HORIZONS) + ")",
        "fu AS (SELECT symbol, horizon, known AS day, y, " + ", ".join(x) + " FROM fh WHERE known IS NOT NULL UNION ALL "
        "SELECT DISTINCT symbol, horizon, ts::DATE, NULL::DOUBLE, " + ", ".join("0.0::DOUBLE" for _ in x) + " FROM fh)",
        f"fg AS (SELECT symbol, horizon, day, {', '.join(parts)} FROM fu GROUP BY 1, 2, 3)",
        "fc AS (SELECT symbol, horizon, day, " + ", ".join(f"sum({c}) OVER w AS {c}" for c in names)
        + " FROM fg WINDOW w AS (PARTITION BY symbol, horizon ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
        "fd AS MATERIALIZED (SELECT *, " + ", ".join(
            f"CASE WHEN {cov[i, i]} > 1e-12 * (p{i}_{i} / n) THEN sqrt({cov[i, i]}) ELSE 'inf'::DOUBLE END AS d{i}" for i in range(width))
        + " FROM fc WHERE n >= 50)",
        f"fm AS MATERIALIZED (SELECT symbol, horizon, day, n, {cells}, " + ", ".join(
            f"(q{i} / n - s{i} / n * (sy / n)) / d{i} AS a{i}_{width}, s{i} / n AS m{i}, d{i}" for i in range(width)) + ", sy / n AS my FROM fd)",
        *_solve_ctes("fm", width)]
    beta = [f"(a{i}_{width} / a{i}_{i} / d{i})" for i in range(width)]
    ctes.append("fb AS MATERIALIZED (SELECT symbol, horizon, day, n, my, " + ", ".join(f"{b} AS b{i}, m{i}" for i, b in enumerate(beta)) + f" FROM fm{width - 1})")
    ctes.append("fp AS (SELECT symbol, ts, horizon || 'h' AS prediction_horizon, close, n::BIGINT AS fitted_on, my + " + " + ".join(
        f"b{i} * ({c} - m{i})" for i, c in enumerate(x)) + " AS predicted_change FROM fh JOIN fb USING (symbol, horizon) WHERE fb.day = fh.ts::DATE)")
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"""
SELECT symbol, ts, prediction_horizon, fitted_on, {rnd("predicted_change", 3)}, {rnd("close * (1 + predicted_change / 100)", 2, "predicted_price")},
  {rnd("1 - least(abs(predicted_change) / 10, 0.5)", 4, "confidence")} FROM fp"""


SQL_FORECAST = _forecast_sql()


def q_text_classifier(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.spread(src.table(spark, sf, "documents"), "doc_id").join(src.table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "text", F.col("quality").alias("label"))
    _, accuracy, predicted = mo.fit_text_classifier(rows)
    return predicted.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "accuracy", num(accuracy))


def _length_model():
    """A stand-in for a user model: longer texts score higher."""
    def predict(texts):
        import numpy as np

        return np.array([min(len(str(t)) / 1000.0, 2.0) - 1.0 for t in texts])
    return predict


def q_model_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = mo.score_batches(src.table(spark, sf, "documents").select("doc_id", "text"), _length_model)
    return round_columns(out.drop("text"), {"model_score": 6, "model_confidence": 6})


SQL_MODEL_SCORES = with_("s AS (SELECT doc_id, least(length(text) / 1000.0::DOUBLE, 2) - 1 AS s FROM documents)") + f"""
SELECT doc_id, {rnd('s', 6, 'model_score')}, {rnd('abs(s)', 6, 'model_confidence')},
  CASE WHEN s > 0.05 THEN 'positive' WHEN s < -0.05 THEN 'negative' ELSE 'neutral' END AS model_label FROM s"""


def q_embedding_score(spark: SparkSession, sf: str) -> DataFrame:
    """tanh score of each embedding with equal weights, and its largest softmax share."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    d = src.spread(src.table(spark, sf, "embeddings"), "vec_id").withColumn("v", v)
    ones = F.transform("v", lambda x: num(0.5))
    out = d.select("vec_id", tanh_score(F.col("v"), ones).alias("score"),
                   F.array_max(softmax(F.col("v"))).alias("top_share"))
    return round_columns(out, {"score": 6, "top_share": 6})


SQL_EMBEDDING_SCORE = with_("""v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)""", """s AS (
  SELECT vec_id, tanh(list_sum(v) * 0.5) AS score, 1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) AS top_share FROM v)""") + f"""
SELECT vec_id, {rnd('score')}, {rnd('top_share')} FROM s"""


# --- metric series -----------------------------------------------------------

def q_metric_series(spark: SparkSession, sf: str) -> DataFrame:
    """JSON payloads per symbol, pages of a bounded number of points, parsed back into one metric table."""
    events = src.table(spark, sf, "events")
    point = F.struct(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("v"))
    page = F.floor(F.col("event_id") / 500)
    packed = events.groupBy(F.col("event_type").alias("symbol"), page.alias("page"), (F.col("value") < 20).alias("inward")).agg(
        F.to_json(F.array_sort(F.collect_list(point))).alias("payload"))
    packed = materialise(packed, "payloads")
    inflow = me.parse_metric_json(packed.where("inward"), "inflow")
    outflow = me.parse_metric_json(packed.where("NOT inward"), "outflow")

    def daily(series):
        return series.groupBy("symbol", "metric", F.date_trunc("day", "ts").alias("ts")).agg(F.sum("value").alias("value"))
    inflow, outflow = daily(inflow), daily(outflow)
    net = me.flow_metric(inflow, outflow)
    out = me.collect_metrics(inflow, outflow, net.select("symbol", "metric", "ts", "value"))
    return round_columns(out.withColumn("ts", F.col("ts").cast("timestamp_ntz")), {"value": 4})


SQL_METRIC_SERIES = with_("""d AS (
  SELECT event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, sum(value) FILTER (value < 20) AS i,
    sum(value) FILTER (value >= 20) AS o FROM events GROUP BY 1, 2)""", """u AS (
  SELECT symbol, 'inflow' AS metric, ts, i AS value FROM d WHERE i IS NOT NULL
  UNION ALL SELECT symbol, 'outflow', ts, o FROM d WHERE o IS NOT NULL
  UNION ALL SELECT symbol, 'exchange_flow', ts, i - o FROM d WHERE i IS NOT NULL AND o IS NOT NULL)""") + f"""
SELECT symbol, metric, ts, {rnd('value', 4)} FROM u"""


# --- streams -----------------------------------------------------------------

def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a file stream; watermarks need a TIMESTAMP."""
    raw = spark.readStream.schema(schemas.STREAM_EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _post_stream(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    return _event_stream(spark, sf).select(
        "event_id", "ts", F.col("event_type").alias("asset"),
        F.element_at(F.array(*[F.lit(s) for s in ("twitter", "reddit", "news")]), (user % 3 + 1).cast("int")).alias("source"),
        (k / F.lit(50.0) - 1).alias("score"), F.pmod(user * 7919, F.lit(20000)).alias("followers"),
        F.pmod(user * 104729, F.lit(3000)).alias("karma"), (user % 5 == 0).alias("verified"), F.col("value").alias("price"))


def q_stream_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    out = st.drain(st.stream_sentiment(_post_stream(spark, sf)), "stream-sentiment")
    out = out.select("asset", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "score", "volume",
                     F.size("breakdown").cast("bigint").alias("sources"))
    return round_columns(out, {"score": 6})


STREAM_CTES = [SENTIMENT, """wd AS (
  SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE])::TIMESTAMP AS ws
  FROM sentiment)""", f"""ww AS (
  SELECT asset, ws, source, score, {_CREDIBILITY} * {_INFLUENCE} *
    {_decay("date_diff('microsecond', ts, ws + INTERVAL 1 HOUR) / 1e6")} AS w FROM wd)""", """sa AS (
  SELECT asset, ws, least(greatest(sum(score * w) / sum(w), -1), 1) AS score, count(*) AS volume, count(DISTINCT source) AS sources
  FROM ww GROUP BY 1, 2 HAVING ws + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM sentiment))"""]
SQL_STREAM_SENTIMENT = with_(*STREAM_CTES) + f"SELECT asset, ws AS window_start, {rnd('score')}, volume, sources FROM sa"


def q_stream_signals(spark: SparkSession, sf: str) -> DataFrame:
    out = st.drain(st.stream_signals(st.stream_sentiment(_post_stream(spark, sf)), min_confidence=0.5), "stream-signals")
    out = out.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "action", "confidence")
    return round_columns(out, {"confidence": 6})


SQL_STREAM_SIGNALS = with_(*STREAM_CTES, "x AS (SELECT *, (score + 1) / 2 * 100 AS fgi FROM sa)", """y AS (
  SELECT asset AS symbol, ws + INTERVAL 1 HOUR AS ts, CASE WHEN fgi > 75 THEN 'STRONG_BUY' WHEN fgi > 60 THEN 'BUY'
      WHEN fgi > 40 THEN 'HOLD' WHEN fgi > 25 THEN 'SELL' ELSE 'STRONG_SELL' END AS action,
    least((1 - abs((fgi - 50) / 50 - score) / 2) * 0.4 + least(volume / 10.0::DOUBLE, 1) * 0.3 + abs(score) * 0.3, 1) AS confidence
  FROM x)""") + f"SELECT symbol, ts, action, {rnd('confidence')} FROM y WHERE confidence >= 0.5"


def q_stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """One row per key and stretch of copies that are less than two days apart."""
    events, end = st.closing(_event_stream(spark, sf).select("ts", "user_id", "event_type", "event_id"))
    out = st.drain(st.dedupe_stream(events, ["user_id", "event_type"], memory="2 days"), "stream-dedupe", end)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


SQL_STREAM_DEDUPE = """
SELECT ts::TIMESTAMP AS ts, user_id, event_type, event_id FROM events
QUALIFY coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > INTERVAL 2 DAY, true)"""


def q_stream_fgi(spark: SparkSession, sf: str) -> DataFrame:
    posts, end = st.closing(_post_stream(spark, sf))
    hours = st.hourly_inputs(posts)
    landed, last = st.closing(spark.readStream.schema(hours.schema).parquet(st.land(hours, "stream-hours", end)))
    out = st.drain(st.stream_fgi(landed), "stream-fgi", last)
    out = out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    return round_columns(out, {c: 6 for c in _INDEX_PARTS})


_INDEX_PARTS = ["fear_greed_index", "c_sentiment", "c_volume_momentum", "c_volatility", "c_social_volume"]
SQL_STREAM_FGI = with_(SENTIMENT, """hr AS (
  SELECT event_type AS asset, date_trunc('hour', e.ts)::TIMESTAMP AS ts, avg(score) AS sentiment, count(*)::DOUBLE AS volume,
    last(value ORDER BY e.ts) AS price FROM events e JOIN sentiment USING (event_id) GROUP BY 1, 2)""", """rt AS (
  SELECT *, volume / nullif(avg(volume) OVER b, 0) AS r, stddev_pop(price) OVER c / nullif(avg(price) OVER c, 0) AS cv,
    count(*) OVER c AS n FROM hr
  WINDOW b AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 29 PRECEDING AND 1 PRECEDING),
    c AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))""", """cp AS (
  SELECT asset, ts, (least(greatest(sentiment, -1), 1) + 1) / 2 * 100 AS c_sentiment,
    CASE WHEN r IS NULL THEN 50 WHEN r < 0.5 THEN 0 WHEN r > 2 THEN 100 ELSE (r - 0.5) / 1.5 * 100 END AS c_volume_momentum,
    CASE WHEN n < 5 OR cv IS NULL THEN 50 WHEN cv >= 0.05 THEN 0 ELSE (1 - cv / 0.05) * 100 END AS c_volatility FROM rt)""", """ix AS (
  SELECT *, c_volume_momentum AS c_social_volume, c_sentiment * 0.25 + c_volume_momentum * 0.25 + c_volatility * 0.15
    + c_volume_momentum * 0.15 + 50 * 0.2 AS fear_greed_index FROM cp)""") + f"""
SELECT asset, ts, {', '.join(rnd(c) for c in _INDEX_PARTS)}, CASE WHEN fear_greed_index < 25 THEN 'Extreme Fear'
    WHEN fear_greed_index < 45 THEN 'Fear' WHEN fear_greed_index <= 55 THEN 'Neutral' WHEN fear_greed_index <= 75 THEN 'Greed'
    ELSE 'Extreme Greed' END AS label FROM ix"""


QUERIES = {
    "walk_forward": (q_walk_forward, SQL_WALK_FORWARD),
    "walk_forward_strategy": (q_walk_forward_strategy, SQL_WALK_FORWARD_STRATEGY),
    "walk_forward_summary": (q_walk_forward_summary, SQL_WALK_FORWARD_SUMMARY),
    "bootstrap_outcomes": (q_bootstrap_outcomes, SQL_BOOTSTRAP_OUTCOMES),
    "outcome_stats": (q_outcome_stats, SQL_OUTCOME_STATS),
    "walk_book": (q_walk_book, SQL_WALK_BOOK),
    "execution_slices": (q_execution_slices, SQL_EXECUTION_SLICES),
    "vwap_cost": (q_vwap_cost, SQL_VWAP_COST),
    "price_features": (q_price_features, SQL_PRICE_FEATURES),
    "forecast": (q_forecast, SQL_FORECAST),
    "text_classifier": (q_text_classifier, None),
    "model_scores": (q_model_scores, SQL_MODEL_SCORES),
    "embedding_score": (q_embedding_score, SQL_EMBEDDING_SCORE),
    "metric_series": (q_metric_series, SQL_METRIC_SERIES),
    "stream_sentiment": (q_stream_sentiment, SQL_STREAM_SENTIMENT),
    "stream_signals": (q_stream_signals, SQL_STREAM_SIGNALS),
    "stream_dedupe": (q_stream_dedupe, SQL_STREAM_DEDUPE),
    "stream_fgi": (q_stream_fgi, SQL_STREAM_FGI),
}
