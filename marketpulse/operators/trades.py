"""Trades from signals as sets, the equity curve, and their sinks.

Signals of one side in a row form a run; the first signal of a run opens a trade and
the next run closes it, unless a stop, a target or the end of the data comes first.
Each bar belongs to the newest trade opened before it, so stops are found with an
as-of join and one aggregation, not with a range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.numeric import div, num, seconds_between
from marketpulse.functions.scoring import commission, fill_price, pnl, pnl_percent, side
from marketpulse.operators.joins import asof_join
from marketpulse.operators.series import over_series, running
from marketpulse.session import materialise

CAPITAL = 100_000.0
PORTFOLIO = "portfolio_id"


def extract_trades(signals: DataFrame, bars: DataFrame, capital: float = CAPITAL, max_size: float = 0.25,
                   slippage: float = 0.0005, rate: float = 0.001, stop: float = 0.02, take: float = 0.06,
                   check_on: str = "bars", tolerance: float | None = None) -> DataFrame:
    """Closed trades of signals(symbol, ts, action, position_size, confidence, fear_greed_index).

    Every trade has the same notional base (``capital`` x min(position_size, max_size)).
    ``check_on``: stops and targets are tested on ``bars`` or only at ``signals``. After a
    stop or target the symbol stays flat until the side changes.
    """
    wanted = signals.select("symbol", "ts", "action", "position_size", "confidence", "fear_greed_index").withColumn(
        "side", side(F.col("action"))
    )
    priced = asof_join(wanted, bars, ("close",), tolerance=tolerance).where(F.col("close").isNotNull())
    priced = materialise(priced, "priced")
    sided = priced.where(F.col("side") != 0)
    turns = materialise(over_series(
        sided, lambda d, w: d.withColumn("_was", F.lag("side").over(w)), 1
    ).where(F.col("_was").isNull() | (F.col("_was") != F.col("side"))).drop("_was"), "turns")
    long = F.col("side") > 0
    entry = fill_price(F.col("close"), long, slippage)
    opened = over_series(
        turns, lambda d, w: d.withColumn("_turn", F.lead(F.struct("ts", "close")).over(w)), 0, 1
    ).withColumn("entry_price", entry)
    opened = materialise(opened.select(
        "symbol", "ts", "action", "side", "entry_price", F.least("position_size", num(max_size)).alias("position_size"),
        "confidence", "fear_greed_index", F.col("_turn.ts").alias("turn_ts"), F.col("_turn.close").alias("turn_close"),
    ), "opened")

    checks = (bars if check_on == "bars" else priced).select("symbol", "ts", "close")
    held = asof_join(checks, opened.select("symbol", "ts", "side", "entry_price"), ("side", "entry_price"),
                     bar_ts="entry_time").where(F.col("ts") > F.col("entry_time"))
    move = F.when(F.col("side") > 0, F.col("close") / F.col("entry_price")).otherwise(
        div(F.col("entry_price"), F.col("close"))) - 1
    reason = F.when(move <= -stop, "stop").when(move >= take, "take")
    hits = held.withColumn("reason", reason).where(F.col("reason").isNotNull()).groupBy("symbol", "entry_time").agg(
        F.min_by(F.struct("ts", "close", "reason"), "ts").alias("_hit")
    )
    ends = bars.groupBy("symbol").agg(F.max_by(F.struct("ts", "close"), "ts").alias("_end"))

    d = opened.withColumnRenamed("ts", "entry_time").join(hits, ["symbol", "entry_time"], "left").join(ends, "symbol")
    hit, turned = F.col("_hit").isNotNull(), F.col("turn_ts").isNotNull()
    d = d.withColumns({
        "exit_reason": F.when(hit, F.col("_hit.reason")).when(turned, "reversal").otherwise("end"),
        "exit_time": F.coalesce("_hit.ts", "turn_ts", F.greatest("_end.ts", "entry_time")),
        "_market": F.coalesce("_hit.close", "turn_close", "_end.close"),
        "quantity": num(capital) * F.col("position_size") / F.col("entry_price"),
    })
    slipped = fill_price(F.col("_market"), F.col("side") < 0, slippage)
    d = d.withColumn("exit_price", F.when(F.col("exit_reason") == "end", F.col("_market")).otherwise(slipped))
    paid_out = F.when(F.col("exit_reason") == "end", num(0)).otherwise(
        commission(F.col("exit_price"), F.col("quantity"), rate))
    return d.select(
        "entry_time", "exit_time", "symbol", "action", "entry_price", "exit_price", "position_size", "quantity",
        pnl(F.col("side"), F.col("entry_price"), F.col("exit_price"), F.col("quantity")).alias("pnl"),
        pnl_percent(F.col("side"), F.col("entry_price"), F.col("exit_price")).alias("pnl_percent"),
        "confidence", "fear_greed_index", F.lit("CLOSED").alias("status"), "exit_reason", "side",
        commission(F.col("entry_price"), F.col("quantity"), rate).alias("entry_fee"), paid_out.alias("exit_fee"),
    )


def close_trades(trades: DataFrame) -> DataFrame:
    """pnl, pnl_percent and status of trades that have an exit price."""
    s = side(F.col("action"))
    return trades.withColumns({
        "pnl": pnl(s, F.col("entry_price"), F.col("exit_price"), F.col("quantity")),
        "pnl_percent": pnl_percent(s, F.col("entry_price"), F.col("exit_price")),
        "status": F.when(F.col("exit_price").isNull(), "OPEN").otherwise("CLOSED"),
    })


def equity_curve(trades: DataFrame, bars: DataFrame, capital: float = CAPITAL, portfolio: str = "main") -> DataFrame:
    """(portfolio_id, ts, equity): capital + realised + open profit, fees paid, at every bar time.

    Each symbol contributes the change of its profit at its own bars; the changes are
    summed per time and then over time, so every open position keeps its last price.
    """
    net = F.col("pnl") - F.col("entry_fee") - F.col("exit_fee")
    booked = running(trades.withColumn("_net", net), {"_upto": ("sum", F.col("_net"))}, order=("entry_time",))
    steps = booked.select(
        "symbol", F.col("entry_time").alias("ts"), "exit_time", "side", "entry_price", "quantity", "entry_fee",
        F.col("_upto").alias("closed"), (F.col("_upto") - F.col("_net")).alias("before"),
    )
    steps = materialise(steps, "booked")
    values = ("exit_time", "side", "entry_price", "quantity", "entry_fee", "closed", "before")
    marked = asof_join(bars.select("symbol", "ts", "close"), steps, values, bar_ts="entry_time")
    open_profit = pnl(F.col("side"), F.col("entry_price"), F.col("close"), F.col("quantity")) - F.col("entry_fee")
    profit = F.when(F.col("entry_time").isNull(), num(0)).when(
        F.col("ts") >= F.col("exit_time"), F.col("closed")).otherwise(F.col("before") + open_profit)
    marked = materialise(marked.select("symbol", "ts", profit.alias("_profit")), "marked")
    moved = over_series(
        marked, lambda d, w: d.withColumn("_step", F.col("_profit") - F.coalesce(F.lag("_profit").over(w), num(0))), 1
    )
    total = moved.groupBy("ts").agg(F.sum("_step").alias("_step")).withColumn(PORTFOLIO, F.lit(portfolio))
    curve = running(total, {"_gain": ("sum", F.col("_step"))}, by=(PORTFOLIO,))
    return curve.select(PORTFOLIO, "ts", (num(capital) + F.col("_gain")).alias("equity"))


def pnl_by(trades: DataFrame, key: str) -> DataFrame:
    """Profit, trades and win share (percent) per value of ``key``."""
    return trades.groupBy(key).agg(
        F.sum("pnl").alias("total_pnl"), F.count(F.lit(1)).alias("trades"),
        (F.avg((F.col("pnl") > 0).cast("int")) * 100).alias("win_rate"),
    )


def top_trades(trades: DataFrame, k: int = 3, best: bool = True) -> DataFrame:
    """The k best (or worst) trades by profit."""
    way = F.col("pnl").desc() if best else F.col("pnl").asc()
    return trades.orderBy(way, "symbol", "entry_time").limit(k)


def cum_pnl(trades: DataFrame) -> DataFrame:
    """Profit summed over the trades of a symbol, with the trade number."""
    return running(trades, {"cum_pnl": ("sum", F.col("pnl")), "trade_no": ("count", F.lit(1))}, order=("entry_time",))


def trade_duration(trades: DataFrame) -> DataFrame:
    return trades.withColumn("duration_seconds", seconds_between(F.col("entry_time"), F.col("exit_time")))

