"""Execution costs: order-book fills, schedules, VWAP, liquidity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions.numeric import div, num
from marketpulse.functions.scoring import market_impact
from marketpulse.operators.series import last_rows


def walk_book(orders: DataFrame, levels: DataFrame, coefficient: float = 0.1, temporary_decay: float = 0.5) -> DataFrame:
    """Fill orders(order_id, book_id, side, size) from levels(book_id, side, level, price, volume).

    A buy takes the asks, a sell the bids, level by level. Books have few levels: the
    volume before each level is computed once per book, not per order, and an order
    meets the levels of its own book only.
    """
    w = Window.partitionBy("book_id", "side").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    stacked = levels.withColumn("_before", F.coalesce(F.sum("volume").over(w), num(0)))
    packed = stacked.groupBy("book_id").agg(
        F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("_bid"),
        F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("_ask"),
        F.max("volume").alias("_depth"),
        F.collect_list(F.when(F.col("side") == "ask", F.struct("_before", "price", "volume"))).alias("_asks"),
        F.collect_list(F.when(F.col("side") == "bid", F.struct("_before", "price", "volume"))).alias("_bids"),
    )
    d = orders.join(packed, "book_id")
    taken = F.when(F.col("side") == "buy", F.col("_asks")).otherwise(F.col("_bids"))
    fills = F.transform(taken, lambda x: F.struct(
        F.least(x["volume"], F.greatest(F.col("size") - x["_before"], num(0))).alias("v"), x["price"].alias("p")))
    d = d.withColumn("_fills", fills)
    zero = F.struct(num(0).alias("v"), num(0).alias("c"))
    d = d.withColumn("_sum", F.aggregate("_fills", zero, lambda s, f: F.struct(
        (s["v"] + f["v"]).alias("v"), (s["c"] + f["v"] * f["p"]).alias("c"))))
    d = d.withColumn("intended_price", (F.col("_bid") + F.col("_ask")) / 2)
    mid = F.col("intended_price")
    d = d.withColumns({
        "executed": F.col("_sum.v"), "execution_price": F.coalesce(div(F.col("_sum.c"), F.col("_sum.v")), mid),
    })
    way = F.when(F.col("side") == "buy", 1).otherwise(-1)
    d = d.withColumn("slippage", (F.col("execution_price") - mid) * way)
    spread = (F.col("_ask") - F.col("_bid")) / mid
    temporary, permanent = market_impact(F.col("size"), F.col("_depth"), spread, coefficient, temporary_decay)
    return d.select(
        "order_id", "book_id", "side", "size", "executed", "intended_price", "execution_price", "slippage",
        (F.col("slippage") / mid).alias("slippage_pct"), F.abs(F.col("slippage") * F.col("size")).alias("impact_cost"),
        (temporary * mid).alias("temporary_impact"), (permanent * mid).alias("permanent_impact"),
    )


def execution_slices(orders: DataFrame, horizon: int = 10, risk: float = 1.0) -> DataFrame:
    """(order_id, t, slice): equal parts below a risk aversion of 0.5, else parts that decay exponentially."""
    if horizon <= 0:
        return orders.select("order_id", F.lit(0).alias("t"), F.col("size").alias("slice"))
    rate = 0.5 * risk if risk >= 0.5 else 0.0
    t = F.sequence(F.lit(0), F.lit(horizon - 1))
    weights = F.transform(t, lambda i: F.exp(-(num(rate) * i / horizon)))
    whole = F.aggregate(weights, num(0), lambda s, v: s + v)
    parts = F.transform(weights, lambda v: v / whole)
    return orders.select("order_id", "size", F.posexplode(parts).alias("t", "_share")).select(
        "order_id", "t", (F.col("size") * F.col("_share")).alias("slice"))


def vwap_cost(bars: DataFrame, size: float, coefficient: float = 0.1) -> DataFrame:
    """Per symbol: volume-weighted price against the arrival price, slippage, impact and total cost."""
    p, v = F.col("close"), F.col("volume")
    d = bars.groupBy("symbol").agg(
        F.min_by("close", "ts").alias("benchmark_price"), div(F.sum(p * v), F.sum(v)).alias("vwap"),
        F.avg(v).alias("_liquidity"))
    d = d.withColumn("slippage", F.col("vwap") - F.col("benchmark_price"))
    impact = div(num(size), F.col("_liquidity")) * coefficient * F.col("benchmark_price")
    d = d.withColumn("impact_cost", impact)
    return d.select(
        "symbol", "benchmark_price", "vwap", "slippage", div(F.col("slippage"), F.col("benchmark_price")).alias("slippage_pct"),
        "impact_cost", (F.abs(F.col("slippage") * size) + F.col("impact_cost")).alias("total_cost"))


def liquidity(bars: DataFrame, n: int = 20, floor: float = 1000.0) -> DataFrame:
    """Mean volume of the last n bars over (1 + its relative deviation), at least ``floor``."""
    tail = last_rows(bars.select("symbol", "ts", "volume"), n)
    mean, spread = F.avg("volume"), F.stddev_samp("volume")
    return tail.groupBy("symbol").agg(
        F.greatest(F.coalesce(mean / (1 + div(spread, mean)), num(floor)), num(floor)).alias("liquidity"))


def impact_of(orders: DataFrame, liquidity_col: str = "liquidity", volatility: str = "volatility") -> DataFrame:
    """Temporary and permanent impact of each order as a share of the price."""
    temporary, permanent = market_impact(F.col("size"), F.col(liquidity_col), F.col(volatility))
    return orders.withColumns({"temporary_impact": temporary, "permanent_impact": permanent})
