"""Fund-flow proxy from bars: flow, spikes, correlation and a recommendation per bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from marketpulse.functions import frames as fr
from marketpulse.functions.numeric import corr, div, num
from marketpulse.operators.joins import market_pairs
from marketpulse.operators.series import last_rows, over_series


def fund_flow(bars: DataFrame, n: int = 24, **series) -> DataFrame:
    """Flow measures over the last n bars at every bar that has n bars.

    Returns inside a frame start at its second bar, as if each frame stood alone.
    """
    def step(d: DataFrame, w: WindowSpec) -> DataFrame:
        f, inner = fr.back(w, n), fr.back(w, n - 1)
        d = d.withColumn("_ret", fr.change(F.col("close"), 1, w))
        v, p = F.col("volume"), F.col("close")
        d = d.withColumns({
            "_n": F.count(v).over(f), "_avg": F.avg(v).over(f), "_mom": F.avg("_ret").over(inner),
            "_vol": F.stddev_samp("_ret").over(inner),
            "_corr": div(F.covar_pop(v, p).over(f), F.stddev_pop(v).over(f) * F.stddev_pop(p).over(f)),
            "_list": F.collect_list(v).over(f),
        }).where(F.col("_n") >= n)
        ratio = F.when(F.col("_avg") > 0, F.col("volume") / F.col("_avg")).otherwise(num(1))
        d = d.withColumn("net_flow", F.col("volume") * F.col("_mom") * ratio)
        net = F.col("net_flow")
        spikes = F.size(F.filter("_list", lambda x: x > F.col("_avg") * 2))
        return d.withColumns({
            "inflow": F.when(net > 0, net).otherwise(num(0)),
            "outflow": F.when(net > 0, num(0)).otherwise(F.abs(net)),
            "whale_transactions": spikes.cast("bigint"),
            "exchange_netflow": -net * F.col("_vol"),
            "correlation_score": F.coalesce("_corr", num(0)),
        })
    out = over_series(bars, step, n, **series)
    return out.select("symbol", "ts", "net_flow", "inflow", "outflow", "whale_transactions", "exchange_netflow",
                      "correlation_score")


def flow_signal(flow: DataFrame) -> DataFrame:
    """flow_score, flow_strength and one of five recommendations per row."""
    net, r = F.col("net_flow"), F.abs("correlation_score")
    score = F.when(net > 0, num(1)).otherwise(num(-1)) * F.least(F.abs(net) / 1e9, num(1)) * r
    strength = (r + F.least(F.col("whale_transactions") / num(10), num(1))) / 2
    d = flow.withColumns({"flow_score": score, "flow_strength": strength})
    s, q = F.col("flow_score"), F.col("flow_strength")
    rec = (
        F.when((s > 0.3) & (q > 0.5), "STRONG_BUY").when(s > 0.1, "BUY").when((s < -0.3) & (q > 0.5), "STRONG_SELL")
        .when(s < -0.1, "SELL").otherwise("NEUTRAL")
    )
    return d.withColumn("recommendation", rec)


def flow_change(flow: DataFrame, n: int = 24, **series) -> DataFrame:
    """Change against the n-th last value (the current one counts) in percent of its size; 0 if there is none."""
    def step(d, w):
        old = F.lag("net_flow", n - 1).over(w)
        change = div(F.col("net_flow") - old, F.abs(old)) * 100
        return d.withColumn("flow_change_pct", F.coalesce(change, num(0)))
    return over_series(flow, step, n - 1, **series)


def flow_summary(flow: DataFrame) -> DataFrame:
    """The newest row of each symbol with its change and recommendation."""
    return last_rows(flow_signal(flow_change(flow)), 1)


def flow_correlation(flow: DataFrame, n: int = 24, least: int = 10) -> DataFrame:
    """Correlation of the last n flows of each pair of symbols, 0 below ``least`` common rows."""
    tail = last_rows(flow, n)
    pairs = market_pairs(tail, "net_flow")
    return pairs.groupBy("market1", "market2").agg(
        F.when(F.count(F.lit(1)) >= least, F.coalesce(corr(F.col("x"), F.col("y")), num(0)))
        .otherwise(num(0)).alias("correlation"),
        F.count(F.lit(1)).alias("n"),
    )
