"""Trade and risk statistics and the two reports built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions import frames as fr
from marketpulse.functions.numeric import corr, div, num, seconds_between
from marketpulse.operators import indicators as ind
from marketpulse.operators.joins import beside, join_or_beside
from marketpulse.operators.quantiles import exact_quantiles, value_at_share
from marketpulse.operators.series import over_series
from marketpulse.session import sized

PORTFOLIO = "portfolio_id"


def _zero(x: Column) -> Column:
    return F.coalesce(x, num(0))


def win_rate(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Wins, losses and their shares of all decided trades."""
    won, lost = F.count_if(F.col("pnl") > 0), F.count_if(F.col("pnl") < 0)
    return trades.groupBy(*by).agg(
        won.alias("wins"), lost.alias("losses"),
        _zero(div(won.cast("double"), won + lost)).alias("win_rate"),
        _zero(div(lost.cast("double"), won + lost)).alias("loss_rate"),
    )


def profit_factor_expr() -> Column:
    """Gross profit / gross loss; NULL without losses, 0 without trades that won or lost."""
    gain = _zero(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))))
    loss = F.abs(_zero(F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))))
    return F.when((gain == 0) & (loss == 0), num(0)).otherwise(div(gain, loss))


def profit_factor(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return trades.groupBy(*by).agg(profit_factor_expr().alias("profit_factor"))


def trade_stats(trades: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, win share of all trades (percent), mean and extreme wins and losses, profit factor, duration."""
    up, down = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    everything = F.count(F.lit(1))
    return trades.groupBy(*by).agg(
        everything.alias("total_trades"),
        F.count(up).alias("winning_trades"), F.count(down).alias("losing_trades"),
        _zero(div(F.count(up).cast("double"), everything) * 100).alias("win_rate"),
        _zero(F.avg(up)).alias("avg_win"), _zero(F.avg(down)).alias("avg_loss"),
        _zero(F.max(up)).alias("largest_win"), _zero(F.min(down)).alias("largest_loss"),
        profit_factor_expr().alias("profit_factor"),
        _zero(F.avg(seconds_between(F.col("entry_time"), F.col("exit_time")))).alias("avg_duration_seconds"),
    )


def sharpe_expr(r: Column, rf: float = 0.02, periods: int = 252, form: str = "daily") -> Column:
    """``daily``: mean of r - rf / periods over its deviation x sqrt(periods).
    ``annual``: (mean x periods - rf) / (deviation x sqrt(periods))."""
    spread = F.stddev_samp(r)
    if form == "daily":
        return _zero(div(F.avg(r) - rf / periods, spread) * F.sqrt(num(periods)))
    if form == "annual":
        return _zero(div(F.avg(r) * periods - rf, spread * F.sqrt(num(periods))))
    raise ValueError(f"unknown form: {form}")


def sortino_expr(r: Column, rf: float = 0.04, periods: int = 8760) -> Column:
    """Annual form with the deviation of the negative returns; the Sharpe ratio if there are none."""
    below = F.when(r < 0, r)
    ratio = div(F.avg(r) * periods - rf, F.stddev_samp(below) * F.sqrt(num(periods)))
    return F.when(F.count(below) == 0, sharpe_expr(r, rf, periods, "annual")).otherwise(_zero(ratio))


def sharpe(returns: DataFrame, col: str = "ret", rf: float = 0.02, periods: int = 252, form: str = "daily",
           by: Sequence[str] = ()) -> DataFrame:
    return returns.groupBy(*by).agg(sharpe_expr(F.col(col), rf, periods, form).alias("sharpe_ratio"))


def sortino(returns: DataFrame, col: str = "ret", rf: float = 0.04, periods: int = 8760,
            by: Sequence[str] = ()) -> DataFrame:
    return returns.groupBy(*by).agg(sortino_expr(F.col(col), rf, periods).alias("sortino_ratio"))


def var_cvar(returns: DataFrame, col: str = "ret", confidence: float = 0.95, by: Sequence[str] = (PORTFOLIO,),
             least: int = 10) -> DataFrame:
    """Loss at sorted position int((1 - confidence) x n) and the mean loss up to it; 0 below ``least`` rows."""
    by = list(by)
    cut = sized(value_at_share(returns, by, col, 1 - confidence))
    x, q = F.col(col), F.col("q")
    worse = F.when(x < q, x)
    # Rows equal to the cut fill up the tail to rank + 1 rows.
    tail = returns.join(cut, by).groupBy(*by).agg(
        F.first("q").alias("_q"), F.first("n").alias("_n"), F.first("rank").alias("_rank"),
        _zero(F.sum(worse)).alias("_sum"), F.count(worse).alias("_below"),
    )
    size = F.col("_rank") + 1
    mean = (F.col("_sum") + (size - F.col("_below")) * F.col("_q")) / size
    enough = F.col("_n") >= least
    return tail.select(
        *by, F.when(enough, -F.col("_q")).otherwise(num(0)).alias("value_at_risk"),
        F.when(enough, -mean).otherwise(num(0)).alias("conditional_var"),
    )


def labelled_corr(df: DataFrame, x: str, y: str, by: Sequence[str] = (), least: int = 10) -> DataFrame:
    """Correlation with a strength and a direction label."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    d = df.groupBy(*by).agg(F.count_if(both).alias("pairs"), corr(F.col(x), F.col(y)).alias("_r"))
    r, enough = F.col("_r"), F.col("pairs") >= least
    size = F.abs(r)
    strength = (
        F.when(~enough, "insufficient_data").when(size >= 0.7, "strong").when(size >= 0.4, "moderate")
        .when(size >= 0.2, "weak").otherwise("none")
    )
    way = F.when(enough & (r > 0.1), "positive").when(enough & (r < -0.1), "negative").otherwise("neutral")
    return d.select(*by, "pairs", F.when(enough, _zero(r)).otherwise(num(0)).alias("correlation"),
                    strength.alias("significance"), way.alias("direction"))


def equity_returns(equity: DataFrame, by=(PORTFOLIO,)) -> DataFrame:
    return over_series(equity, lambda d, w: d.withColumn("ret", fr.change(F.col("equity"), 1, w)), 1, by=by)


def backtest_summary(trades: DataFrame, equity: DataFrame, capital: float, rf: float = 0.04,
                     periods: int = 8760) -> DataFrame:
    """One row per portfolio: capital, return, drawdown, ratios and trade statistics."""
    by = [PORTFOLIO]
    curve = ind.drawdown(equity_returns(equity))
    facts = curve.groupBy(*by).agg(
        F.min("ts").alias("start_date"), F.max("ts").alias("end_date"),
        F.max_by("equity", "ts").alias("final_capital"),
        F.min("drawdown").alias("max_drawdown"), F.abs(F.min("drawdown_pct")).alias("max_drawdown_percent"),
        sharpe_expr(F.col("ret"), rf, periods, "annual").alias("sharpe_ratio"),
        sortino_expr(F.col("ret"), rf, periods).alias("sortino_ratio"),
    )
    gain = F.col("final_capital") - capital
    facts = facts.withColumns({
        "initial_capital": num(capital), "total_return": gain, "total_return_percent": gain / capital * 100,
    })
    return beside(facts, trade_stats(trades))


def performance_report(trades: DataFrame, equity: DataFrame, rf: float = 0.02, periods: int = 252,
                       sentiment: str | None = None) -> DataFrame:
    """One row per portfolio of return, risk and trade measures, with a rating."""
    by = [PORTFOLIO]
    returns = equity_returns(equity)
    x = F.col("ret")
    facts = returns.groupBy(*by).agg(
        F.count(F.lit(1)).alias("analysis_period_days"),
        (div(F.max_by("equity", "ts"), F.min_by("equity", "ts")) - 1).alias("total_return"),
        sharpe_expr(x, rf, periods).alias("sharpe_ratio"),
        _zero(F.stddev_pop(x) * F.sqrt(num(252))).alias("volatility"),
    )
    grown = 1 + F.col("total_return")
    facts = facts.withColumn("annualized_return", F.when(grown > 0, F.pow(
        grown, num(365) / F.col("analysis_period_days"))).otherwise(num(0)) - 1)
    worst = ind.drawdown_duration(equity)
    tail = var_cvar(returns)
    decided = beside(win_rate(trades), trades.agg(
        F.count(F.lit(1)).alias("num_trades"), profit_factor_expr().alias("profit_factor")))
    out = beside(facts.join(worst, by).join(tail, by), decided)
    if sentiment is not None:
        r = labelled_corr(trades, sentiment, "pnl")
        out = beside(out, r.select(
            F.col("correlation").alias("sentiment_price_correlation"),
            F.col("significance").alias("correlation_significance"),
            F.col("direction").alias("correlation_direction")))
    s = F.col("sharpe_ratio")
    rating = F.when(s > 2, "Excellent").when(s > 1, "Good").when(s > 0.5, "Fair").otherwise("Poor")
    return out.withColumn("rating", rating)


def latency_report(stages: DataFrame, stage: str = "stage", value: str = "latency_ms",
                   targets: dict[str, float] | None = None) -> DataFrame:
    """Mean, p50, p95, p99 and maximum per stage; meets_target compares p95."""
    q = exact_quantiles(stages, [stage], value, [0.5, 0.95, 0.99])
    wide = q.groupBy(stage).agg(*[
        F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))
    ])
    basics = stages.groupBy(stage).agg(
        F.count(value).alias("n"), F.avg(value).alias("avg"), F.max(value).alias("max"))
    out = basics.join(wide, stage)
    if targets:
        pairs = [v for k, t in targets.items() for v in (F.lit(k), num(t))]
        limit = F.try_element_at(F.create_map(*pairs), F.col(stage))
        out = out.withColumn("meets_target", F.col("p95") < limit)
    return out


def histogram(df: DataFrame, col: str, n: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Rows per bin of n equal bins between the least and the largest value (the last bin is closed)."""
    by = list(by)
    span = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    joined = join_or_beside(df, sized(span), by)
    width = (F.col("_hi") - F.col("_lo")) / n
    place = F.coalesce(F.floor(div(F.col(col) - F.col("_lo"), width)), F.lit(0))
    binned = joined.where(F.col(col).isNotNull()).withColumn("bin", F.least(place, F.lit(n - 1)).cast("bigint"))
    counts = binned.groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / n
    return counts.select(*by, "bin", (F.col("_lo") + step * F.col("bin")).alias("bin_start"), "n")


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Least, largest and mean value of each column."""
    return df.groupBy(*by).agg(*[
        f(c).alias(f"{n}_{c}") for c in cols for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))
    ])


def guard_min_rows(df: DataFrame, by: Sequence[str], least: int, neutral: dict[str, float]) -> DataFrame:
    """Replace the named measures by their neutral value where ``rows`` is below ``least``."""
    few = F.col("rows") < least
    return df.withColumns({c: F.when(few, num(v)).otherwise(F.col(c)) for c, v in neutral.items()})
