"""Technical indicators: windows over bars(symbol, ts, open, high, low, close, volume).

Each operator adds columns to its input. ``_add_*`` functions take the window from
``over_series`` and can be chained in one pass; the public operators wrap one each.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from marketpulse.functions import frames as fr
from marketpulse.functions.numeric import clip, div, nonzero, num
from marketpulse.operators.quantiles import ACCURACY
from marketpulse.operators.series import over_series, running
from marketpulse.session import materialise, sized

#: Weights below e^-45 (3e-20) do not change a double.
EWM_WEIGHT = 45.0
#: Largest exponent of the powers within a block; e^709 is the largest double.
EWM_POWER = 600.0


def ewm_reach(span: float) -> int:
    """Rows after which a weight of this span no longer counts."""
    return 1 if span <= 1 else math.ceil(EWM_WEIGHT / -math.log(1 - 2 / (span + 1)))


def macd_reach(fast: float = 12, slow: float = 26, signal: float = 9) -> int:
    return ewm_reach(max(fast, slow)) + ewm_reach(signal)


# --- steps -------------------------------------------------------------------

def add_returns(d: DataFrame, w: WindowSpec, col: str = "close") -> DataFrame:
    x = F.col(col)
    return d.withColumns({"ret": fr.change(x, 1, w), "log_ret": F.ln(div(x, F.lag(x).over(w)))})


def add_rsi(d: DataFrame, w: WindowSpec, n: int = 14, col: str = "close", zero_loss: str = "one",
            out: str = "rsi") -> DataFrame:
    """``one``: a zero loss divides by 1. ``hundred``: a zero loss is 100, and 0 before n changes."""
    d = d.withColumn("_move", fr.diff(F.col(col), w))
    up = F.when(F.col("_move") > 0, F.col("_move")).otherwise(num(0))
    down = F.when(F.col("_move") < 0, -F.col("_move")).otherwise(num(0))
    f = fr.back(w, n)
    d = d.withColumns({"_up": F.avg(up).over(f), "_down": F.avg(down).over(f),
                       "_n": F.count(F.lit(1)).over(f), "_moves": F.count("_move").over(f)})
    if zero_loss == "one":
        rs = F.col("_up") / nonzero(F.col("_down"))
        value = F.when(F.col("_n") >= n, 100 - 100 / (1 + rs))
    else:
        rs = div(F.col("_up"), F.col("_down"))
        value = (
            F.when(F.col("_moves") < n, num(0))
            .when(F.col("_down") == 0, num(100))
            .otherwise(100 - 100 / (1 + rs))
        )
    return d.withColumn(out, value).drop("_move", "_up", "_down", "_n", "_moves")


def add_bollinger(d: DataFrame, w: WindowSpec, n: int = 20, k: float = 2.0, col: str = "close",
                  out: str = "bb_position") -> DataFrame:
    x = F.col(col)
    d = d.withColumns({"_mid": fr.sma(x, n, w), "_dev": fr.std(x, n, w)})
    low, high = F.col("_mid") - F.col("_dev") * k, F.col("_mid") + F.col("_dev") * k
    return d.withColumn(out, clip((x - low) / nonzero(high - low), 0, 1)).drop("_mid", "_dev")


def add_atr(d: DataFrame, w: WindowSpec, n: int = 14) -> DataFrame:
    before = F.lag("close").over(w)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before),
                            F.abs(F.col("low") - before))
    d = d.withColumn("true_range", true_range)
    return d.withColumn("atr", fr.sma(F.col("true_range"), n, w))


def add_adx(d: DataFrame, w: WindowSpec, n: int = 14) -> DataFrame:
    d = add_atr(d, w, n)
    d = d.withColumns({
        "_up": fr.diff(F.col("high"), w),
        "_down": F.lag("low").over(w) - F.col("low"),
    })
    up, down = F.col("_up"), F.col("_down")
    d = d.withColumns({
        "_plus": F.when((up > down) & (up > 0), up).otherwise(num(0)),
        "_minus": F.when((down > up) & (down > 0), down).otherwise(num(0)),
    })
    atr = nonzero(F.col("atr"))
    d = d.withColumns({
        "plus_di": 100 * fr.sma(F.col("_plus"), n, w) / atr,
        "minus_di": 100 * fr.sma(F.col("_minus"), n, w) / atr,
    })
    spread = F.abs(F.col("plus_di") - F.col("minus_di"))
    d = d.withColumn("dx", 100 * spread / nonzero(F.col("plus_di") + F.col("minus_di")))
    return d.withColumn("adx", fr.sma(F.col("dx"), n, w)).drop("_up", "_down", "_plus", "_minus")


def add_sma_distance(d: DataFrame, w: WindowSpec, windows=(20, 50, 200), col: str = "close") -> DataFrame:
    """sma_n, price_to_sma_n for each n and the distance of each pair of neighbours."""
    x = F.col(col)
    d = d.withColumns({f"sma_{n}": fr.sma(x, n, w) for n in windows})
    d = d.withColumns({f"price_to_sma_{n}": div(x - F.col(f"sma_{n}"), F.col(f"sma_{n}")) for n in windows})
    return d.withColumns({
        f"sma_{a}_{b}_cross": div(F.col(f"sma_{a}") - F.col(f"sma_{b}"), F.col(f"sma_{b}"))
        for a, b in zip(windows, windows[1:])
    })


def add_hl_ratio(d: DataFrame) -> DataFrame:
    return d.withColumn("hl_ratio", div(F.col("high") - F.col("low"), F.col("close")))


def add_macd(d: DataFrame, w: WindowSpec, fast: int = 12, slow: int = 26, signal: int = 9,
             col: str = "close") -> DataFrame:
    """Needs the row number ``_rn`` and blocks of ``macd_reach`` rows with as many before them."""
    at, rn = F.col("_at"), F.col("_rn")
    d = d.withColumn("_at", F.row_number().over(w) - 1)
    x = F.col(col)
    d = d.withColumn("macd", fr.geometric(x, at, rn, fast, w) - fr.geometric(x, at, rn, slow, w))
    d = d.withColumn("macd_signal", fr.geometric(F.col("macd"), at, rn, signal, w))
    return d.drop("_at")


# --- operators ---------------------------------------------------------------

def pct_change(df: DataFrame, col: str = "close", n: int = 1, out: str | None = None, **series) -> DataFrame:
    name = out or f"ret_{n}"
    return over_series(df, lambda d, w: d.withColumn(name, fr.change(F.col(col), n, w)), n, **series)


def log_return(df: DataFrame, col: str = "close", **series) -> DataFrame:
    return over_series(
        df, lambda d, w: d.withColumn("log_ret", F.ln(div(F.col(col), F.lag(col).over(w)))), 1, **series
    )


def sma(df: DataFrame, col: str = "close", n: int = 20, fill: float | None = None, **series) -> DataFrame:
    """Strict mean of n rows; ``fill`` replaces the NULLs of the first rows."""
    def step(d, w):
        mean = fr.sma(F.col(col), n, w)
        return d.withColumn(f"sma_{n}", mean if fill is None else F.coalesce(mean, num(fill)))
    return over_series(df, step, n - 1, **series)


def rolling_std(df: DataFrame, col: str, n: int, **series) -> DataFrame:
    return over_series(df, lambda d, w: d.withColumn(f"std_{n}", fr.std(F.col(col), n, w)), n - 1, **series)


def rolling_sum(df: DataFrame, col: str, n: int, **series) -> DataFrame:
    return over_series(df, lambda d, w: d.withColumn(f"sum_{n}", fr.total(F.col(col), n, w)), n - 1, **series)


def rolling_mean_partial(df: DataFrame, col: str, n: int = 20, **series) -> DataFrame:
    return over_series(
        df, lambda d, w: d.withColumn(f"mean_{n}", fr.mean_partial(F.col(col), n, w)), n - 1, **series
    )


def diff(df: DataFrame, col: str, order_n: int = 1, **series) -> DataFrame:
    """First (``order_n`` = 1) or second difference."""
    def step(d, w):
        d = d.withColumn(f"{col}_diff", fr.diff(F.col(col), w))
        return d if order_n == 1 else d.withColumn(f"{col}_diff2", fr.diff(F.col(f"{col}_diff"), w))
    return over_series(df, step, order_n, **series)


def volume_ratio(df: DataFrame, n: int = 20, **series) -> DataFrame:
    return over_series(
        df, lambda d, w: d.withColumn("volume_ratio", fr.volume_ratio(F.col("volume"), n, w)), n - 1, **series
    )


def annual_vol(df: DataFrame, n: int = 24, **series) -> DataFrame:
    def step(d, w):
        return add_returns(d, w).withColumn("annual_vol", fr.std(F.col("ret"), n, w) * F.sqrt(num(n)))
    return over_series(df, step, n, **series)


def rsi(df: DataFrame, n: int = 14, zero_loss: str = "one", **series) -> DataFrame:
    return over_series(df, lambda d, w: add_rsi(d, w, n, zero_loss=zero_loss), n, **series)


def bollinger_pos(df: DataFrame, n: int = 20, k: float = 2.0, **series) -> DataFrame:
    return over_series(df, lambda d, w: add_bollinger(d, w, n, k), n - 1, **series)


def atr(df: DataFrame, n: int = 14, **series) -> DataFrame:
    return over_series(df, lambda d, w: add_atr(d, w, n), n, **series)


def adx(df: DataFrame, n: int = 14, **series) -> DataFrame:
    return over_series(df, lambda d, w: add_adx(d, w, n), 2 * n, **series)


def sma_distance(df: DataFrame, windows=(20, 50, 200), **series) -> DataFrame:
    return over_series(df, lambda d, w: add_sma_distance(d, w, windows), max(windows) - 1, **series)


def hl_ratio(df: DataFrame) -> DataFrame:
    return add_hl_ratio(df)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, **series) -> DataFrame:
    """macd and macd_signal; the weight of rows beyond the lookback is below 1e-15."""
    reach = macd_reach(fast, slow, signal)
    shortest = min(fast, slow, signal)
    if shortest > 1 and 2 * reach * EWM_WEIGHT / ewm_reach(shortest) <= EWM_POWER:
        return over_series(df, lambda d, w: add_macd(d, w, fast, slow, signal), reach, **{**series, "block_rows": reach})
    # Spans too far apart for the powers of one block: one pass each.
    d = ewm(ewm(df, "close", fast, out="_fast", **series), "close", slow, out="_slow", **series)
    d = d.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return ewm(d, "macd", signal, out="macd_signal", **series)


def ewm(df: DataFrame, col: str, span: int, out: str | None = None, **series) -> DataFrame:
    """Bias-corrected exponential mean; blocks and history are as long as the span needs."""
    name = out or f"ewm_{span}"
    if span <= 1:
        return df.withColumn(name, F.col(col))

    def step(d, w):
        d = d.withColumn("_at", F.row_number().over(w) - 1)
        value = fr.geometric(F.col(col), F.col("_at"), F.col("_rn"), span, w)
        return d.withColumn(name, value).drop("_at")
    return over_series(df, step, ewm_reach(span), **{**series, "block_rows": ewm_reach(span)})


def momentum(df: DataFrame, col: str = "close", n: int = 14, **series) -> DataFrame:
    return over_series(df, lambda d, w: d.withColumn("momentum", fr.momentum(F.col(col), n, w)), n, **series)


def ffill_zero(df: DataFrame, cols, by=("symbol",), order=("ts",)) -> DataFrame:
    """Carry the last value forward; 0 before the first."""
    filled = running(df, {f"_f_{c}": ("last", F.col(c)) for c in cols}, by, order)
    return filled.withColumns({c: F.coalesce(F.col(f"_f_{c}"), num(0)) for c in cols}).drop(
        *[f"_f_{c}" for c in cols]
    )


def drawdown(df: DataFrame, equity: str = "equity", by=("portfolio_id",), order=("ts",), chunk=None) -> DataFrame:
    """peak, drawdown (absolute) and drawdown_pct (signed, percent) of each row."""
    d = running(df, {"peak": ("max", F.col(equity))}, by, order, chunk)
    d = d.withColumn("drawdown", F.col(equity) - F.col("peak"))
    return d.withColumn("drawdown_pct", div(F.col("drawdown"), F.col("peak")) * 100)


def drawdown_duration(df: DataFrame, equity: str = "equity", by=("portfolio_id",), order=("ts",),
                      chunk=None) -> DataFrame:
    """Per series: max_drawdown (fraction) and rows from the peak to the recovery, or to the end.

    The peak is the first row with the largest equity up to the (first) trough.
    """
    by, order = list(by), list(order)
    d = running(df, {"_peak": ("max", F.col(equity)), "_rn": ("count", F.lit(1))}, by, order, chunk)
    d = d.withColumn("_dd", div(F.col(equity) - F.col("_peak"), F.col("_peak")))
    trough = d.groupBy(*by).agg(
        F.min(F.struct("_dd", "_rn", "_peak")).alias("_t"), F.max("_rn").alias("_last")
    )
    marked = d.join(trough, by)
    high, at = F.col("_t._peak"), F.col("_t._rn")
    return marked.groupBy(*by).agg(
        F.first("_t._dd").alias("max_drawdown"),
        F.min(F.when((F.col(equity) == high) & (F.col("_rn") <= at), F.col("_rn"))).alias("_from"),
        F.min(F.when((F.col(equity) >= high) & (F.col("_rn") >= at), F.col("_rn"))).alias("_to"),
        F.first("_last").alias("_last"),
    ).select(
        *by, "max_drawdown",
        (F.coalesce(F.col("_to"), F.col("_last")) - F.col("_from")).alias("drawdown_rows"),
    )


def cum_growth(df: DataFrame, r: str, out: str = "growth", by=("symbol",), order=("ts",), chunk=None) -> DataFrame:
    """Running product of 1 + r; 0 from the first total loss (r <= -1) on."""
    factor = 1 + F.col(r)
    d = running(df, {
        "_log": ("sum", F.when(factor > 0, F.log1p(F.col(r)))),
        "_lost": ("max", F.when(factor <= 0, F.lit(1))),
        "_seen": ("count", F.col(r)),
    }, by, order, chunk)
    grown = F.when(F.col("_lost").isNotNull(), num(0)).otherwise(F.exp(F.coalesce(F.col("_log"), num(0))))
    return d.withColumn(out, F.when(F.col("_seen") > 0, grown)).drop("_log", "_lost", "_seen")


def cum_sum(df: DataFrame, col: str, out: str, by=("symbol",), order=("ts",), chunk=None) -> DataFrame:
    """Running total with the row number of each row."""
    return running(df, {out: ("sum", F.col(col)), "seq": ("count", F.lit(1))}, by, order, chunk)


def transitions(df: DataFrame, state: str = "regime", by=("symbol",), order=("ts",), **series) -> DataFrame:
    """Rows where the state changes: from_state, to_state, rows of the run before."""
    marked = over_series(
        df, lambda d, w: d.withColumn("_was", F.lag(state).over(w)), 1, by=by, order=order, numbered=True, **series
    )
    starts = marked.where((F.col("_rn") == 1) | (F.col("_was") != F.col(state))).withColumnRenamed("_rn", "_start")
    starts = materialise(starts, "runs")
    runs = over_series(
        starts, lambda d, w: d.withColumn("duration_previous", F.col("_start") - F.lag("_start").over(w)),
        1, by=by, order=order, **series,
    )
    return (
        runs.where(F.col("duration_previous").isNotNull())
        .withColumnRenamed("_was", "from_state")
        .withColumnRenamed(state, "to_state")
        .drop("_start")
    )


def change_count(df: DataFrame, state: str, by=("symbol",), order=("ts",), **series) -> DataFrame:
    """Number of rows whose state differs from the row before (the first row does not count)."""
    marked = over_series(
        df, lambda d, w: d.withColumn("_was", F.lag(state).over(w)), 1, by=by, order=order, **series
    )
    return marked.groupBy(*by).agg(F.count_if(F.col(state) != F.col("_was")).alias("changes"))


def standardise(df: DataFrame, cols, by=("symbol",)) -> DataFrame:
    """z_<col> = (x - mean) / population std (1 where it is 0)."""
    by = list(by)
    stats = df.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols]
    )
    out = df.join(sized(stats), by).withColumns(
        {f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / nonzero(F.col(f"_s_{c}")) for c in cols}
    )
    return out.drop(*[f"_{p}_{c}" for c in cols for p in ("m", "s")])


def outliers(df: DataFrame, col: str, threshold: float = 3.0, by=("symbol",)) -> DataFrame:
    """is_outlier: abs z-score above the threshold; false below 3 rows or without spread."""
    by = list(by)
    stats = df.groupBy(*by).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"), F.count(col).alias("_n"))
    z = div(F.abs(F.col(col) - F.col("_m")), F.col("_s"))
    flag = F.coalesce((F.col("_n") >= 3) & (z > threshold), F.lit(False))
    return df.join(sized(stats), by).withColumn("is_outlier", flag).drop("_m", "_s", "_n")


def percentile_rank(df: DataFrame, col: str, by=("symbol",), out: str = "pct_rank", buckets: int = 200) -> DataFrame:
    """Share of values <= the value, in percent.

    Values are counted once per distinct value, then summed over value ranges of
    about equal weight, so that no task sees all values of a key.
    """
    by = list(by)
    probs = [i / buckets for i in range(1, buckets)]
    edges = df.groupBy(*by).agg(
        F.percentile_approx(col, probs, ACCURACY // 10).alias("_edges"), F.count(col).alias("_n")
    )
    counts = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_c"))
    bucket = F.size(F.filter("_edges", lambda e: e <= F.col(col)))
    ranked = running(
        counts.join(sized(edges), by), {"_upto": ("sum", F.col("_c"))}, by, (col,), chunk=bucket
    ).select(*by, col, (F.col("_upto") / F.col("_n") * 100).alias(out))
    return df.join(ranked, [*by, col], "left")


def signal_returns(df: DataFrame, signal: str = "signal", **series) -> DataFrame:
    """signal x the return to the next bar."""
    def step(d, w):
        ahead = div(F.lead("close").over(w), F.col("close")) - 1
        return d.withColumn("signal_ret", F.when(F.col(signal) != 0, F.col(signal) * ahead))
    return over_series(df, step, 0, 1, **series)
