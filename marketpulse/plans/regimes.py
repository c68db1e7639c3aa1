"""Queries over market regimes of the daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketpulse.functions.numeric import round_columns
from marketpulse.operators import regime as reg
from marketpulse.plans.market import adx_ctes
from marketpulse.plans.sqlkit import DAILY, lag, rnd, strict, with_
from marketpulse.session import materialise
from marketpulse.sources import adapters as src

REGIME_CTES = [DAILY, *adx_ctes("daily"), f"""f1 AS (
  SELECT *, close / {lag('close')} - 1 AS ret, close / {lag('close', 20)} - 1 AS mom,
    {strict('avg', 'close', 20)} AS s20, {strict('avg', 'close', 50)} AS s50 FROM adx_rows)""", f"""f2 AS (
  SELECT *, {strict('stddev_samp', 'ret', 20)} AS volatility,
    coalesce(close > s50, false)::INT + coalesce(s20 > s50, false)::INT + coalesce(mom > 0.05, false)::INT
      + coalesce(adx > 25, false)::INT AS bull,
    coalesce(close < s50, false)::INT + coalesce(s20 < s50, false)::INT + coalesce(mom < -0.05, false)::INT
      + coalesce(adx > 25, false)::INT AS bear FROM f1)""", """regimes AS (
  SELECT symbol, ts, close, volatility, adx AS trend_strength,
    CASE WHEN s50 IS NULL THEN 'SIDEWAYS' WHEN bull >= 3 THEN 'BULL' WHEN bear >= 3 THEN 'BEAR'
      ELSE 'SIDEWAYS' END AS regime,
    CASE WHEN s50 IS NULL THEN 0.5 WHEN bull >= 3 THEN bull / 4.0::DOUBLE WHEN bear >= 3 THEN bear / 4.0::DOUBLE
      ELSE 1 - greatest(bull, bear) / 4.0::DOUBLE END AS confidence FROM f2)"""]


def q_regime_rules(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(reg.regime_rules(src.bars_daily(spark, sf)),
                         {"confidence": 6, "volatility": 6, "trend_strength": 6})


SQL_REGIME_RULES = with_(*REGIME_CTES) + f"""
SELECT symbol, ts, close, regime, {rnd('confidence')}, {rnd('volatility')}, {rnd('trend_strength')} FROM regimes"""


def q_regime_distribution(spark: SparkSession, sf: str) -> DataFrame:
    out = reg.regime_distribution(materialise(reg.regime_rules(src.bars_daily(spark, sf))))
    return round_columns(out, {"share_pct": 6, "avg_confidence": 6})


SQL_REGIME_DISTRIBUTION = with_(*REGIME_CTES, f"""c AS (
  SELECT *, {lag('regime')} AS was FROM regimes)""", """t AS (
  SELECT symbol, count(*) AS n, count(*) FILTER (was <> regime) AS transitions FROM c GROUP BY 1)""", """g AS (
  SELECT symbol, n, transitions, unnest(['BULL', 'BEAR', 'SIDEWAYS']) AS regime FROM t)""", """d AS (
  SELECT symbol, regime, count(*) AS bars, avg(confidence) AS ac FROM regimes GROUP BY 1, 2)""", """e AS (
  SELECT g.symbol, g.regime, coalesce(bars, 0) AS bars, coalesce(bars, 0) / n::DOUBLE * 100 AS share_pct,
    coalesce(ac, 0) AS avg_confidence, transitions FROM g LEFT JOIN d USING (symbol, regime))""") + f"""
SELECT symbol, regime, bars, {rnd('share_pct')}, {rnd('avg_confidence')}, transitions FROM e"""


def q_regime_transitions(spark: SparkSession, sf: str) -> DataFrame:
    out = reg.regime_transitions(reg.regime_rules(src.bars_daily(spark, sf)))
    return round_columns(out.select("symbol", "ts", "from_state", "to_state", "confidence", "duration_previous"),
                         {"confidence": 6})


SQL_REGIME_TRANSITIONS = with_(*REGIME_CTES, """n AS (
  SELECT *, row_number() OVER w AS rn, lag(regime) OVER w AS was FROM regimes
  WINDOW w AS (PARTITION BY symbol ORDER BY ts))""", """s AS (
  SELECT *, rn - lag(rn) OVER (PARTITION BY symbol ORDER BY ts) AS dur FROM n WHERE was IS NULL OR was <> regime)""") + f"""
SELECT symbol, ts, was AS from_state, regime AS to_state, {rnd('confidence')}, dur AS duration_previous
FROM s WHERE dur IS NOT NULL"""


# --- clusters and hidden states of each symbol ---------------------------------

FEATURES_SQL = REGIME_CTES[:-1] + ["""feats AS (
  SELECT symbol, ts, ret, volatility AS v, mom, (close - s50) / s50 AS d50, adx AS trend FROM f2)"""]


def _kmeans_ctes(rounds: int = 10) -> list[str]:
    """Lloyd steps, each a CTE with the centres of all symbols."""
    names = ("ret", "v", "mom", "d50", "trend")
    z = [f"z{i}" for i in range(5)]
    ctes = ["""kn AS (
  SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM feats
  WHERE ret IS NOT NULL AND v IS NOT NULL AND mom IS NOT NULL AND d50 IS NOT NULL AND trend IS NOT NULL)""", "km AS MATERIALIZED (SELECT symbol, ts, ret, " + ", ".join(
        f"({c} - avg({c}) OVER s) / coalesce(nullif(stddev_pop({c}) OVER s, 0), 1) AS z{i}" for i, c in enumerate(names)
    ) + " FROM kn WHERE n >= 10 WINDOW s AS (PARTITION BY symbol))"]
    thirds = ("z0 < -0.4307", "abs(z0) <= 0.4307", "z0 > 0.4307")
    ctes.append("c0 AS MATERIALIZED (SELECT symbol, " + ", ".join(
        f"coalesce(avg({c}) FILTER ({k}), {float(j - 1 if i == 0 else 0)}) AS m{j}{i}" for j, k in enumerate(thirds) for i, c in enumerate(z)
    ) + " FROM km GROUP BY 1)")
    gaps = ", ".join(" + ".join(f"({c} - m{j}{i}) * ({c} - m{j}{i})" for i, c in enumerate(z)) + f" AS g{j}" for j in range(3))
    pick = "CASE WHEN g0 <= g1 AND g0 <= g2 THEN 0 WHEN g1 <= g2 THEN 1 ELSE 2 END AS k"
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT *, {pick} FROM (SELECT *, {gaps} FROM km JOIN c{r} USING (symbol)))")
        if r < rounds:
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT symbol, " + ", ".join(
                f"coalesce(avg({c}) FILTER (k = {j}), max(m{j}{i})) AS m{j}{i}" for j in range(3) for i, c in enumerate(z)
            ) + f" FROM a{r} GROUP BY 1)")
    return ctes + _named("kmeans", f"(SELECT symbol, ts, ret, k, 1 / (1 + sqrt(least(g0, g1, g2))) AS confidence FROM a{rounds})")


def _named(name: str, rows: str) -> list[str]:
    """Groups k of (symbol, ts, ret, k, confidence) named by their mean return."""
    return [f"{name}_means AS (SELECT symbol, k, avg(ret) AS mean FROM {rows} GROUP BY 1, 2)", f"""{name}_ends AS (
  SELECT symbol, first(k ORDER BY mean DESC, k) AS best, first(k ORDER BY mean, k) AS worst FROM {name}_means GROUP BY 1)""", f"""{name} AS MATERIALIZED (
  SELECT symbol, ts, k, confidence, CASE k WHEN worst THEN 'BEAR' WHEN best THEN 'BULL' ELSE 'SIDEWAYS' END AS regime
  FROM {rows} JOIN {name}_ends USING (symbol))"""]


def _hidden_ctes(name: str, linked: bool, rounds: int = 10) -> list[str]:
    """A sequential check of the hidden states: forward, backward and best path row by row."""
    three, p = range(1, 4), name
    ctes = [f"""{p}_n AS (
  SELECT symbol, ts, ret, v, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS t, count(*) OVER (PARTITION BY symbol) AS n
  FROM feats WHERE ret IS NOT NULL AND v IS NOT NULL)""", f"""{p}_z AS MATERIALIZED (
  SELECT symbol, ts, t, n, ret, (ret - avg(ret) OVER s) / coalesce(nullif(stddev_pop(ret) OVER s, 0), 1) AS x,
    (v - avg(v) OVER s) / coalesce(nullif(stddev_pop(v) OVER s, 0), 1) AS y FROM {p}_n WHERE n >= 20 WINDOW s AS (PARTITION BY symbol))"""]
    thirds = ("x < -0.4307", "abs(x) <= 0.4307", "x > 0.4307")
    move = lambda i, j: (0.8 if i == j else 0.1) if linked else 1 / 3
    ctes.append(f"{p}_p0 AS MATERIALIZED (SELECT symbol, [{', '.join(['1 / 3.0::DOUBLE'] * 3)}] AS st, "
                f"[{', '.join(f'{move(i, j)!r}::DOUBLE' for i in three for j in three)}] AS mv, "
                + ", ".join(f"[{', '.join(f'coalesce(avg({c}) FILTER ({k}), {v})' for k, v in zip(thirds, (-d, 0.0, d)))}] AS m{c}"
                            for c, d in (("x", 1.0), ("y", 0.0)))
                + f", [1.0::DOUBLE, 1, 1] AS sxx, [0.0::DOUBLE, 0, 0] AS sxy, [1.0::DOUBLE, 1, 1] AS syy FROM {p}_z GROUP BY 1)")
    at = lambda i, j: f"mv[{3 * (i - 1) + j}]"
    plus = lambda parts: "(" + " + ".join(parts) + ")"
    unit = lambda u: f"[{', '.join(f'{u}{i} / ({u}1 + {u}2 + {u}3)' for i in three)}]"
    for r in range(rounds + 1):
        dens = ", ".join(f"-0.5 * ((syy[{i}] * (x - mx[{i}]) * (x - mx[{i}]) - 2 * sxy[{i}] * (x - mx[{i}]) * (y - my[{i}]) + sxx[{i}] * (y - my[{i}]) * (y - my[{i}]))"
                         f" / (sxx[{i}] * syy[{i}] - sxy[{i}] * sxy[{i}]) + ln(sxx[{i}] * syy[{i}] - sxy[{i}] * sxy[{i}]))" for i in three)
        ctes += [f"{p}_o{r} AS MATERIALIZED (SELECT symbol, t, n, x, y, ld, list_transform(ld, lambda e: exp(e - list_max(ld))) AS b FROM ("
                 f"SELECT *, [{dens}] AS ld FROM {p}_z JOIN {p}_p{r} USING (symbol)))",
                 f"{p}_l{r} AS MATERIALIZED (SELECT symbol, any_value(n) AS n, list(b ORDER BY t) AS bs, list(ld ORDER BY t) AS lds, "
                 f"any_value(st) AS st, any_value(mv) AS mv FROM {p}_o{r} JOIN {p}_p{r} USING (symbol) GROUP BY 1)",
                 f"{p}_f{r} AS (SELECT symbol, 1::BIGINT AS t, {unit('u')} AS al FROM (SELECT symbol, "
                 + ", ".join(f"st[{j}] * bs[1][{j}] AS u{j}" for j in three) + f" FROM {p}_l{r}) UNION ALL SELECT symbol, t + 1, {unit('u')} FROM (SELECT symbol, f.t, "
                 + ", ".join(plus(f"al[{i}] * {at(i, j)}" for i in three) + f" * bs[f.t + 1][{j}] AS u{j}" for j in three)
                 + f" FROM {p}_f{r} f JOIN {p}_l{r} USING (symbol) WHERE f.t < n))",
                 f"{p}_b{r} AS (SELECT symbol, n AS t, [1.0::DOUBLE, 1, 1] AS be FROM {p}_l{r} UNION ALL SELECT symbol, t - 1, {unit('u')} FROM (SELECT symbol, f.t, "
                 + ", ".join(plus(f"{at(i, j)} * bs[f.t][{j}] * be[{j}]" for j in three) + f" AS u{i}" for i in three)
                 + f" FROM {p}_b{r} f JOIN {p}_l{r} USING (symbol) WHERE f.t > 1))",
                 f"{p}_g{r} AS MATERIALIZED (SELECT symbol, t, {unit('u')} AS g, al, be FROM (SELECT symbol, t, al, be, "
                 + ", ".join(f"al[{i}] * be[{i}] AS u{i}" for i in three) + f" FROM {p}_f{r} JOIN {p}_b{r} USING (symbol, t)))"]
        if r == rounds:
            break
        total = plus(f"w{i}{j}" for i in three for j in three)
        pair = ", ".join(f"w{i}{j} / {total} AS q{i}{j}" for i in three for j in three)
        weights = ", ".join(f"a.al[{i}] * {at(i, j)} * o.b[{j}] * g.be[{j}] AS w{i}{j}" for i in three for j in three)
        ctes.append(f"{p}_q{r} AS (SELECT symbol, {', '.join(f'sum(q{i}{j}) AS q{i}{j}' for i in three for j in three)} FROM (SELECT symbol, {pair} FROM ("
                    f"SELECT symbol, {weights} FROM {p}_g{r} g JOIN {p}_g{r} a USING (symbol) JOIN {p}_o{r} o USING (symbol) JOIN {p}_p{r} USING (symbol) "
                    f"WHERE a.t = g.t - 1 AND o.t = g.t)) GROUP BY 1)")
        sums = ", ".join(f"sum(g[{i}]) AS n{i}, sum(g[{i}] * x) / sum(g[{i}]) AS x{i}, sum(g[{i}] * y) / sum(g[{i}]) AS y{i}, sum(g[{i}] * x * x) / sum(g[{i}]) AS xx{i}, "
                         f"sum(g[{i}] * x * y) / sum(g[{i}]) AS xy{i}, sum(g[{i}] * y * y) / sum(g[{i}]) AS yy{i}" for i in three)
        if linked:
            moves = ", ".join(f"q{i}{j} / (q{i}1 + q{i}2 + q{i}3)" for i in three for j in three)
            start = "f0"
        else:
            moves = ", ".join(f"n{j} / (n1 + n2 + n3)" for _ in three for j in three)
            start = f"[{', '.join(f'n{j} / (n1 + n2 + n3)' for j in three)}]"
        ctes.append(f"{p}_p{r + 1} AS MATERIALIZED (SELECT symbol, {start} AS st, [{moves}] AS mv, "
                    + ", ".join(f"[{', '.join(f'{c}{i}' for i in three)}] AS m{c}" for c in "xy")
                    + f", [{', '.join(f'xx{i} - x{i} * x{i} + 0.001' for i in three)}] AS sxx, [{', '.join(f'xy{i} - x{i} * y{i}' for i in three)}] AS sxy"
                    f", [{', '.join(f'yy{i} - y{i} * y{i} + 0.001' for i in three)}] AS syy FROM (SELECT symbol, {sums}, any_value(g) FILTER (t = 1) AS f0 "
                    f"FROM {p}_g{r} JOIN {p}_z USING (symbol, t) GROUP BY 1) JOIN {p}_q{r} USING (symbol))")
    last = rounds
    ctes += [f"{p}_v AS (SELECT symbol, 1::BIGINT AS t, [{', '.join(f'ln(st[{j}]) + lds[1][{j}]' for j in three)}] AS sc, [0, 0, 0] AS came FROM {p}_l{last} UNION ALL "
             f"SELECT symbol, f.t + 1, [{', '.join(f'list_max([{chr(44).join(f'sc[{i}] + ln({at(i, j)})' for i in three)}]) + lds[f.t + 1][{j}]' for j in three)}], "
             f"[{', '.join(f'list_position([{chr(44).join(f'sc[{i}] + ln({at(i, j)})' for i in three)}], list_max([{chr(44).join(f'sc[{i}] + ln({at(i, j)})' for i in three)}]))' for j in three)}] "
             f"FROM {p}_v f JOIN {p}_l{last} USING (symbol) WHERE f.t < n)",
             f"{p}_w AS MATERIALIZED (SELECT symbol, list(came ORDER BY t) AS cames, list(sc ORDER BY t) AS scs, count(*) AS n FROM {p}_v GROUP BY 1)",
             f"{p}_path AS (SELECT symbol, n AS t, list_position(scs[n], list_max(scs[n])) AS s FROM {p}_w UNION ALL "
             f"SELECT symbol, f.t - 1, cames[f.t][f.s] FROM {p}_path f JOIN {p}_w USING (symbol) WHERE f.t > 1)",
             f"{p}_rows AS MATERIALIZED (SELECT symbol, ts, ret, s - 1 AS k, g[s] AS confidence FROM {p}_path JOIN {p}_g{last} USING (symbol, t) JOIN {p}_z USING (symbol, t))"]
    return ctes + _named(name, f"{p}_rows")


def _recursive(*ctes: str) -> str:
    return with_(*ctes).replace("WITH ", "WITH RECURSIVE ", 1)


def q_regime_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(reg.regime_kmeans(src.bars_daily(spark, sf)), {"confidence": 6})


SQL_REGIME_KMEANS = with_(*FEATURES_SQL, *_kmeans_ctes()) + f"SELECT symbol, ts, regime, {rnd('confidence')}, k::INT AS cluster_id FROM kmeans"


def q_regime_hidden(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(reg.regime_hidden(src.bars_daily(spark, sf)), {"confidence": 6})


SQL_REGIME_HIDDEN = _recursive(*FEATURES_SQL, *_hidden_ctes("hmm", True)) + f"""
SELECT symbol, ts, regime, {rnd('confidence')}, k::INT AS state_id FROM hmm"""


def q_regime_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(reg.regime_mixture(src.bars_daily(spark, sf)), {"confidence": 6})


SQL_REGIME_MIXTURE = _recursive(*FEATURES_SQL, *_hidden_ctes("mix", False)) + f"""
SELECT symbol, ts, regime, {rnd('confidence')}, k::INT AS state_id FROM mix"""


def q_regime_vote(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(reg.regime(src.bars_daily(spark, sf), "ensemble"),
                         {"confidence": 6, "volatility": 6, "trend_strength": 6})


SQL_REGIME_VOTE = _recursive(*REGIME_CTES, FEATURES_SQL[-1], *_kmeans_ctes(), *_hidden_ctes("hmm", True), """j AS (
  SELECT r.symbol, r.ts, r.volatility, r.trend_strength, [r.regime, k.regime, h.regime] AS names,
    [r.confidence, k.confidence, h.confidence] AS sure
  FROM regimes r LEFT JOIN kmeans k USING (symbol, ts) LEFT JOIN hmm h USING (symbol, ts))""", """b AS (
  SELECT *, """ + ", ".join(f"{' + '.join(f"CASE names[{i}] WHEN '{n}' THEN sure[{i}] ELSE 0 END" for i in (1, 2, 3))} AS {n.lower()}"
                          for n in ("BULL", "BEAR", "SIDEWAYS")) + """, coalesce(sure[1], 0) + coalesce(sure[2], 0) + coalesce(sure[3], 0) AS total,
    len(list_filter(sure, lambda s: s IS NOT NULL)) AS votes FROM j)""", """w AS (
  SELECT *, CASE WHEN bull >= bear AND bull >= sideways THEN 'BULL' WHEN bear >= sideways THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime,
    total / votes AS confidence FROM b)""") + f"""
SELECT symbol, ts, regime, {rnd('confidence')}, {rnd('volatility')}, {rnd('trend_strength')} FROM w"""


def q_regime_performance(spark: SparkSession, sf: str) -> DataFrame:
    bars = src.bars_daily(spark, sf)
    out = reg.regime_backtest(bars, reg.ma_cross_signal(bars))
    return round_columns(out, {c: 6 for c in ["time_in_regime", "total_return", "avg_return_per_trade",
                                              "sharpe_ratio", "max_drawdown", "win_rate"]})


SQL_REGIME_PERFORMANCE = with_(*REGIME_CTES, f"""sg AS (
  SELECT symbol, ts, coalesce(sign(({strict('avg', 'close', 5)}) - ({strict('avg', 'close', 20)})), 0)::INT AS signal
  FROM daily)""", """act AS (
  SELECT r.symbol, r.ts, r.close, r.regime, signal,
    lag(signal) OVER (PARTITION BY r.symbol ORDER BY r.ts) AS was
  FROM regimes r JOIN sg ON r.symbol = sg.symbol AND r.ts = sg.ts WHERE signal <> 0)""", """turns AS (
  SELECT *, lead(ts) OVER w AS xt, lead(close) OVER w AS xc, lead(regime) OVER w AS xr
  FROM act WHERE was IS NULL OR was <> signal WINDOW w AS (PARTITION BY symbol ORDER BY ts))""", """ends AS (
  SELECT symbol, max(ts) AS et, last(close ORDER BY ts) AS ec, last(regime ORDER BY ts) AS er
  FROM regimes GROUP BY 1)""", """tr AS (
  SELECT symbol, coalesce(xt, et) AS exit_time, coalesce(xr, er) AS regime,
    10000.0::DOUBLE / close * (coalesce(xc, ec) - close) AS pnl, (coalesce(xc, ec) - close) / close AS r
  FROM turns JOIN ends USING (symbol) WHERE signal = 1)""", """cum AS (
  SELECT *, product(1 + r) OVER (PARTITION BY symbol, regime ORDER BY exit_time
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS growth FROM tr)""", """dd AS (
  SELECT *, max(growth) OVER (PARTITION BY symbol, regime ORDER BY exit_time
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM cum)""", """perf AS (
  SELECT symbol, regime, count(*) AS n, count(*) FILTER (pnl > 0) AS w, count(*) FILTER (pnl < 0) AS l,
    last(growth ORDER BY exit_time) - 1 AS tot, avg(r) AS mean,
    CASE WHEN count(*) > 1 THEN avg(r) / nullif(stddev_pop(r), 0) * sqrt(252) END AS sh,
    abs(min((growth - peak) / peak)) AS mdd FROM dd GROUP BY 1, 2)""", """tm AS (
  SELECT symbol, count(*) AS nn FROM regimes GROUP BY 1)""", """rt AS (
  SELECT symbol, regime, count(*) AS c FROM regimes GROUP BY 1, 2)""", """g AS (
  SELECT symbol, nn, unnest(['BULL', 'BEAR', 'SIDEWAYS']) AS regime FROM tm)""", """bw AS (
  SELECT symbol, first(regime ORDER BY round(tot, 9) DESC, place) AS best_regime,
    first(regime ORDER BY round(tot, 9), place) AS worst_regime
  FROM (SELECT *, list_position(['BULL', 'BEAR', 'SIDEWAYS'], regime) AS place FROM perf) GROUP BY 1)""",
    """o AS (SELECT g.symbol, g.regime, coalesce(c, 0) / nn::DOUBLE * 100 AS time_in_regime,
    coalesce(n, 0) AS total_trades, coalesce(w, 0) AS winning_trades, coalesce(l, 0) AS losing_trades,
    coalesce(tot, 0) AS total_return, coalesce(mean, 0) AS avg_return_per_trade, coalesce(sh, 0) AS sharpe_ratio,
    coalesce(mdd, 0) AS max_drawdown, coalesce(w / nullif(n, 0)::DOUBLE, 0) AS win_rate, best_regime, worst_regime
  FROM g LEFT JOIN rt USING (symbol, regime) LEFT JOIN perf USING (symbol, regime) LEFT JOIN bw USING (symbol))""") + """
SELECT symbol, regime, total_trades, winning_trades, losing_trades, best_regime, worst_regime, """ + ", ".join(
    rnd(c) for c in ["time_in_regime", "total_return", "avg_return_per_trade", "sharpe_ratio", "max_drawdown",
                     "win_rate"]) + " FROM o"

QUERIES = {
    "regime_rules": (q_regime_rules, SQL_REGIME_RULES),
    "regime_distribution": (q_regime_distribution, SQL_REGIME_DISTRIBUTION),
    "regime_transitions": (q_regime_transitions, SQL_REGIME_TRANSITIONS),
    "regime_kmeans": (q_regime_kmeans, SQL_REGIME_KMEANS),
    "regime_hidden": (q_regime_hidden, SQL_REGIME_HIDDEN),
    "regime_mixture": (q_regime_mixture, SQL_REGIME_MIXTURE),
    "regime_vote": (q_regime_vote, SQL_REGIME_VOTE),
    "regime_performance": (q_regime_performance, SQL_REGIME_PERFORMANCE),
}
