"""Queries over biases, crowds and markets against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.functions.numeric import round_columns
from marketpulse.operators import bias as bi
from marketpulse.operators import cross as cr
from marketpulse.operators import crowd as cw
from marketpulse.operators.joins import beside
from marketpulse.plans.sqlkit import HOURLY, PRICE_SENT, SENT_HOURLY, SENTIMENT, lag, rnd, strict, with_
from marketpulse.session import materialise
from marketpulse.sources import adapters as src

FLOORS = {"HERDING": 0.1, "FOMO": 0.1, "FUD": 0.1}
SPREAD = 0.8


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(src.price_sentiment(spark, sf), "prices")


def q_bias_signals(spark: SparkSession, sf: str) -> DataFrame:
    out = bi.bias_signals(_mixed(spark, sf), FLOORS)
    out = out.select("symbol", "ts", "bias_type", "strength", F.size("indicators").cast("bigint").alias("n_indicators"))
    return round_columns(out, {"strength": 6})


BIAS_CTES = [HOURLY, SENTIMENT, SENT_HOURLY, PRICE_SENT, f"""b1 AS (
  SELECT *, close / nullif({lag('close')}, 0) - 1 AS ret, sentiment - {lag('sentiment')} AS ds,
    row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS seq, {strict('avg', 'volume', 10)} AS av,
    {strict('stddev_samp', 'sentiment', 10)} AS ss, {strict('avg', 'sentiment', 10)} AS s10,
    sum(volume) OVER (PARTITION BY symbol) AS tv, count(*) OVER (PARTITION BY symbol) AS n FROM price_sent)""", f"""b2 AS (
  SELECT *, {strict('sum', 'ret', 5)} AS r5, {strict('sum', 'ret', 10)} AS r10, {strict('stddev_samp', 'ret', 10)} AS vol,
    ret - {lag('ret')} AS acc, CASE WHEN tv > 0 THEN volume / CASE WHEN av = 0 THEN 1 ELSE av END ELSE 1 END AS vr
  FROM b1 WHERE n >= 10)""", "md AS (SELECT symbol, quantile_cont(vol, 0.5) AS med FROM b2 GROUP BY 1)", f"""bs AS (
  SELECT symbol, ts, 'HERDING' AS bias_type, least(abs(r5) * vr / (ss + 0.1), 1) AS strength, 3 AS ni FROM b2
    WHERE seq >= 10 AND abs(r5) > 0.05 AND vr > 1.5 AND ss < 0.2
  UNION ALL SELECT symbol, ts, 'FOMO', least(r5 * sentiment * ds * 2, 1), 4 FROM b2
    WHERE seq >= 5 AND r5 > 0.1 AND sentiment > 0.5 AND ds > 0.3 AND acc > 0
  UNION ALL SELECT symbol, ts, 'FUD', least(abs(sentiment) * abs(ds) * vol * 10, 1), 4 FROM b2 JOIN md USING (symbol)
    WHERE seq >= 10 AND sentiment < -0.5 AND ds < -0.3 AND vol > med * 1.5 AND ret < 0
  UNION ALL SELECT symbol, ts, 'CONFIRMATION_BIAS', least(abs(r10) * abs(s10) * 5, 1), 3 FROM b2
    WHERE seq >= 10 AND ((r10 < -0.05 AND s10 > 0.3) OR (r10 > 0.05 AND s10 < -0.3)))""", """bias AS (
  SELECT * FROM bs WHERE bias_type = 'CONFIRMATION_BIAS' OR strength > 0.1)"""]
SQL_BIAS_SIGNALS = with_(*BIAS_CTES) + f"SELECT symbol, ts, bias_type, {rnd('strength')}, ni::BIGINT AS n_indicators FROM bias"


def q_bias_report(spark: SparkSession, sf: str) -> DataFrame:
    out = bi.bias_report(_mixed(spark, sf), FLOORS)
    return round_columns(out, {**{k.lower(): 6 for k in bi.BIASES}, "overall_bias": 6})


SQL_BIAS_REPORT = with_(*BIAS_CTES, "sy AS (SELECT DISTINCT symbol FROM price_sent)", "rp AS (SELECT symbol, count(strength) AS signals, " + ", ".join(
    f"coalesce(avg(strength) FILTER (bias_type = '{k}'), 0) AS {k.lower()}" for k in bi.BIASES) + """
  FROM sy LEFT JOIN bias USING (symbol) GROUP BY 1)""") + "SELECT symbol, signals, " + ", ".join(
    rnd(k.lower()) for k in bi.BIASES) + ", " + rnd(
    "((" + " + ".join(k.lower() for k in bi.BIASES) + ") / 4)", 6, "overall_bias") + " FROM rp"


def q_influencers(spark: SparkSession, sf: str) -> DataFrame:
    out = cw.top_influencers(src.social(spark, sf))
    return round_columns(out, {"engagement_rate": 6, "average_sentiment": 6, "post_frequency": 6, "influence_score": 6})


INFLUENCER_CTES = [SENTIMENT, """up AS (
  SELECT user_id, count(*) AS posts, avg(score) AS s, avg(k) AS e, first(followers ORDER BY ts) AS f, min(ts) AS a, max(ts) AS b
  FROM sentiment GROUP BY 1)""", """inf1 AS (
  SELECT *, e / greatest(f, 1) AS er, posts / greatest(floor(date_diff('microsecond', a, b) / 8.64e10), 1) AS pf
  FROM up WHERE f >= 1000)""", """inf AS (
  SELECT *, least(log10(f + 1) / 7 * 0.5 + er * 0.3 + least(pf / 10, 1) * 0.2, 1) AS sc FROM inf1)"""]
SQL_INFLUENCERS = with_(*INFLUENCER_CTES) + f"""
SELECT user_id, 'user_' || user_id AS username, f AS follower_count, {rnd('er', 6, 'engagement_rate')},
  {rnd('s', 6, 'average_sentiment')}, {rnd('pf', 6, 'post_frequency')}, {rnd('sc', 6, 'influence_score')} FROM inf"""


def q_user_profiles(spark: SparkSession, sf: str) -> DataFrame:
    out = cw.user_profiles(src.social(spark, sf))
    return round_columns(out, {"avg_sentiment": 6, "sentiment_std": 6, "avg_engagement": 6})


SQL_USER_PROFILES = with_(SENTIMENT, """u AS (
  SELECT user_id, count(*) AS posts, avg(score) AS s, stddev_samp(score) AS d, avg(k) AS e, first(followers ORDER BY ts) AS f,
    min(ts) AS first_ts, max(ts) AS last_ts FROM sentiment GROUP BY 1)""") + f"""
SELECT user_id, posts, {rnd('s', 6, 'avg_sentiment')}, {rnd('d', 6, 'sentiment_std')}, {rnd('e', 6, 'avg_engagement')},
  f AS follower_count, first_ts, last_ts FROM u"""


def _spread(spark: SparkSession, sf: str) -> DataFrame:
    """Posts whose score leans to one side per user, so that there are camps."""
    lean = (F.col("user_id") % 7 - 3) / F.lit(4.0)
    score = F.col("sentiment_score") * (1 - SPREAD) + lean * SPREAD
    tags = F.array(F.concat(F.lit("#"), F.col("asset")), F.concat(F.lit("#t"), (F.col("event_id") % 11).cast("string")))
    return src.social(spark, sf).withColumns({"sentiment_score": score, "hashtags": tags})


def q_echo_chambers(spark: SparkSession, sf: str) -> DataFrame:
    out = cw.echo_chambers(_spread(spark, sf), eps=0.05, min_pts=4)
    out = out.select("members", "mean_sentiment", "sentiment_homogeneity", "average_engagement", "dominant_sentiment",
                     F.array_join("common_hashtags", ",").alias("common_hashtags"))
    return round_columns(out, {"mean_sentiment": 6, "sentiment_homogeneity": 6, "average_engagement": 6})


# The check counts neighbours pair by pair.
CHAMBER_CTES = [SENTIMENT, f"""soc AS (
  SELECT *, score * (1 - {SPREAD}) + (user_id % 7 - 3) / 4.0::DOUBLE * {SPREAD} AS sc FROM sentiment)""", """us AS (
  SELECT user_id, avg(sc) AS x, avg(k) AS e FROM soc GROUP BY 1)""", """nb AS (
  SELECT a.user_id, a.x, count(*) AS n FROM us a JOIN us b ON abs(a.x - b.x) <= 0.05 GROUP BY 1, 2)""", """core AS (
  SELECT x, CASE WHEN x - lag(x) OVER (ORDER BY x) <= 0.05 THEN 0 ELSE 1 END AS new FROM nb WHERE n >= 4)""", """isl AS (
  SELECT x, sum(new) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS c FROM core)""",
    "rng AS (SELECT c, min(x) AS lo, max(x) AS hi FROM isl GROUP BY 1)", """mem AS (
  SELECT us.user_id, us.x, us.e, c, row_number() OVER (PARTITION BY us.user_id ORDER BY greatest(lo - us.x, us.x - hi, 0), c) AS r
  FROM us JOIN rng ON us.x >= lo - 0.05 AND us.x <= hi + 0.05)""", """grp AS (
  SELECT c, count(*) AS members, avg(x) AS m, 1 / (1 + stddev_samp(x)) AS h, avg(e) AS e FROM mem WHERE r = 1
  GROUP BY 1 HAVING count(*) >= 4)""", """tg AS (
  SELECT c, tag, count(*) AS n FROM (SELECT c, unnest(['#' || asset, '#t' || (event_id % 11)]) AS tag
    FROM soc JOIN mem USING (user_id) WHERE r = 1) GROUP BY 1, 2)""", """tr AS (
  SELECT c, tag, row_number() OVER (PARTITION BY c ORDER BY n DESC, tag) AS rk FROM tg)""",
    "tj AS (SELECT c, string_agg(tag, ',' ORDER BY rk) AS tags FROM tr WHERE rk <= 5 GROUP BY 1)"]
SQL_ECHO_CHAMBERS = with_(*CHAMBER_CTES) + f"""
SELECT members, {rnd('m', 6, 'mean_sentiment')}, {rnd('h', 6, 'sentiment_homogeneity')}, {rnd('e', 6, 'average_engagement')},
  CASE WHEN m > 0.2 THEN 'positive' WHEN m < -0.2 THEN 'negative' ELSE 'neutral' END AS dominant_sentiment,
  tags AS common_hashtags FROM grp LEFT JOIN tj USING (c)"""


def q_cascades(spark: SparkSession, sf: str) -> DataFrame:
    out = cw.cascades(src.social(spark, sf), least_move=0.1)
    out = out.select("asset", "start_time", "end_time", "initial_sentiment", "peak_sentiment", "affected_users", "spread_rate")
    return round_columns(out, {"initial_sentiment": 6, "peak_sentiment": 6, "spread_rate": 6})


# The check walks from start to start.
CASCADE_CTES = [SENTIMENT, """c1 AS (
  SELECT asset, ts, event_id, user_id, row_number() OVER w AS rn,
    avg(score) OVER (PARTITION BY asset ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m
  FROM sentiment WINDOW w AS (PARTITION BY asset ORDER BY ts, event_id))""", """c2 AS (
  SELECT *, m - lag(m) OVER (PARTITION BY asset ORDER BY rn) AS d FROM c1)""", """lim AS (
  SELECT asset, stddev_samp(d) * 2 AS l FROM c2 GROUP BY 1)""", """cand AS (
  SELECT c2.* FROM c2 JOIN lim USING (asset) WHERE abs(d) > l)""", """chain AS (
  SELECT asset, min(ts) AS ts FROM cand GROUP BY 1
  UNION ALL
  SELECT c.asset, n.ts FROM chain c, LATERAL (SELECT min(d.ts) AS ts FROM cand d
    WHERE d.asset = c.asset AND d.ts > c.ts + INTERVAL 6 HOUR) n WHERE n.ts IS NOT NULL)""", """st AS (
  SELECT ch.asset, ch.ts AS start_time, min(rn) AS first_rn, first(m ORDER BY rn) AS ini
  FROM chain ch JOIN cand cd ON cd.asset = ch.asset AND cd.ts = ch.ts GROUP BY 1, 2)""", """cs AS (
  SELECT st.asset, start_time, ini, max(c2.ts) AS end_time, first(m ORDER BY abs(m) DESC, rn) AS peak,
    count(DISTINCT user_id) AS users
  FROM st JOIN c2 ON c2.asset = st.asset AND rn >= first_rn AND c2.ts <= start_time + INTERVAL 6 HOUR GROUP BY 1, 2, 3)""",
    """casc AS (SELECT *, users / greatest(date_diff('microsecond', start_time, end_time) / 3.6e9, 0.1) AS rate FROM cs)"""]
SQL_CASCADES = "WITH RECURSIVE " + ",\n".join(CASCADE_CTES) + f"""
SELECT asset, start_time, end_time, {rnd('ini', 6, 'initial_sentiment')}, {rnd('peak', 6, 'peak_sentiment')},
  users AS affected_users, {rnd('rate', 6, 'spread_rate')} FROM casc WHERE abs(peak - ini) > 0.1 AND users > 5"""


def q_crowd_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = cw.crowd_metrics(src.social(spark, sf))
    return round_columns(out, {c: 6 for c in out.columns})


SQL_CROWD_METRICS = "WITH RECURSIVE " + ",\n".join([*INFLUENCER_CTES, *CASCADE_CTES[1:], """us AS (
  SELECT user_id, avg(score) AS x FROM sentiment GROUP BY 1)""", """nb AS (
  SELECT a.user_id, a.x, count(*) AS n FROM us a JOIN us b ON abs(a.x - b.x) <= 0.2 GROUP BY 1, 2)""", """mem AS (
  SELECT count(DISTINCT us.user_id) AS n FROM us JOIN nb ON nb.n >= 5 AND abs(us.x - nb.x) <= 0.2)""", """b AS (
  SELECT count(*) AS posts, count(DISTINCT user_id) AS users, 1 / (1 + stddev_samp(score)) AS herd,
    count(*) FILTER (abs(score) > 0.2) / count(*)::DOUBLE * (1 - count(*) FILTER (abs(score) <= 0.2) / count(*)::DOUBLE) AS pol
  FROM sentiment)""", """l AS (SELECT count(*) AS n FROM sentiment WHERE user_id IN (SELECT user_id FROM inf))""", """v AS (
  SELECT stddev_samp(d) AS sv FROM (SELECT score - lag(score) OVER (ORDER BY ts, event_id) AS d FROM sentiment))""", """r AS (
  SELECT coalesce(avg(rate), 0) AS rt FROM casc WHERE abs(peak - ini) > 0.3 AND users > 5)"""]) + f"""
SELECT {rnd('herd', 6, 'herd_mentality_score')}, {rnd('(mem.n / users::DOUBLE)', 6, 'echo_chamber_index')},
  {rnd('(l.n / posts::DOUBLE)', 6, 'influencer_impact')}, {rnd('sv', 6, 'sentiment_volatility')},
  {rnd('least(rt / 100, 1)', 6, 'contagion_rate')}, {rnd('pol', 6, 'network_polarization')} FROM b, mem, l, v, r"""


# --- markets -----------------------------------------------------------------

def _returns(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(cr.returns(src.bars_hourly(spark, sf)), "returns")


RET_CTES = [HOURLY, f"""rets AS (
  SELECT * FROM (SELECT symbol, ts, close / nullif({lag('close')}, 0) - 1 AS ret FROM hourly) WHERE ret IS NOT NULL)""", """prs AS (
  SELECT a.symbol AS m1, b.symbol AS m2, a.ts, a.ret AS x, b.ret AS y FROM rets a JOIN rets b ON a.ts = b.ts AND a.symbol < b.symbol)""",
    """prn AS (SELECT *, row_number() OVER (PARTITION BY m1, m2 ORDER BY ts) AS rn FROM prs)"""]
_R = "covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def q_corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return round_columns(cr.corr_matrix(_returns(spark, sf)), {"correlation": 6})


SQL_CORR_MATRIX = with_(*RET_CTES, f"""m AS (
  SELECT a.symbol AS market1, b.symbol AS market2, CASE WHEN a.symbol = b.symbol THEN 1 ELSE {_R.format(x='a.ret', y='b.ret')} END AS r,
    count(*) AS n FROM rets a JOIN rets b ON a.ts = b.ts GROUP BY a.symbol, b.symbol)""") + f"""
SELECT market1, market2, {rnd('r', 6, 'correlation')}, n FROM m"""


def q_best_lag(spark: SparkSession, sf: str) -> DataFrame:
    out = cr.best_lag(_returns(spark, sf)).withColumn("lag", F.col("lag").cast("bigint"))
    return round_columns(out, {"correlation": 6, "t": 5, "p_value": 8})


LAG_CTES = [*RET_CTES, f"""lg AS (
  SELECT a.m1, a.m2, a.rn - b.rn AS lag, {_R.format(x='a.x', y='b.y')} AS r, count(*) AS n
  FROM prn a JOIN prn b ON a.m1 = b.m1 AND a.m2 = b.m2 AND abs(a.rn - b.rn) <= 24 GROUP BY 1, 2, 3)"""]


def tail_ctes(rows: str, out: str) -> list[str]:
    """CTEs: ``rows`` (with t and n) plus the two-sided p of t, by the finite series in the angle atan(t / sqrt(df)).

    Even df: A = sin * sum of c(j) cos^2j, c(j) = product of (2i - 1) / 2i; odd df: A = 2 / pi * (angle + sin cos * sum of
    d(j) cos^2j), d(j) = product of 2i / (2i + 1); p = 1 - A.
    """
    return [f"""{out}_a AS (SELECT *, n - 2 AS df, atan(abs(t) / sqrt(n - 2)) AS angle FROM {rows} WHERE n > 2)""", f"""{out}_j AS (
  SELECT j, sum(CASE WHEN j = 0 THEN 0 ELSE ln((2 * j - 1) / (2.0::DOUBLE * j)) END) OVER (ORDER BY j) AS even,
    sum(CASE WHEN j = 0 THEN 0 ELSE ln(2.0::DOUBLE * j / (2 * j + 1)) END) OVER (ORDER BY j) AS odd
  FROM (SELECT unnest(generate_series(0, (SELECT max(n) // 2 FROM {rows}))) AS j))""", f"""{out}_s AS (
  SELECT df, angle, sum(exp((CASE WHEN df % 2 = 0 THEN even ELSE odd END) + 2 * j * ln(cos(angle)))) AS total
  FROM (SELECT DISTINCT df, angle FROM {out}_a) JOIN {out}_j ON j <= (df - 2 - df % 2) / 2 GROUP BY 1, 2)""", f"""{out} AS (
  SELECT r.*, CASE WHEN r.n < 3 OR r.t IS NULL THEN 1 WHEN a.df % 2 = 0 THEN 1 - sin(a.angle) * coalesce(total, 0)
    ELSE 1 - 2 / pi() * (a.angle + sin(a.angle) * cos(a.angle) * coalesce(total, 0)) END AS p
  FROM {rows} r LEFT JOIN (SELECT DISTINCT df, t, angle FROM {out}_a) a ON a.df = r.n - 2 AND a.t = r.t
    LEFT JOIN {out}_s s ON s.df = a.df AND s.angle = a.angle)"""]


BEST_CTES = [*LAG_CTES, """bl AS (
  SELECT *, row_number() OVER (PARTITION BY m1, m2 ORDER BY round(abs(r), 12) DESC, lag) AS k FROM lg)""",
             "bt AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM bl WHERE k = 1)"]
SQL_BEST_LAG = with_(*BEST_CTES, *tail_ctes("bt", "bp")) + f"""
SELECT m1 AS market1, m2 AS market2, lag, {rnd('r', 6, 'correlation')}, n, {rnd('t', 5)}, {rnd('p', 8, 'p_value')} FROM bp"""


def q_spillover(spark: SparkSession, sf: str) -> DataFrame:
    out = cr.spillover(_returns(spark, sf), threshold=0.05)
    return round_columns(out.withColumn("lag_hours", F.col("lag_hours").cast("bigint")), {"spillover_strength": 6, "p_value": 8})


DIRECTED = [f"""dir AS (
  SELECT m1 AS s, m2 AS t_, -lag AS lag, r, n FROM lg WHERE lag < 0
  UNION ALL SELECT m2, m1, lag, r, n FROM lg WHERE lag > 0)""",
            "dt AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM dir WHERE n >= 10)", *tail_ctes("dt", "dp"), """sg AS (
  SELECT *, row_number() OVER (PARTITION BY s, t_ ORDER BY round(abs(r), 12) DESC, lag) AS k FROM dp WHERE p < 0.05)"""]
SQL_SPILLOVER = with_(*LAG_CTES, *DIRECTED) + f"""
SELECT s AS source_market, t_ AS target_market, {rnd('abs(r)', 6, 'spillover_strength')},
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction, lag AS lag_hours, {rnd('p', 8, 'p_value')}
FROM sg WHERE k = 1 AND abs(r) > 0.05"""


def q_risk_regime(spark: SparkSession, sf: str) -> DataFrame:
    rets = _returns(spark, sf)
    pairs = materialise(cr.pair_correlations(rets), "pairs")
    out = beside(beside(cr.risk_regime(rets, "click", "view"), cr.dominance(pairs, "click")), cr.coupling(pairs))
    return round_columns(out, {c: 6 for c in out.columns if c != "regime"})


RISK_CTES = [f"""pc AS (
  SELECT m1, m2, {_R.format(x='x', y='y')} AS r, count(*) AS n FROM prs GROUP BY 1, 2 HAVING count(*) >= 10)""", """v AS (
  SELECT (stddev_samp(ret) FILTER (symbol = 'click') + stddev_samp(ret) FILTER (symbol = 'view')) * sqrt(24) / 2 AS vol,
    (SELECT r FROM pc WHERE m1 = 'click' AND m2 = 'view') AS r,
    (SELECT avg(abs(r)) FROM pc WHERE m1 = 'click' OR m2 = 'click') AS dom, (SELECT avg(abs(r)) FROM pc) AS cpl FROM rets)"""]
_RISK = f"""CASE WHEN r > 0.4 AND vol < 0.4 THEN 'risk_on' WHEN r < -0.2 OR vol > 0.6 THEN 'risk_off' ELSE 'neutral' END AS regime,
  {rnd("CASE WHEN r > 0.4 AND vol < 0.4 THEN least(r + 1 - vol, 1) WHEN r < -0.2 OR vol > 0.6 THEN least(abs(r) + vol, 1) ELSE 1 - abs(r) END", 6, 'confidence')},
  {rnd('vol', 6, 'volatility_level')}, {rnd('dom', 6, 'dominance')}, {rnd('cpl', 6, 'market_coupling')}"""
SQL_RISK_REGIME = with_(*RET_CTES, *RISK_CTES) + f"SELECT {_RISK}, {rnd('r', 6, 'correlation')} FROM v"


def q_cross_market(spark: SparkSession, sf: str) -> DataFrame:
    out = cr.cross_market(materialise(src.bars_hourly(spark, sf), "bars"), "click", "view")
    out = out.withColumn("best_lag", F.col("best_lag").cast("bigint"))
    return round_columns(out, {c: 6 for c in out.columns if c not in ("regime", "best_lag")})


SQL_CROSS_MARKET = with_(*BEST_CTES, *DIRECTED, *RISK_CTES, """spill AS (
  SELECT coalesce(avg(abs(r)), 0) AS index FROM sg WHERE k = 1 AND abs(r) > 0.5 AND s IN ('click', 'view') AND t_ IN ('click', 'view'))""",
                         "bb AS (SELECT r AS best, lag FROM bt WHERE m1 = 'click' AND m2 = 'view')") + f"""
SELECT {rnd('best', 6, 'best_correlation')}, lag AS best_lag, {rnd('spill.index', 6, 'spillover_index')}, {_RISK},
  {rnd('r', 6, 'base_correlation')} FROM v, bb, spill"""


QUERIES = {
    "bias_signals": (q_bias_signals, SQL_BIAS_SIGNALS),
    "bias_report": (q_bias_report, SQL_BIAS_REPORT),
    "influencers": (q_influencers, SQL_INFLUENCERS),
    "user_profiles": (q_user_profiles, SQL_USER_PROFILES),
    "echo_chambers": (q_echo_chambers, SQL_ECHO_CHAMBERS),
    "cascades": (q_cascades, SQL_CASCADES),
    "crowd_metrics": (q_crowd_metrics, SQL_CROWD_METRICS),
    "corr_matrix": (q_corr_matrix, SQL_CORR_MATRIX),
    "best_lag": (q_best_lag, SQL_BEST_LAG),
    "spillover": (q_spillover, SQL_SPILLOVER),
    "risk_regime": (q_risk_regime, SQL_RISK_REGIME),
    "cross_market": (q_cross_market, SQL_CROSS_MARKET),
}
