"""Crowd psychology over posts: influencers, echo chambers, cascades, crowd metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions import frames as fr
from marketpulse.functions.numeric import div, num, seconds_between
from marketpulse.operators.chains import spaced
from marketpulse.operators.joins import asof_join, beside, posts_of
from marketpulse.operators.series import over_series, running
from marketpulse.operators.timeframes import SECOND, dense, micros
from marketpulse.session import materialise, sized


def user_profiles(posts: DataFrame) -> DataFrame:
    """Posts, mean and spread of sentiment, mean engagement, first follower count and time span per user."""
    return posts.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("posts"),
        F.avg("sentiment_score").alias("avg_sentiment"),
        F.stddev_samp("sentiment_score").alias("sentiment_std"),
        F.avg("engagement").alias("avg_engagement"),
        F.min_by("follower_count", "ts").alias("follower_count"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def first_names(posts: DataFrame) -> DataFrame:
    """(user_id, username): the name of the first post.

    Names are grouped before they are compared: an aggregate that carries text would
    sort all posts.
    """
    seen = posts.groupBy("user_id", "username").agg(F.min("ts").alias("_ts"))
    return seen.groupBy("user_id").agg(F.min_by("username", F.struct("_ts", "username")).alias("username"))


def influencers(posts: DataFrame, floor: int = 1000) -> DataFrame:
    """Users with at least ``floor`` followers and their influence score in [0, 1]."""
    d = user_profiles(posts).where(F.col("follower_count") >= floor).join(first_names(posts), "user_id")
    days = F.floor(seconds_between(F.col("first_ts"), F.col("last_ts")) / 86400)
    d = d.withColumns({
        "engagement_rate": F.col("avg_engagement") / F.greatest("follower_count", F.lit(1)),
        "post_frequency": F.col("posts") / F.greatest(days, F.lit(1)),
    })
    score = (
        F.log10((F.col("follower_count") + 1).cast("double")) / 7.0 * 0.5 + F.col("engagement_rate") * 0.3
        + F.least(F.col("post_frequency") / 10, num(1)) * 0.2
    )
    return d.select(
        "user_id", "username", "follower_count", "engagement_rate", F.col("avg_sentiment").alias("average_sentiment"),
        "post_frequency", F.least(score, num(1)).alias("influence_score"),
    )


def top_influencers(posts: DataFrame, floor: int = 1000) -> DataFrame:
    return influencers(posts, floor).orderBy(F.col("influence_score").desc(), "user_id")


#: Cells of a line that one window scans.
CELLS = 1000


def _islands(pieces: DataFrame, eps: float) -> DataFrame:
    """(chamber_id, _lo, _hi): pieces of a line put together where gaps are at most ``eps``, numbered from the left.

    What the pieces before reach is carried over stretches of CELLS cells by ``running``, so no window holds the line.
    """
    stretch = F.floor(F.col("_lo") / eps / CELLS)
    pieces = pieces.distinct()
    # A question for each piece, asked before the piece itself counts.
    both = pieces.select("_lo", "_hi", F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("_end")).unionByName(
        pieces.select("_lo", "_hi", F.lit(1).alias("_kind"), F.col("_hi").alias("_end")))
    reached = running(both, {"_reach": ("max", F.col("_end"))}, (), ("_lo", "_hi", "_kind"), stretch).where("_kind = 0")
    parted = materialise(reached.select("_lo", "_hi", F.when(F.col("_lo") - F.col("_reach") <= eps, 0).otherwise(1).alias("_new")), "pieces")
    numbered = running(parted, {"_count": ("sum", F.col("_new"))}, (), ("_lo", "_hi"), stretch)
    islands = numbered.groupBy((F.col("_count") - 1).alias("chamber_id")).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    return materialise(islands, "islands")


def chamber_members(posts: DataFrame, eps: float = 0.2, min_pts: int = 5) -> DataFrame:
    """(user_id, chamber_id, avg_sentiment, avg_engagement): density clusters of the users' mean sentiment.

    The line is cut into cells of width ``eps``. All points of a cell are neighbours,
    so a cell with ``min_pts`` points holds only core points and just its range is
    needed. Cells with fewer points are compared point by point with the neighbour
    cells. Clusters are ranges of core points with gaps of at most ``eps``; a border
    point goes to the nearest range, of two as near to the left one.

    Scores may have any finite size: every join is on a cell or a chamber, and its sides are written, so that the planner knows
    what is small. Ranges are looked up once per cell, not per user. Users without a mean (NULL or NaN) are in no chamber.
    """
    users = posts.groupBy("user_id").agg(
        F.avg("sentiment_score").alias("avg_sentiment"), F.avg("engagement").alias("avg_engagement")
    ).where(F.col("avg_sentiment").isNotNull() & ~F.isnan("avg_sentiment"))
    users = materialise(users.withColumn("_cell", F.floor(F.col("avg_sentiment") / eps).cast("bigint")), "users")
    x = F.col("avg_sentiment")
    cells = sized(users.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi")))
    dense_cells = cells.where(F.col("_n") >= min_pts).select("_lo", "_hi")

    # At most min_pts - 1 points of a cell.
    thin = users.join(cells.where(F.col("_n") < min_pts).select("_cell"), "_cell").select(
        F.col("user_id").alias("_user"), F.col("avg_sentiment").alias("_x"),
        F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1)).alias("_cell"),
    )
    near = users.select("_cell", "avg_sentiment").join(materialise(thin, "thin"), "_cell").where(F.abs(x - F.col("_x")) <= eps)
    cores = near.groupBy("_user", "_x").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_pts).select(
        F.col("_x").alias("_lo"), F.col("_x").alias("_hi"))
    islands = _islands(dense_cells.unionByName(cores), eps)

    # The last range that begins at or before a cell's first point, and those after it that begin within its reach: ranges
    # begin more than eps apart, so two can; one more is looked at for rounding.
    marks = islands.select(F.col("_lo").alias("_at"), F.lit(0).alias("_kind"), F.col("chamber_id").alias("_id")).unionByName(
        cells.select(F.col("_lo").alias("_at"), F.lit(1).alias("_kind"), "_cell"), allowMissingColumns=True)
    seen = running(marks, {"_last": ("last", F.col("_id"))}, (), ("_at", "_kind"), F.floor(F.col("_at") / eps / CELLS)).where("_kind = 1")
    asked = seen.select("_cell", F.explode(F.sequence(F.coalesce("_last", F.lit(-1)), F.coalesce("_last", F.lit(-1)) + 3)).alias("chamber_id"))
    ranges = sized(asked.join(islands, "chamber_id").groupBy("_cell").agg(
        F.collect_list(F.struct("chamber_id", "_lo", "_hi")).alias("_ranges")))

    def ranked(r):
        return F.struct(F.greatest(r["_lo"] - x, x - r["_hi"], num(0)).alias("gap"), r["chamber_id"].alias("chamber_id"))
    nearest = F.array_min(F.transform("_ranges", ranked))
    hit = users.join(ranges, "_cell").withColumn("_nearest", nearest).where(F.col("_nearest.gap") <= eps)
    return hit.select("user_id", F.col("_nearest.chamber_id").alias("chamber_id"), "avg_sentiment", "avg_engagement")


def top_tags(posts: DataFrame, by: list[str], k: int = 5) -> DataFrame:
    """The k most used hashtags per group, most used first (ties by name)."""
    counts = posts.select(*by, F.explode("hashtags").alias("tag")).groupBy(*by, "tag").agg(
        F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.col("_n").desc(), "tag")
    best = counts.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "tag")))
    return best.groupBy(*by).agg(F.transform(ordered, lambda e: e["tag"]).alias("common_hashtags"))


def echo_chambers(posts: DataFrame, eps: float = 0.2, min_pts: int = 5) -> DataFrame:
    """Size, homogeneity, dominant side, engagement and hashtags of each chamber."""
    members = materialise(chamber_members(posts, eps, min_pts), "members")
    mean, spread = F.avg("avg_sentiment"), F.stddev_samp("avg_sentiment")
    facts = members.groupBy("chamber_id").agg(
        F.count(F.lit(1)).alias("members"), mean.alias("mean_sentiment"),
        (1 / (1 + spread)).alias("sentiment_homogeneity"), F.avg("avg_engagement").alias("average_engagement"),
    ).where(F.col("members") >= min_pts)
    m = F.col("mean_sentiment")
    facts = facts.withColumn(
        "dominant_sentiment", F.when(m > 0.2, "positive").when(m < -0.2, "negative").otherwise("neutral"))
    tagged = posts.join(members.select("user_id", "chamber_id"), "user_id")
    return facts.join(top_tags(tagged, ["chamber_id"]), "chamber_id", "left")


def cascades(posts: DataFrame, hours: float = 6, window: int = 20, sigma: float = 2.0, least_users: int = 5,
             least_move: float = 0.3) -> DataFrame:
    """Sentiment cascades per asset.

    A jump of the rolling mean by more than ``sigma`` deviations starts a span of
    ``hours``; the next one starts after it. Kept are spans with more than
    ``least_users`` users whose peak is more than ``least_move`` away from the start.
    """
    def step(d, w):
        d = d.withColumn("rolling", fr.mean_partial(F.col("sentiment_score"), window, w))
        return d.withColumn("change", fr.diff(F.col("rolling"), w))
    rows = over_series(posts.withColumn("_t", micros("ts")), step, window, by=("asset",), order=("ts", "event_id"),
                       chunk=dense(), numbered=True)
    rows = materialise(rows.select("asset", "ts", "_t", "event_id", "_rn", "user_id", "rolling", "change"), "rolling")
    spread = rows.groupBy("asset").agg((F.stddev_samp("change") * sigma).alias("_limit"))
    jumps = rows.join(sized(spread), "asset").where(F.abs("change") > F.col("_limit"))
    starts = spaced(jumps, int(hours * 3600 * SECOND) + 1, ("asset",))
    first = jumps.groupBy("asset", "_t").agg(F.min_by(F.struct("_rn", "rolling", "ts"), "_rn").alias("_s"))
    opened = starts.join(first, ["asset", "_t"]).select(
        "asset", "_t", F.col("_s._rn").alias("_first"), F.col("_s.rolling").alias("initial_sentiment"),
        F.col("_s.ts").alias("start_time"))
    span = int(hours * 3600 * SECOND)
    chunk = F.floor(F.col("_t") / (300 * SECOND))
    inside = asof_join(
        rows.select("asset", "_t", "_rn", "ts", "user_id", "rolling"), opened,
        ("_first", "initial_sentiment", "start_time"), ("asset",), "_t", chunk=chunk, bar_ts="_start",
    ).where((F.col("_rn") >= F.col("_first")) & (F.col("_t") - F.col("_start") <= span))
    stats = inside.groupBy("asset", "start_time", "initial_sentiment").agg(
        F.max("ts").alias("end_time"),
        F.max_by("rolling", F.struct(F.abs("rolling"), -F.col("_rn"))).alias("peak_sentiment"),
        F.count_distinct("user_id").alias("affected_users"),
    )
    length = seconds_between(F.col("start_time"), F.col("end_time")) / 3600
    return stats.withColumn("spread_rate", F.col("affected_users") / F.greatest(length, num(0.1))).where(
        (F.abs(F.col("peak_sentiment") - F.col("initial_sentiment")) > least_move)
        & (F.col("affected_users") > least_users)
    )


def herd(posts: DataFrame) -> DataFrame:
    """1 / (1 + deviation of sentiment), 0 below two posts."""
    return posts.agg(F.coalesce(F.least(1 / (1 + F.stddev_samp("sentiment_score")), num(1)), num(0)).alias("herd"))


def polarisation(posts: DataFrame) -> DataFrame:
    s = F.col("sentiment_score")
    both = F.count_if((s > 0.2) | (s < -0.2))
    calm = F.count_if((s >= -0.2) & (s <= 0.2))
    n = F.count(s)
    value = div(both.cast("double"), n) * (1 - div(calm.cast("double"), n))
    return posts.agg(F.when(n >= 2, F.least(value, num(1))).otherwise(num(0)).alias("polarisation"))


def crowd_metrics(posts: DataFrame, hours: float = 6) -> DataFrame:
    """One row: herd, echo chamber index, influencer impact, volatility, contagion, polarisation."""
    posts = materialise(posts, "posts")
    members = chamber_members(posts)
    sized = members.groupBy("chamber_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 5)
    in_chambers = sized.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_members"))
    loud = posts_of(posts, influencers(posts)).agg(F.count(F.lit(1)).alias("_loud"))
    moves = over_series(
        posts.withColumn("_all", F.lit(0)), lambda d, w: d.withColumn("_d", fr.diff(F.col("sentiment_score"), w)), 1,
        by=("_all",), order=("ts", "event_id"), chunk=dense(),
    ).agg(F.coalesce(F.stddev_samp("_d"), num(0)).alias("sentiment_volatility"))
    spread = cascades(posts, hours).agg(F.coalesce(F.avg("spread_rate"), num(0)).alias("_rate"))
    basics = posts.agg(F.count(F.lit(1)).alias("_posts"), F.count_distinct("user_id").alias("_users"))
    one = reduce(beside, [herd(posts), polarisation(posts), in_chambers, loud, moves, spread], basics)
    return one.select(
        F.col("herd").alias("herd_mentality_score"),
        (F.col("_members") / F.greatest("_users", F.lit(1))).alias("echo_chamber_index"),
        (F.col("_loud") / F.greatest("_posts", F.lit(1))).alias("influencer_impact"),
        "sentiment_volatility", F.least(F.col("_rate") / 100, num(1)).alias("contagion_rate"),
        F.col("polarisation").alias("network_polarization"),
    )
