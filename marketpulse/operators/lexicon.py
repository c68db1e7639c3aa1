"""Word-list scores: fear/greed words, valence lexicon, native words, sarcasm, image text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions.numeric import clip, div, num
from marketpulse.functions.text import bare_word, has_any, is_ascii, lookup, word_count, word_hits
from marketpulse.operators.joins import checked

# Fear and greed words with their weights.
FEAR_WORDS = {
    "crash": 2.0, "dump": 1.5, "panic": 2.0, "sell": 1.0, "fear": 1.5, "blood": 1.8, "bottom": 1.2, "bear": 1.3,
    "collapse": 2.0, "drop": 1.0, "fall": 1.0, "scary": 1.5, "worried": 1.3, "uncertain": 1.2, "risk": 1.0,
    "loss": 1.3,
}
GREED_WORDS = {
    "moon": 2.0, "pump": 1.5, "fomo": 2.0, "bullish": 1.3, "buy": 1.0, "greed": 1.5, "ath": 1.8, "100x": 2.0,
    "lambo": 1.8, "bull": 1.3, "surge": 1.2, "rally": 1.2, "rocket": 1.5, "hodl": 1.2, "diamond": 1.5,
    "accumulate": 1.0,
}
# Negations and boosters of the published valence method, and its constants.
NEGATIONS = (
    "not no never none nobody nothing neither nor nowhere cannot without aint isnt wasnt dont doesnt didnt wont "
    "cant couldnt shouldnt wouldnt hardly rarely"
).split()
BOOSTERS_UP = "very really extremely incredibly absolutely totally completely utterly so highly hugely".split()
BOOSTERS_DOWN = "slightly somewhat barely marginally partly almost kinda scarcely".split()
BOOST = 0.293
NEGATE = -0.74
DISTANCE = (1.0, 0.95, 0.9)
NORM = 15.0
# Sarcastic phrases, intensifiers, exaggerations and rhetorical questions.
SARCASTIC = [
    "oh great", "oh wonderful", "just great", "just wonderful", "yeah right", "sure thing", "how nice", "real nice",
    "thanks a lot", "big surprise", "shocker", "who would have thought", "color me surprised", "well done",
    "good job", "nice one", "brilliant",
]
INTENSIFIERS = ["so", "very", "really", "extremely", "incredibly", "absolutely", "totally", "completely", "utterly"]
HYPERBOLE = ["never", "always", "everyone", "nobody", "nothing", "everything", "best", "worst", "ever", "impossible"]
RHETORICAL = ["what could go wrong", "who would have thought", "what a surprise", "why am i not surprised",
              r"seriously\?"]
SMILES = "😂🤣😅😏🙄"
# Native words per language.
NATIVE_WORDS = {
    "zh-cn": (["好", "棒", "涨", "牛", "看多", "突破", "强势", "利好"],
              ["差", "跌", "熊", "看空", "崩", "暴跌", "利空", "套牢"]),
    "ja": (["良い", "上がる", "強気", "突破"], ["悪い", "下がる", "弱気", "暴落"]),
    "ko": (["좋다", "상승", "강세", "돌파"], ["나쁘다", "하락", "약세", "폭락"]),
}
# Words that mark a chart and phrases that mark a meme.
CHART_WORDS = ["chart", "graph", "candlestick", "price", "volume", "bullish", "bearish", "support", "resistance",
               "trend", "moving average", "rsi", "macd"]
MEME_WORDS = ["to the moon", "diamond hands", "paper hands", "hodl", "wen", "gm", "wagmi", "ngmi", "rekt", "pump",
              "dump", "ape in"]


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _count(flags: list[Column]) -> Column:
    return _sum([f.cast("int") for f in flags])


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def _weight(lowered: Column, table: dict[str, float], match: str) -> Column:
    weights = F.transform(word_hits(lowered, list(table), match), lambda w: F.element_at(lookup(table), w))
    return F.least(F.aggregate(weights, num(0), lambda s, v: s + v), num(10)) / 10.0


def fear_greed_score(posts: DataFrame, match: str = "word", fear=None, greed=None, prefix: str = "fg_") -> DataFrame:
    """Weighted fear and greed words of a text: positive, negative, neutral, compound, confidence."""
    lowered = F.col("_lowered")
    out = posts.withColumn("_lowered", F.lower("text")).withColumns({
        f"{prefix}positive": _weight(lowered, greed or GREED_WORDS, match),
        f"{prefix}negative": _weight(lowered, fear or FEAR_WORDS, match),
    }).drop("_lowered")
    up, down = F.col(f"{prefix}positive"), F.col(f"{prefix}negative")
    return out.withColumns({
        f"{prefix}neutral": 1 - F.greatest(up, down),
        f"{prefix}compound": up - down,
        f"{prefix}confidence": F.abs(up - down),
    })


def _boost(word: Column) -> Column:
    plain = F.regexp_replace(word, "'", "")
    return (
        F.when(plain.isin(BOOSTERS_UP), num(BOOST)).when(plain.isin(BOOSTERS_DOWN), num(-BOOST)).otherwise(num(0))
    )


def _hits(texts: DataFrame, lexicon: DataFrame, key: list[str], col: str, every: bool = False) -> DataFrame:
    """(key..., valence, _first, b1, b2, b3): the words of each text that the lexicon has, with the three words before them.

    ``every`` keeps the first word of each text, NULL texts too, whether the lexicon has it or not; ``_first`` tells which it is. Splitting, looking up and filtering are one
    generated loop over the words: words that the lexicon lacks are never made rows of.
    """
    split = F.split(F.lower(col), r"\s+")
    rows = texts.select(*key, split.alias("_w")).select(*key, "_w", (F.posexplode_outer if every else F.posexplode)("_w").alias("_at", "_word"))
    # White space at the ends of a text leaves empty words there.
    before = [F.expr(f"nullif(get(_w, _at - {k}), '')").alias(f"_r{k}") for k in (1, 2, 3)]
    rows = rows.select(*key, "_at", bare_word(F.nullif(F.col("_word"), F.lit(""))).alias("token"), *before)
    met = rows.join(checked(lexicon), "token", "left" if every else "inner")
    first = F.coalesce("_at", F.lit(0)) == 0
    if every:
        met = met.where(F.col("valence").isNotNull() | first)
    return met.select(*key, "valence", first.alias("_first"), *[bare_word(F.col(f"_r{k}")).alias(f"b{k}") for k in (1, 2, 3)])


def _adjusted() -> Column:
    """Valence of a hit after boosting or negation by the words before it."""
    shift = _sum([F.coalesce(_boost(F.col(f"b{k}")), num(0)) * DISTANCE[k - 1] for k in (1, 2, 3)])
    negated = _any([
        F.coalesce(F.regexp_replace(F.col(f"b{k}"), "'", "").isin(NEGATIONS), F.lit(False)) for k in (1, 2, 3)
    ])
    boosted = F.col("valence") + F.signum("valence") * shift
    return F.when(negated, boosted * NEGATE).otherwise(boosted)


def valence_hits(texts: DataFrame, lexicon: DataFrame, key: list[str], col: str = "text") -> DataFrame:
    """Words of each text that are in the lexicon, with their adjusted valence ``v``.

    Words travel with their neighbours, so nothing is shuffled to find them; a lexicon
    that is small enough to broadcast joins on the map side as well.
    """
    return _hits(texts, lexicon, key, col).select(*key, _adjusted().alias("v"))


def _normalise(total: Column) -> Column:
    return F.coalesce(clip(total / F.sqrt(total * total + NORM), -1, 1), num(0))


def compound(texts: DataFrame, lexicon: DataFrame, key: list[str], col: str = "text", out: str = "compound") -> DataFrame:
    """(key..., out) for the texts with at least one lexicon word."""
    hits = valence_hits(texts, lexicon, key, col)
    return hits.groupBy(*key).agg(_normalise(F.sum("v")).alias(out))


def lexicon_score(posts: DataFrame, lexicon: DataFrame, key: str = "post_id", col: str = "text") -> DataFrame:
    """positive, negative, neutral shares, compound in [-1, 1] and confidence of each post.

    The text itself is left behind: words are scored and summed where the text is read,
    and only one row of sums per post is shuffled, with the other columns of the post. Equal posts
    stay posts of their own.
    """
    keep = [key, *[c for c in posts.columns if c not in (key, col)]]
    text = F.col(col)
    rows = posts.select(
        F.monotonically_increasing_id().alias("_post"), *keep, (F.length(F.trim(text)) == 0).alias("_empty"), word_count(text).alias("_n"), text.alias("_text"))
    scored = _hits(rows, lexicon, ["_post", *keep, "_empty", "_n"], "_text", every=True).withColumn("v", _adjusted())
    v = F.col("v")
    sums = scored.groupBy("_post", *keep, "_empty", "_n").agg(
        F.sum(v).alias("_total"),
        F.coalesce(F.sum(F.when(v > 0, v + 1)), num(0)).alias("_up"),
        F.abs(F.coalesce(F.sum(F.when(v < 0, v - 1)), num(0))).alias("_down"),
        F.count_if(v != 0).alias("_hits"),
    )
    plain = (F.col("_n") - F.col("_hits")).cast("double")
    everything = F.col("_up") + F.col("_down") + plain
    out = sums.withColumns({
        "positive": F.coalesce(div(F.col("_up"), everything), num(0)),
        "negative": F.coalesce(div(F.col("_down"), everything), num(0)),
        "neutral": F.coalesce(div(plain, everything), num(1)),
        "compound": _normalise(F.col("_total")),
    })
    best = F.greatest("positive", "negative", "neutral")
    return out.withColumn("confidence", F.when(F.col("_empty"), num(0)).otherwise(best)).select(*keep, *FIELDS)


FIELDS = ("positive", "negative", "neutral", "compound", "confidence")


def ensemble_score(posts: DataFrame, lexicon: DataFrame, lexicon_weight: float = 0.7, words_weight: float = 0.3,
                   key: str = "post_id", match: str = "word") -> DataFrame:
    """Lexicon and fear/greed scores blended, field by field."""
    both = lexicon_score(fear_greed_score(posts, match), lexicon, key)
    blended = {f: F.col(f) * lexicon_weight + F.col(f"fg_{f}") * words_weight for f in FIELDS}
    return both.withColumns(blended).drop(*[f"fg_{f}" for f in FIELDS])


def native_score(posts: DataFrame, native=None) -> DataFrame:
    """native_score in [-1, 1] and native_confidence min(1, hits / 5) by the words of the language; 0 elsewhere."""
    native = native or NATIVE_WORDS
    text = F.col("text")

    def hits(side: int) -> Column:
        per_lang = F.lit(0)
        for lang, lists in native.items():
            found = _count([F.contains(text, F.lit(w)) for w in lists[side]])
            per_lang = F.when(F.col("lang") == lang, found).otherwise(per_lang)
        return per_lang
    out = posts.withColumns({"_up": hits(0), "_down": hits(1)})
    total = F.col("_up") + F.col("_down")
    return out.withColumns({
        "native_score": F.coalesce(div((F.col("_up") - F.col("_down")).cast("double"), total), num(0)),
        "native_confidence": F.least(total / num(5), num(1)),
    }).drop("_up", "_down")


def route_language(posts: DataFrame, english: str = "compound", native=None) -> DataFrame:
    """Native score where its confidence is above 0.3, else the English score.

    The native score is computed from the text unless its columns are there already.
    """
    native = native or NATIVE_WORDS
    scored = posts if "native_score" in posts.columns else native_score(posts, native)
    use = F.col("lang").isin(list(native)) & (F.col("native_confidence") > 0.3)
    return scored.withColumns({
        "route": F.when(use, "native").otherwise("english"),
        "language_score": F.when(use, F.col("native_score")).otherwise(F.col(english)),
        "language_confidence": F.when(use, F.col("native_confidence")).otherwise(F.abs(F.col(english))),
    })


def sarcasm(posts: DataFrame, lexicon: DataFrame, key: str = "post_id", match: str = "word",
            model_score: str | None = None) -> DataFrame:
    """Per post: compound, is_sarcastic, sarcasm_confidence, sarcasm_indicators, adjusted_sentiment.

    Contradicting neighbour sentences x 0.4, patterns x 0.3, context x 0.3 (and a
    model score x 0.3 when its column is given); above 0.5 the sentiment is flipped.
    """
    text, lowered = F.col("text"), F.col("_lowered")
    whole = compound(posts, lexicon, [key]).withColumnRenamed("compound", "_compound")

    sentences = posts.select(key, F.posexplode(F.split("text", r"[.!?]+")).alias("_pos", "text")).where(
        F.col("text").rlike(r"\S")
    )
    # Every sentence has a first word, so the sums have all sentences; rows of equal keys count as often as they are.
    spoken = _hits(sentences, lexicon, [key, "_pos"], "text", every=True).groupBy(key, "_pos").agg(
        _normalise(F.sum(_adjusted())).alias("_s"), F.count_if("_first").alias("_rows"))
    w = Window.partitionBy(key).orderBy("_pos")
    steps = spoken.withColumn("_next", F.lead("_s").over(w))
    turn = ((F.col("_s") > 0.3) & (F.col("_next") < -0.3)) | ((F.col("_s") < -0.3) & (F.col("_next") > 0.3))
    contradiction = steps.groupBy(key).agg(F.sum("_rows").alias("_sentences"), F.count_if(turn).alias("_turns"))

    quotes = posts.select(
        key, F.posexplode(F.regexp_extract_all("text", F.lit("[\"']([^\"']+)[\"']"), F.lit(1))).alias("_pos", "text")
    )
    praised = compound(quotes, lexicon, [key, "_pos"]).where(F.col("compound") > 0.3).groupBy(key).agg(
        F.count(F.lit(1)).alias("_praise")
    )

    phrases = _count([F.contains(lowered, F.lit(p)) for p in SARCASTIC])
    strong = has_any(lowered, INTENSIFIERS, match)
    caps = F.regexp_count(text, F.lit(r"(?=[A-Z]{2})(?<![\p{L}\p{N}_])[A-Z]{2,}(?![\p{L}\p{N}_])"))
    rhetorical = F.when(F.contains(text, F.lit("?")), _count([lowered.rlike(p) for p in RHETORICAL])).otherwise(0)
    # All tests of the text itself run where it is read; the text goes no further.
    d = posts.withColumn("_lowered", F.lower(text)).select(
        key, F.regexp_count(text, F.lit("!")).alias("_shouts"), F.regexp_count(text, F.lit(r"\?")).alias("_asks"),
        phrases.alias("_phrases"), strong.alias("_strong"), caps.alias("_caps"),
        F.contains(text, F.lit("...")).alias("_dots"), F.size(word_hits(lowered, HYPERBOLE, match)).alias("_hyper"),
        rhetorical.alias("_rhetorical"), (~is_ascii(text) & text.rlike(f"[{SMILES}]")).alias("_smiles"),
        (F.length(F.trim(text)) >= 3).alias("_long"), *([model_score] if model_score else []),
    )
    d = d.join(whole, key, "left").join(contradiction, key, "left").join(praised, key, "left")
    d = d.withColumns({"_compound": F.coalesce("_compound", num(0)), "_praise": F.coalesce("_praise", F.lit(0))})
    share = div(F.col("_turns").cast("double"), F.greatest(F.col("_sentences") - 1, F.lit(1)))
    d = d.withColumns({
        "_contra": F.when((F.col("_sentences") >= 2) & (share > 0.5), share).otherwise(num(0)),
        "_mild": F.col("_strong") & (F.abs("_compound") < 0.3),
        "_smile": F.col("_smiles") & (F.col("_compound") < -0.2),
    })

    def when(flag: Column, weight: float) -> Column:
        return F.when(flag, num(weight)).otherwise(num(0))
    pattern = F.least(_sum([
        when(F.col("_shouts") >= 3, 0.3), when(F.col("_asks") >= 2, 0.2), F.col("_praise") * 0.4,
        F.col("_phrases") * 0.5, when(F.col("_mild"), 0.3), when(F.col("_caps") >= 2, 0.2), when(F.col("_dots"), 0.1),
    ]), num(1))
    context = F.least(_sum([
        when(F.col("_hyper") >= 2, 0.3), F.col("_rhetorical") * 0.4, when(F.col("_smile"), 0.4),
    ]), num(1))
    model = F.col(model_score) * 0.3 if model_score else num(0)
    confidence = F.least(F.col("_contra") * 0.4 + pattern * 0.3 + context * 0.3 + model, num(1))
    labels = {
        "sentiment_contradiction": F.col("_contra") > 0, "excessive_exclamation": F.col("_shouts") >= 3,
        "multiple_questions": F.col("_asks") >= 2, "quoted_positive": F.col("_praise") > 0,
        "sarcastic_phrase": F.col("_phrases") > 0, "intensifier_with_mild_sentiment": F.col("_mild"),
        "caps_words": F.col("_caps") >= 2, "ellipsis": F.col("_dots"), "hyperbole": F.col("_hyper") >= 2,
        "rhetorical_question": F.col("_rhetorical") > 0, "emoji_sentiment_mismatch": F.col("_smile"),
    }
    named = F.filter(F.array(*[F.when(c, n) for n, c in labels.items()]), lambda x: x.isNotNull())
    long_enough = F.col("_long")
    d = d.withColumns({
        "sarcasm_confidence": F.when(long_enough, confidence).otherwise(num(0)), "sarcasm_indicators": named,
    })
    flipped = F.col("sarcasm_confidence") > 0.5
    d = d.withColumns({
        "is_sarcastic": flipped,
        "adjusted_sentiment": F.when(~long_enough, num(0))
        .when(flipped, -F.col("_compound") * F.col("sarcasm_confidence")).otherwise(F.col("_compound")),
    })
    return d.select(key, F.col("_compound").alias("compound"), "is_sarcastic", "sarcasm_confidence",
                    "sarcasm_indicators", "adjusted_sentiment")


def image_text_flags(df: DataFrame, match: str = "substring") -> DataFrame:
    """is_chart, is_meme and has_text of the text read from an image."""
    lowered = F.col("_lowered")
    caps = div(F.regexp_count("text", F.lit(r"\p{Lu}")).cast("double"), F.greatest(F.length("text"), F.lit(1)))
    shouted = (F.length("text") < 100) & (caps > 0.7)
    return df.withColumn("_lowered", F.lower("text")).withColumns({
        "is_chart": has_any(lowered, CHART_WORDS, match),
        "is_meme": has_any(lowered, MEME_WORDS, match) | shouted,
        "has_text": F.length(F.trim("text")) > 0,
    }).drop("_lowered")


def image_text_sentiment(df: DataFrame, text_score: str, colour_score: str, match: str = "substring") -> DataFrame:
    """Text and colour score blended 0.7 / 0.3, halved on charts, x 1.2 on memes, cut to [-1, 1].

    The flags are computed from the text unless they are there already.
    """
    d = df if "is_chart" in df.columns else image_text_flags(df, match)
    has_text = F.col("has_text")
    base = F.when(has_text, F.col(text_score) * 0.7 + F.col(colour_score) * 0.3).otherwise(F.col(colour_score))
    scaled = base * F.when(F.col("is_chart"), num(0.5)).otherwise(num(1)) * F.when(
        F.col("is_meme"), num(1.2)).otherwise(num(1))
    sure = F.when(has_text, num(0.8)).otherwise(num(0.3))
    return d.withColumns({
        "overall_sentiment": clip(scaled, -1, 1),
        "image_confidence": F.when(F.col("is_meme"), F.least(sure * 1.1, num(1))).otherwise(sure),
    })
