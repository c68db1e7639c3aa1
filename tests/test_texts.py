"""Cleaning, mentions, lexicon and sarcasm on literal sentences."""

import re

import pytest
from pyspark.sql import functions as F

from marketpulse.functions import text as tx
from marketpulse.operators import lexicon as lex
from marketpulse.operators import mentions as ment
from marketpulse.operators import phrases as ph
from marketpulse.operators import posts as po
from marketpulse.operators import sentiment as se


def posts(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "post_id long, text string")


def test_cleaning(spark):
    d = po.preprocess(posts(
        spark, "Check https://x.io/a?b=1 @bob #Moon NOW!! 🚀 😀 é", "$BTC and $ETH, bitcoin too", "a", "🚀🚀📉"))
    got = {r["post_id"]: r for r in d.collect()}
    assert got[0]["cleaned"] == "check moon now!! é"
    assert got[0]["hashtags"] == ["#moon"] and got[0]["mentions"] == ["@bob"]
    assert got[1]["tickers"] == ["BTC", "ETH"]
    assert got[1]["tokens"] == ["$btc", "$eth,", "bitcoin", "too"]
    assert got[2]["too_short"] and not got[2]["is_valid"]
    assert got[3]["emoji_sentiment"] == pytest.approx(1 / 3)


def test_length_rules(spark):
    d = tx.length_flags(posts(spark, "x" * 600).withColumnRenamed("text", "cleaned"), truncate=True).first()
    assert d["truncated"] and len(d["cleaned"]) == 500


def test_asset_routing(spark):
    d = posts(spark, "I like $ETH more than BTC", "BTC up", "together we win", "nothing", "$XYZ and doge")
    word = [r[0] for r in d.orderBy("post_id").select(tx.route_asset(F.col("text"))).collect()]
    loose = [r[0] for r in d.orderBy("post_id").select(tx.route_asset(F.col("text"), match="substring")).collect()]
    assert word == ["ETH", "BTC", "BTC", "BTC", "DOGE"]
    assert loose[2] == "ETH"
    pair = spark.range(1).select(tx.exchange_symbol(F.lit("BTC-USD")), tx.base_asset(F.lit("BTC-USD"))).first()
    assert tuple(pair) == ("BTCUSDT", "BTC")


SENTENCES = [
    "Bitcoin hits $50,000 on Binance, up 5.2% 🚀 é $BTC",
    "TSLA and AAPL drop -3%; SEC probes Coinbase over $1.5B",
    "no entities here",
    "$50 to win, ETH/BTC pair, stop-loss at $1.2k",
]


def test_mention_offsets(spark):
    for r in ment.mentions(posts(spark, *SENTENCES)).collect():
        source = SENTENCES[r["post_id"]][r["start"]:r["end"]]
        core = source.strip("$;,")
        assert core.lower() == r["text"].strip("$").lower(), (r, source)


def test_mention_values(spark):
    got = {(r["post_id"], r["type"], r["text"]): r for r in ment.mentions(posts(spark, *SENTENCES)).collect()}
    assert got[(0, "number", "$50,000")]["value"] == 50000
    assert got[(0, "percentage", "5.2%")]["attrs"] == {"direction": "up"}
    assert got[(1, "number", "$1.5B")]["value"] == 1.5e9
    assert got[(1, "percentage", "-3%")]["attrs"] == {"direction": "down"}
    assert got[(1, "ticker", "TSLA")]["attrs"]["company"] == "Tesla"
    assert got[(3, "number", "$50")]["value"] == 50  # the next word is no unit
    assert got[(3, "number", "$1.2k")]["value"] == 1200
    assert (3, "financial_term", "stop-loss") in got and (3, "financial_term", "loss") not in got
    assert (0, "ticker", "BTC") in got and (0, "crypto", "BTC") not in got  # overlap: the cashtag starts first


def test_kept_mentions_do_not_overlap(spark):
    spans = {}
    for r in ment.mentions(posts(spark, *SENTENCES)).collect():
        spans.setdefault(r["post_id"], []).append((r["start"], r["end"]))
    for found in spans.values():
        found.sort()
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))


def test_spans_match_python(spark):
    pattern = r"[a-z]+|\d"
    texts = ["ab1 🚀cd2", "", "é9é", "zz"]
    got = posts(spark, *texts).select("post_id", ment.spans(F.col("text"), pattern).alias("s")).collect()
    for r in got:
        want = [(m.group(), m.start(), m.end()) for m in re.finditer(pattern, texts[r["post_id"]])]
        assert [tuple(x) for x in r["s"]] == want


def test_tags_and_summary(spark):
    d = posts(spark, "Buy BTC on Binance")
    assert ment.tag_text(d).first()["tagged"] == "Buy <CRYPTO>BTC</CRYPTO> on <EXCHANGE>Binance</EXCHANGE>"
    kinds = {r["type"]: r["texts"] for r in ment.mention_summary(ment.mentions(d)).collect()}
    assert kinds == {"crypto": ["BTC"], "exchange": ["Binance"]}


def test_model_mentions(spark):
    d = posts(spark, "Jane Doe buys BTC")
    model = spark.createDataFrame([(0, "Jane Doe", "person", 0, 8, 0.8), (0, "BTC", "product", 14, 17, 0.5)],
                                  "post_id long, text string, type string, start int, end int, confidence double")
    got = {(r["text"], r["type"]) for r in ment.add_model_mentions(d, model).collect()}
    assert got == {("Jane Doe", "person"), ("BTC", "crypto")}


def lexicon(spark):
    return spark.createDataFrame([("great", 3.0), ("bad", -2.5), ("crash", -2.0)], "token string, valence double")


def test_valence_rules(spark):
    texts = ["this is great", "this is not great", "this is very great", "this is slightly bad", "plain words", "", "GREAT!"]
    got = {r["post_id"]: r for r in lex.lexicon_score(posts(spark, *texts), lexicon(spark)).collect()}
    base = 3 / (9 + 15) ** 0.5
    assert got[0]["compound"] == pytest.approx(base)
    assert got[6]["compound"] == pytest.approx(base)
    v = 3 * -0.74
    assert got[1]["compound"] == pytest.approx(v / (v * v + 15) ** 0.5)
    v = 3 + 0.293
    assert got[2]["compound"] == pytest.approx(v / (v * v + 15) ** 0.5)
    v = -2.5 + 0.293
    assert got[3]["compound"] == pytest.approx(v / (v * v + 15) ** 0.5)
    assert got[4]["compound"] == 0 and got[4]["neutral"] == 1 and got[4]["confidence"] == 1
    assert got[5]["confidence"] == 0
    assert got[0]["positive"] == pytest.approx(4 / 6)


def test_fear_greed_words(spark):
    d = posts(spark, "crash and panic", "to the moon, buy", "weather is bullish")
    word = {r["post_id"]: r for r in lex.fear_greed_score(d).collect()}
    loose = {r["post_id"]: r for r in lex.fear_greed_score(d, match="substring").collect()}
    assert word[0]["fg_compound"] == pytest.approx(-0.4)
    assert word[1]["fg_compound"] == pytest.approx(0.3)
    assert word[2]["fg_compound"] == pytest.approx(0.13)
    assert loose[2]["fg_compound"] == pytest.approx(0.13 + 0.13 + 0.18)  # bull, bullish, ath


def test_sarcasm(spark):
    texts = ["Great. Bad. Great!!! Oh great?? what could go wrong? seriously? yeah right", "This is great", "hm", "Great. Bad. Great."]
    got = {r["post_id"]: r for r in lex.sarcasm(posts(spark, *texts), lexicon(spark)).collect()}
    assert got[0]["is_sarcastic"] and got[0]["adjusted_sentiment"] < 0 < got[0]["compound"]
    assert "rhetorical_question" in got[0]["sarcasm_indicators"]
    assert got[3]["sarcasm_indicators"] == ["sentiment_contradiction"]
    assert got[3]["sarcasm_confidence"] == pytest.approx(0.4)
    assert not got[1]["is_sarcastic"] and got[1]["adjusted_sentiment"] == got[1]["compound"]
    assert got[2]["sarcasm_confidence"] == 0


def test_votes(spark):
    rows = [(1, "finbert", 0.9, "positive", 0.9), (1, "vader", 0.2, "positive", 0.2), (1, "textblob", -0.8, "negative", 0.8),
            (2, "vader", 0.0, "neutral", 0.0), (3, "vader", 0.5, "positive", 0.5), (3, "textblob", -0.5, "negative", 0.5)]
    d = spark.createDataFrame(rows, "post_id long, model string, score double, label string, confidence double")
    got = {m: {r["post_id"]: r for r in se.vote_models(d, m).collect()} for m in ("voting", "weighted", "confidence")}
    assert got["voting"][1]["ensemble_label"] == "positive" and got["voting"][1]["ensemble_score"] == pytest.approx(0.55)
    assert got["voting"][1]["confidence"] == pytest.approx(2 / 3)
    assert got["voting"][3]["ensemble_label"] == "positive"  # tie
    assert got["weighted"][1]["ensemble_score"] == pytest.approx((0.9 * 0.4 + 0.2 * 0.2 - 0.8 * 0.1) / 0.7)
    assert got["confidence"][1]["ensemble_score"] == 0.9
    assert got["confidence"][2]["ensemble_label"] == "neutral"
    assert got["confidence"][3]["ensemble_score"] == 0.5  # the first model wins a tie
    with pytest.raises(ValueError):
        se.vote_models(d, "other")


def test_native_words(spark):
    d = spark.createDataFrame([(0, "zh-cn", "好 涨 跌"), (1, "en", "好"), (2, "ko", "상승 돌파 강세 좋다")], "post_id long, lang string, text string")
    got = {r["post_id"]: (r["native_score"], r["native_confidence"]) for r in lex.native_score(d).collect()}
    assert got[0] == (pytest.approx(1 / 3), pytest.approx(0.6))
    assert got[1] == (0, 0) and got[2] == (1, pytest.approx(0.8))


def test_token_counts_of_shared_and_missing_keys(spark):
    rows = [(1, ["a", "b", "a"]), (1, ["a", "c"]), (2, ["a"]), (None, ["a", "b"]), (None, ["a"]), (3, []), (4, None)]
    got = po.token_counts(spark.createDataFrame(rows, "post_id long, tokens array<string>"))
    assert {tuple(r) for r in got.select("token", "n", "posts").collect()} == {("a", 6, 2), ("b", 2, 1), ("c", 1, 1)}


def test_word_runs_stop_where_no_name_goes_on(spark):
    names = spark.createDataFrame([("alpha beta",), ("alpha beta gamma delta",), ("ΟΔΟΣ. one",), ("beta",)], "name string")
    posts = spark.createDataFrame([(1, "Alpha  beta alpha beta gamma beta"), (2, "alpha BETA gamma Delta"), (3, "x ΟΔΟΣ. One"), (4, None)], "post_id long, text string")
    table = ph.name_table(names)
    starts = {r["name"] for r in ph.name_starts(table).collect()}
    assert {"alpha", "alpha beta", "alpha beta gamma", "alpha beta gamma delta", "οδοσ", "οδοσ. one", "beta"} == starts
    got = {(r["post_id"], r["name"], r["start"], r["end"]) for r in ph.phrase_mentions(posts, names).collect()}
    assert {(1, "beta", 7, 11), (1, "alpha beta", 12, 22), (1, "beta", 29, 33), (2, "alpha beta gamma delta", 0, 22)} <= got
    assert {g for g in got if g[0] != 3} == {(1, "beta", 7, 11), (1, "alpha beta", 12, 22), (1, "beta", 29, 33), (2, "alpha beta gamma delta", 0, 22)}


def test_lexicon_looks_words_up_before_they_are_rows(spark):
    """Only hits and first words reach the sums, and neighbours are those of the whole text."""
    lexicon = spark.createDataFrame([("good", 2.0), ("!!", 1.0)], "token string, valence double")
    posts = spark.createDataFrame([(1, "  not (very) GOOD, good"), (2, ""), (3, None), (4, "plain words only"), (5, "!! x ")], "post_id long, text string")
    hits = lex._hits(posts, lexicon, ["post_id"], "text", every=True)
    got = sorted((r["post_id"], r["valence"] or 0, r["b1"] or "", r["b2"] or "", r["b3"] or "") for r in hits.collect())
    assert got == [(1, 0, "", "", ""), (1, 2.0, "good", "very", "not"), (1, 2.0, "very", "not", ""), (2, 0, "", "", ""), (3, 0, "", "", ""),
                   (4, 0, "", "", ""), (5, 1.0, "", "", "")]
    assert hits.groupBy("post_id").agg(F.count_if("_first").alias("n")).where("n <> 1").count() == 0
    score = {r["post_id"]: r for r in lex.lexicon_score(posts, lexicon).collect()}
    assert len(score) == 5 and score[2]["confidence"] == 0 and score[4]["neutral"] == 1 and score[1]["compound"] < 0


def test_word_lists_agree_with_and_without_hits(spark):
    texts = spark.createDataFrame([("so it is",), ("also",), ("x so-so",), ("",), (None,)], "t string")
    got = [tuple(r) for r in texts.select(tx.has_any(F.col("t"), ["so", "very"]), F.size(tx.word_hits(F.col("t"), ["so", "very"])) > 0,
                                          tx.has_any(F.col("t"), ["so"], "substring")).collect()]
    assert got == [(True, True, True), (False, False, True), (True, True, True), (False, False, False), (None, None, False)]
