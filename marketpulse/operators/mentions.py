"""Entity mentions with positions, overlap removal, summaries and tagging.

Positions come from built-in functions only: ``split`` gives the gaps between the
matches of a pattern and ``regexp_extract_all`` the matches; the start of match i
is the length of gaps 0..i plus matches 0..i-1.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.numeric import num
from marketpulse.functions.text import EDGE, WORD, lookup

# Coins, stocks, exchanges and terms with their names.
COINS = {
    "btc": "Bitcoin", "bitcoin": "Bitcoin", "eth": "Ethereum", "ethereum": "Ethereum", "xrp": "Ripple",
    "ripple": "Ripple", "ada": "Cardano", "cardano": "Cardano", "sol": "Solana", "solana": "Solana",
    "doge": "Dogecoin", "dogecoin": "Dogecoin", "shib": "Shiba Inu", "matic": "Polygon", "polygon": "Polygon",
    "dot": "Polkadot", "polkadot": "Polkadot", "avax": "Avalanche", "avalanche": "Avalanche", "link": "Chainlink",
    "chainlink": "Chainlink", "uni": "Uniswap", "uniswap": "Uniswap", "bnb": "Binance Coin", "ltc": "Litecoin",
    "bch": "Bitcoin Cash", "xlm": "Stellar", "trx": "Tron", "atom": "Cosmos", "algo": "Algorand", "vet": "VeChain",
    "ftm": "Fantom", "sand": "The Sandbox", "mana": "Decentraland", "grt": "The Graph", "aave": "Aave",
    "mkr": "Maker", "snx": "Synthetix",
}
COIN_PATTERN = (
    "BTC ETH XRP ADA SOL DOGE SHIB MATIC DOT AVAX LINK UNI bitcoin ethereum ripple cardano solana dogecoin polygon "
    "polkadot avalanche chainlink uniswap"
).split()
STOCKS = {
    "AAPL": "Apple", "MSFT": "Microsoft", "GOOGL": "Alphabet", "GOOG": "Alphabet", "AMZN": "Amazon",
    "TSLA": "Tesla", "META": "Meta", "NVDA": "NVIDIA", "AMD": "AMD", "NFLX": "Netflix", "COIN": "Coinbase",
    "SQ": "Block", "PYPL": "PayPal", "V": "Visa", "MA": "Mastercard", "JPM": "JPMorgan", "BAC": "Bank of America",
    "GS": "Goldman Sachs", "MS": "Morgan Stanley", "C": "Citigroup", "WFC": "Wells Fargo", "SPY": "S&P 500 ETF",
    "QQQ": "Nasdaq ETF", "DIA": "Dow Jones ETF", "IWM": "Russell 2000 ETF",
}
EXCHANGES = (
    "binance coinbase kraken gemini bitstamp ftx kucoin huobi okx bitfinex bybit nyse nasdaq chicago cboe cme"
).split()
TERMS = [
    "bull", "bullish", "bear", "bearish", "rally", "crash", "dump", "pump", "moon", "lambo", "hodl", "fud", "fomo",
    "dip", "correction", "breakout", "breakdown", "reversal", "long", "short", "leverage", "margin", "liquidation",
    "position", "entry", "exit", "profit", "loss", "pnl", "stop-loss", "take-profit", "resistance", "support", "rsi",
    "macd", "ema", "sma", "bollinger", "fibonacci", "volume", "volatility", "momentum", "trend", "defi", "nft",
    "dao", "staking", "mining", "halving", "blockchain", "wallet", "exchange", "token", "coin", "altcoin", "whale",
    "airdrop", "ath", "atl", "marketcap", "market cap", "mcap", "valuation", "neutral", "optimistic",
    "pessimistic", "confident", "uncertain", "fearful", "greedy",
]
# Confidence per kind of mention.
CONFIDENCE = {"cashtag": 0.95, "stock": 0.85, "crypto": 0.9, "exchange": 0.85, "term": 0.7, "number": 0.95,
              "percentage": 0.95}
UNITS = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}

SPANS = "array<struct<text:string,start:int,end:int>>"
MENTION = "struct<text:string,type:string,start:int,end:int,confidence:double,value:double,attrs:map<string,string>>"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<text, start, end>> of the matches, offsets in characters."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # One walk over (gap, match) pairs; the gap after the last match has no partner.
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("match")), lambda p: p["match"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(state, p):
        begin = state["at"] + p["gap"]
        end = begin + F.length(p["match"])
        one = F.struct(p["match"].alias("text"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.array_append(state["out"], one).alias("out"))
    walked = F.aggregate(pairs, start, step, lambda state: state["out"])
    # Most texts have no match: one scan then, not two.
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(SPANS))


def _words(listed) -> str:
    # Longer words first, so that the longest alternative wins at one position.
    ordered = sorted(listed, key=len, reverse=True)
    return f"(?<!{WORD})({'|'.join(re.escape(w) for w in ordered)}){EDGE}"


def _mention(s: Column, kind: str, confidence: float, text: Column | None = None, value: Column | None = None,
             attrs: dict[str, Column] | None = None) -> Column:
    pairs = [v for k, c in (attrs or {}).items() for v in (F.lit(k), c)]
    extra = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map()
    return F.struct(
        (s["text"] if text is None else text).alias("text"), F.lit(kind).alias("type"), s["start"].alias("start"),
        s["end"].alias("end"), num(confidence).alias("confidence"),
        (F.lit(None).cast("double") if value is None else value).alias("value"),
        extra.cast("map<string,string>").alias("attrs"),
    )


def _cashtags(text: Column) -> Column:
    known = sorted({*STOCKS, *(c.upper() for c in COINS)})
    return F.transform(
        spans(text, r"\$(?:" + "|".join(k for k in known if 2 <= len(k) <= 5) + ")" + EDGE),
        lambda s: _mention(s, "ticker", CONFIDENCE["cashtag"], F.substr(s["text"], F.lit(2)), attrs={
            "symbol": F.substr(s["text"], F.lit(2)),
            "company": F.try_element_at(lookup(STOCKS), F.substr(s["text"], F.lit(2))),
        }),
    )


def _stocks(text: Column) -> Column:
    """Stock tickers as stand-alone upper-case words (punctuation around the word belongs to the span)."""
    listed = sorted((s for s in STOCKS if len(s) >= 2), key=len, reverse=True)
    mark = r"[^\p{L}\p{N}_\s]*"
    pattern = rf"(?<!\S){mark}(?:{'|'.join(listed)}){mark}(?!\S)"
    name = lambda s: F.regexp_replace(s["text"], r"[^\p{L}\p{N}_]", "")
    return F.transform(
        spans(text, pattern),
        lambda s: _mention(s, "ticker", CONFIDENCE["stock"], name(s), attrs={
            "symbol": name(s), "company": F.try_element_at(lookup(STOCKS), name(s)),
        }),
    )


def _named(text: Column) -> Column:
    """Coins, exchanges and terms: one pattern for all words, told apart by lists."""
    found = spans(text, "(?i)" + _words([*COIN_PATTERN, *EXCHANGES, *TERMS]))
    coins = [c.lower() for c in COIN_PATTERN]
    low = lambda s: F.lower(s["text"])
    return F.transform(found, lambda s: F.when(low(s).isin(coins), _mention(
        s, "crypto", CONFIDENCE["crypto"], attrs={
            "crypto": F.try_element_at(lookup(COINS), low(s)), "symbol": F.upper(s["text"])},
    )).when(low(s).isin(EXCHANGES), _mention(
        s, "exchange", CONFIDENCE["exchange"], F.initcap(s["text"]), attrs={"exchange": low(s)},
    )).otherwise(_mention(s, "financial_term", CONFIDENCE["term"], low(s), attrs={"term": low(s)})))


def _numbers(text: Column) -> Column:
    """Dollar amounts; a unit letter counts only at the end of a word."""
    pattern = rf"\$\s?[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?(?:\s?[KMBTkmbt]{EDGE})?"
    unit = lambda s: F.upper(F.regexp_extract(s["text"], "([KMBTkmbt])$", 1))
    amount = lambda s: F.regexp_replace(s["text"], r"[^0-9.]", "").try_cast("double")
    factor = lambda s: F.coalesce(F.try_element_at(lookup(UNITS), unit(s)), num(1))
    return F.transform(
        spans(text, pattern),
        lambda s: _mention(s, "number", CONFIDENCE["number"], value=amount(s) * factor(s),
                           attrs={"formatted": s["text"]}),
    )


def _percentages(text: Column) -> Column:
    value = lambda s: F.regexp_replace(s["text"], "[%+]", "").try_cast("double")
    way = lambda s: F.when(value(s) > 0, "up").when(value(s) < 0, "down").otherwise("neutral")
    return F.transform(
        spans(text, r"[+-]?[0-9]+(?:\.[0-9]+)?%"),
        lambda s: _mention(s, "percentage", CONFIDENCE["percentage"], value=value(s), attrs={"direction": way(s)}),
    )


def all_mentions(text: Column) -> Column:
    """Mentions of every kind, overlaps included."""
    def if_any(mark: str, found: Column) -> Column:
        """The pattern needs a character that most texts do not have."""
        return F.when(F.contains(text, F.lit(mark)), found).otherwise(F.array().cast(f"array<{MENTION}>"))
    return F.concat(if_any("$", _cashtags(text)), _stocks(text), _named(text), if_any("$", _numbers(text)),
                    if_any("%", _percentages(text)))


def dedupe_spans(found: Column) -> Column:
    """Keep mentions in the order (start, highest confidence) that overlap no kept one."""
    def before(a, b):
        return (
            F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).otherwise(0)
        )
    start = F.struct(F.lit(0).alias("reach"), F.array().cast(f"array<{MENTION}>").alias("kept"))

    def step(state, m):
        free = m["start"] >= state["reach"]
        return F.struct(
            F.when(free, m["end"]).otherwise(state["reach"]).alias("reach"),
            F.when(free, F.array_append(state["kept"], m)).otherwise(state["kept"]).alias("kept"),
        )
    return F.aggregate(F.array_sort(found, before), start, step, lambda state: state["kept"])


def mentions(posts: DataFrame, key: str = "post_id", col: str = "text") -> DataFrame:
    """One row per kept mention: key, text, type, start, end, confidence, value, attrs."""
    return posts.select(key, F.inline(dedupe_spans(all_mentions(F.col(col)))))


def add_model_mentions(posts: DataFrame, model: DataFrame, key: str = "post_id", col: str = "text") -> DataFrame:
    """Merge mentions of a user's model (same columns, one row each) and remove overlaps again."""
    rows = model.groupBy(key).agg(F.collect_list(F.struct(
        "text", "type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
        "confidence", F.lit(None).cast("double").alias("value"),
        F.create_map().cast("map<string,string>").alias("attrs"),
    )).alias("_model"))
    both = posts.join(rows, key, "left").withColumn(
        "_all", F.concat(all_mentions(F.col(col)), F.coalesce("_model", F.array().cast(f"array<{MENTION}>")))
    )
    return both.select(key, F.inline(dedupe_spans(F.col("_all"))))


def mention_summary(found: DataFrame, key: str = "post_id") -> DataFrame:
    """Distinct mention texts per post and type, sorted."""
    return found.groupBy(key, "type").agg(F.array_sort(F.collect_set("text")).alias("texts"))


def tag_text(posts: DataFrame, col: str = "text") -> DataFrame:
    """The text with each kept mention as <TYPE>mention</TYPE>."""
    kept = dedupe_spans(all_mentions(F.col(col)))
    text = F.col(col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, m):
        tag = F.upper(m["type"])
        before = F.substr(text, state["at"] + 1, m["start"] - state["at"])
        marked = F.concat(F.lit("<"), tag, F.lit(">"), m["text"], F.lit("</"), tag, F.lit(">"))
        return F.struct(m["end"].alias("at"), F.concat(state["out"], before, marked).alias("out"))
    tagged = F.aggregate(kept, start, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1)))
    return posts.withColumn("tagged", tagged)
