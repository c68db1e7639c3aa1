"""Text expressions: cleaning, tokens, emoji, tickers, asset routing, filters.

Word classes are written out as [\\p{L}\\p{N}_] because \\w is ASCII in Java.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.numeric import num

WORD = r"[\p{L}\p{N}_]"
EDGE = r"(?![\p{L}\p{N}_])"
URL = r"https?://(?:[a-zA-Z0-9$-_@.&+!*\\(),]|%[0-9a-fA-F][0-9a-fA-F])+"

# Words that carry no sentiment.
STOPWORDS = (
    "the a an and or but in on at to for of with is are was were been be have has had do does did will would "
    "should could may might must can this that these those i you he she it we they what which who when where "
    "why how rt"
).split()
# Emoji counted as positive and negative (single code points).
POSITIVE_EMOJI = "🚀📈💎🌙💰🔥✨💪🎉😄😊👍"
NEGATIVE_EMOJI = "📉💩🐻❌😱😰😭👎💔"
# Emoji that the cleaner keeps before special characters are blanked.
KEPT_EMOJI = "🚀📈💎🌙💰🔥📉💩🐻❌😱"
# Emoji blocks, as a rule instead of a list of all emoji.
EMOJI_BLOCKS = r"\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}"
# Coin names in a text and their tickers.
COIN_WORDS = {
    "bitcoin": "BTC", "ethereum": "ETH", "btc": "BTC", "eth": "ETH", "binance": "BNB", "cardano": "ADA",
    "solana": "SOL", "ripple": "XRP", "dogecoin": "DOGE", "doge": "DOGE",
}
COIN_NAMES = {
    "BITCOIN": "BTC", "ETHEREUM": "ETH", "BINANCE": "BNB", "CARDANO": "ADA", "SOLANA": "SOL", "RIPPLE": "XRP",
    "DOGECOIN": "DOGE", "POLKADOT": "DOT",
}
# Assets a post can be routed to, in order of precedence.
ASSETS = ("BTC", "ETH", "BNB", "SOL", "ADA", "XRP", "DOGE", "DOT", "MATIC", "AVAX")
DELETED = ("[deleted]", "[removed]", "")


def is_ascii(text: Column) -> Column:
    """As many bytes as characters: no emoji, no pattern needed."""
    return F.octet_length(text) == F.length(text)


def strip_emoji(text: Column, keep: str = KEPT_EMOJI) -> Column:
    """Drop emoji that carry no sentiment."""
    return F.regexp_replace(text, f"[{EMOJI_BLOCKS}&&[^{keep}]]", "")


def clean_post(text: Column, urls: bool = True, mentions: bool = True, hashtags: bool = False,
               lowercase: bool = True) -> Column:
    out = F.regexp_replace(text, URL, "") if urls else text
    out = F.regexp_replace(out, f"@{WORD}+", "") if mentions else out
    out = F.regexp_replace(out, f"#{WORD}+", "") if hashtags else F.regexp_replace(out, "#", "")
    out = F.regexp_replace(strip_emoji(out), r"[^\p{L}\p{N}_\s$.,!?@#-]+", " ")
    out = F.regexp_replace(out, r"\s+", " ")
    return F.trim(F.lower(out) if lowercase else out)


def clean_basic(text: Column) -> Column:
    """Squeeze white space, drop NUL characters."""
    return F.trim(F.translate(F.regexp_replace(text, r"\s+", " "), "\u0000", ""))


def words(text: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    """Number of ``words``, counted without making them."""
    return F.regexp_count(text, F.lit(r"\S+"))


def bare_word(word: Column) -> Column:
    """A word without outer ASCII punctuation; a word of punctuation only stays as it is."""
    inner = F.btrim(word, F.lit(string.punctuation))
    return F.when(inner == "", word).otherwise(inner)


def bare_words(text: Column) -> Column:
    """Words in lower case without outer ASCII punctuation; words of punctuation only stay as they are."""
    return F.transform(words(F.lower(text)), bare_word)


def tokens(cleaned: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Words without stop words and one-letter words."""
    return F.filter(words(cleaned), lambda t: (F.length(t) > 1) & ~F.lower(t).isin(list(stopwords)))


def emoji_sentiment(text: Column) -> Column:
    """(positive - negative) / all counted emoji; 0 without any."""
    good = F.length(text) - F.length(F.translate(text, POSITIVE_EMOJI, ""))
    bad = F.length(text) - F.length(F.translate(text, NEGATIVE_EMOJI, ""))
    return F.when(is_ascii(text), num(0)).otherwise(
        F.coalesce(F.try_divide((good - bad).cast("double"), good + bad), num(0)))


def hashtags(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(#{WORD}+)"), F.lit(1))
    return F.transform(found, lambda t: F.lower(t))


def mentions(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(@{WORD}+)"), F.lit(1))
    return F.transform(found, lambda t: F.lower(t))


def cashtags(text: Column) -> Column:
    """Tickers written as $XYZ, in order of appearance."""
    return F.regexp_extract_all(F.upper(text), F.lit(r"\$([A-Z]{2,5})" + EDGE), F.lit(1))


def _whole_words(listed: Sequence[str]) -> str:
    """A pattern of the listed words. Where no word's first letter stands, the dearer look behind is not tried."""
    firsts = {w[:1] for w in listed}
    ahead = f"(?=[{''.join(sorted(firsts))}])" if all(x.isalnum() for x in firsts) else ""
    return f"{ahead}(?<!{WORD})({'|'.join(listed)}){EDGE}"


def has_any(lowered: Column, listed: Sequence[str], match: str = "word") -> Column:
    """Whether ``word_hits`` has any: stops at the first one and makes no list."""
    if match == "word":
        return lowered.rlike(_whole_words(listed))
    return reduce(lambda a, b: a | b, [F.coalesce(contains_word(lowered, word, match), F.lit(False)) for word in listed])


def word_hits(lowered: Column, listed: Sequence[str], match: str = "word") -> Column:
    """The distinct listed words that occur in the text.

    Whole words are found in one pass with one pattern; substrings need a test each,
    because they may overlap.
    """
    if match == "word":
        return F.array_distinct(F.regexp_extract_all(lowered, F.lit(_whole_words(listed)), F.lit(1)))
    found = [F.when(contains_word(lowered, word, match), F.lit(word)) for word in listed]
    return F.filter(F.array(*found), lambda t: t.isNotNull())


def lookup(names: dict) -> Column:
    """A literal map."""
    return F.create_map(*[F.lit(v) for item in names.items() for v in item])


def _named(text: Column, names: dict[str, str], match: str) -> Column:
    return F.transform(word_hits(text, list(names), match), lambda t: F.element_at(lookup(names), t))


def contains_word(lowered: Column, word: str, match: str = "word") -> Column:
    """``word``: as a whole word. ``substring``: anywhere."""
    if match == "substring":
        return F.contains(lowered, F.lit(word))
    if match != "word":
        raise ValueError(f"unknown match: {match}")
    return lowered.rlike(f"(?<!{WORD}){word}{EDGE}")


def tickers(text: Column, names: dict[str, str] | None = None, match: str = "word") -> Column:
    """Distinct tickers by cashtag or by coin name, sorted."""
    names = COIN_WORDS if names is None else names
    lowered = {k.lower(): v for k, v in names.items()}
    return F.array_sort(F.array_union(cashtags(text), _named(F.lower(text), lowered, match)))


def entity_count(*lists: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.size(x) for x in lists])


def route_asset(text: Column, assets: Sequence[str] = ASSETS, default: str | None = "BTC",
                match: str = "word") -> Column:
    """The first listed cashtag of the text, else the first listed asset named in it."""
    listed = F.array(*[F.lit(a) for a in assets])
    tagged = F.get(F.filter(cashtags(text), lambda t: F.array_contains(listed, t)), F.lit(0))
    hits = word_hits(F.lower(text), [a.lower() for a in assets], match)
    # The intersection keeps the order of the list.
    named = F.upper(F.get(F.array_intersect(F.array(*[F.lit(a.lower()) for a in assets]), hits), F.lit(0)))
    return F.coalesce(tagged, named, F.lit(default))


def base_asset(symbol: Column) -> Column:
    """BTC-USD -> BTC."""
    return F.split(symbol, "-")[0]


def exchange_symbol(symbol: Column) -> Column:
    """BTC-USD -> BTCUSDT."""
    usdt = F.when(F.contains(symbol, F.lit("USD")) & ~F.contains(symbol, F.lit("USDT")),
                  F.replace(symbol, F.lit("USD"), F.lit("USDT"))).otherwise(symbol)
    return F.replace(usdt, F.lit("-"), F.lit(""))


def is_valid_text(cleaned: Column, token_list: Column, min_len: int = 10) -> Column:
    return (F.length(cleaned) >= min_len) & (F.size(token_list) > 0) & cleaned.rlike(r"[\p{L}\p{N}]")


def text_hash(text: Column) -> Column:
    return F.md5(text)


def simplified_chinese(text: Column) -> Column:
    """False only when traditional markers occur without simplified ones."""
    # Marker characters of the two scripts.
    return text.rlike("[国会来个问题]") | ~text.rlike("[國會來個問題]")


def length_flags(df: DataFrame, col: str = "cleaned", min_len: int = 10, max_len: int = 500,
                 truncate: bool = False) -> DataFrame:
    """too_short and truncated; the text is cut at ``max_len`` only when asked for."""
    size = F.length(col)
    out = df.withColumns({"too_short": size < min_len, "truncated": size > max_len})
    return out.withColumn(col, F.substring(col, 1, max_len)) if truncate else out


def drop_empty(df: DataFrame, col: str = "text") -> DataFrame:
    return df.where(F.trim(F.col(col)) != "")


def feed_filter(df: DataFrame, keywords: Sequence[str], lang: str | None = "en") -> DataFrame:
    """Posts with a keyword, in the language, that are not retweets."""
    hit = F.size(word_hits(F.lower("text"), [k.lower() for k in keywords])) > 0
    kept = df.where(hit & ~F.startswith(F.col("text"), F.lit("RT ")))
    return kept if lang is None else kept.where(F.col("lang") == lang)
