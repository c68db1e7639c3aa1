"""Queries over the text of posts."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.functions import text as tx
from marketpulse.functions.numeric import num, round_columns
from marketpulse.operators import lexicon as lex
from marketpulse.operators import mentions as ment
from marketpulse.operators import phrases as ph
from marketpulse.operators import posts as po
from marketpulse.operators import sentiment as se
from marketpulse.plans.sqlkit import LEX, POSTS, literal, rnd, with_
from marketpulse.session import materialise
from marketpulse.sources import adapters as src

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def _strings(values) -> str:
    return ", ".join(literal(v) for v in values)


def has_word(lowered: str, word: str) -> str:
    return f"regexp_matches({lowered}, '(^|{NW}){word}({NW}|$)')"


# --- cleaning ----------------------------------------------------------------

_NO_URL = f"regexp_replace(text, {literal(tx.URL)}, '', 'g')"
_NO_AT = f"regexp_replace({_NO_URL}, '@{W}+', '', 'g')"
_NO_HASH = f"replace({_NO_AT}, '#', '')"
_NO_EMOJI = (f"regexp_replace(regexp_replace({_NO_HASH}, '[{tx.KEPT_EMOJI}]', ' ', 'g'), "
             f"'[{tx.EMOJI_BLOCKS}]', '', 'g')")
_PLAIN = rf"regexp_replace({_NO_EMOJI}, '[^\p{{L}}\p{{N}}_\s$.,!?@#-]', ' ', 'g')"
CLEAN = rf"trim(lower(regexp_replace({_PLAIN}, '\s+', ' ', 'g')))"
_COINS = ", ".join(f"CASE WHEN {has_word('lower(text)', k)} THEN '{v}' END" for k, v in tx.COIN_WORDS.items())
_CASHTAGS = rf"regexp_extract_all(upper(text), '\$([A-Z]{{2,5}})({NW}|$)', 1)"
_TICKERS = f"list_sort(list_distinct(list_filter(list_concat({_CASHTAGS}, [{_COINS}]), lambda t: t IS NOT NULL)))"


def _hits(chars: str) -> str:
    return f"length(regexp_replace(text, '[^{chars}]', '', 'g'))"


CLEANED = f"""cleaned AS (
  SELECT post_id, text, {CLEAN} AS cleaned, {_TICKERS} AS tickers, {_hits(tx.POSITIVE_EMOJI)} AS up,
    {_hits(tx.NEGATIVE_EMOJI)} AS dn, list_transform(regexp_extract_all(text, '#{W}+'), lambda t: lower(t)) AS tags,
    list_transform(regexp_extract_all(text, '@{W}+'), lambda t: lower(t)) AS ats
  FROM posts)"""


def q_clean_posts(spark: SparkSession, sf: str) -> DataFrame:
    d = po.preprocess(src.posts(spark, sf))
    return d.select(
        "post_id", F.md5("cleaned").alias("cleaned_md5"), F.length("cleaned").cast("bigint").alias("cleaned_length"),
        F.array_join("tickers", ",").alias("tickers"), F.array_join("hashtags", ",").alias("hashtags"),
        F.array_join("mentions", ",").alias("mentions"), F.col("entity_count").cast("bigint").alias("entity_count"),
        F.round("emoji_sentiment", 6).alias("emoji_sentiment"), "too_short", "truncated", "is_valid",
    )


_STOP = _strings(tx.STOPWORDS)
_TOKENS = rf"list_filter(string_split(cleaned, ' '), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))"
SQL_CLEAN_POSTS = with_(POSTS, CLEANED, f"tk AS (SELECT *, {_TOKENS} AS tokens, coalesce((up - dn) / nullif(up + dn, 0)::DOUBLE, 0) AS es FROM cleaned)") + rf"""
SELECT post_id, md5(cleaned) AS cleaned_md5, length(cleaned) AS cleaned_length,
  array_to_string(tickers, ',') AS tickers, array_to_string(tags, ',') AS hashtags,
  array_to_string(ats, ',') AS mentions, len(tickers) + len(tags) + len(ats) AS entity_count,
  {rnd('es', 6, 'emoji_sentiment')}, length(cleaned) < 10 AS too_short, length(cleaned) > 500 AS truncated,
  length(cleaned) >= 10 AND len(tokens) > 0 AND regexp_matches(cleaned, '[\p{{L}}\p{{N}}]') AS is_valid
FROM tk"""


def q_post_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return po.token_counts(po.preprocess(src.posts(spark, sf)))


SQL_POST_TOKENS = with_(POSTS, CLEANED, f"tk AS (SELECT post_id, unnest({_TOKENS}) AS token FROM cleaned)") + """
SELECT token, count(*) AS n, count(DISTINCT post_id) AS posts FROM tk GROUP BY 1"""


def q_clean_basic(spark: SparkSession, sf: str) -> DataFrame:
    posts = tx.drop_empty(tx.feed_filter(src.posts(spark, sf), ["bitcoin", "crash", "rally", "hodl"], "en"))
    clean = tx.clean_basic(F.col("text"))
    return posts.select("post_id", F.md5(clean).alias("text_md5"), F.length(clean).cast("bigint").alias("n_chars"))


SQL_CLEAN_BASIC = with_(POSTS) + rf"""
SELECT post_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_md5,
  length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n_chars
FROM posts WHERE lang = 'en' AND NOT starts_with(text, 'RT ') AND trim(text) <> ''
  AND ({' OR '.join(has_word('lower(text)', w) for w in ['bitcoin', 'crash', 'rally', 'hodl'])})"""


def q_route_asset(spark: SparkSession, sf: str) -> DataFrame:
    asset = tx.route_asset(F.col("text"))
    loose = tx.route_asset(F.col("text"), default=None, match="substring")
    return src.posts(spark, sf).select(
        "post_id", asset.alias("asset"), loose.alias("asset_substring"),
        tx.base_asset(F.concat(asset, F.lit("-USD"))).alias("base"),
        tx.exchange_symbol(F.concat(asset, F.lit("-USD"))).alias("exchange_symbol"),
    )


def _route(test, default: str) -> str:
    tagged = f"list_filter({_CASHTAGS}, lambda t: t IN ({_strings(tx.ASSETS)}))[1]"
    named = " ".join(f"WHEN {test(a.lower())} THEN '{a}'" for a in tx.ASSETS)
    return f"coalesce({tagged}, CASE {named} END, {default})"


SQL_ROUTE_ASSET = with_(POSTS, f"""r AS (
  SELECT post_id, {_route(lambda w: has_word('lower(text)', w), "'BTC'")} AS asset,
    {_route(lambda w: f"contains(lower(text), '{w}')", "NULL")} AS asset_substring FROM posts)""") + """
SELECT post_id, asset, asset_substring, asset AS base, asset || 'USDT' AS exchange_symbol FROM r"""


def q_dedupe_posts(spark: SparkSession, sf: str) -> DataFrame:
    return po.dedupe_posts(src.table(spark, sf, "documents"), "doc_id")


SQL_DEDUPE_POSTS = "SELECT md5(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"


# --- mentions ----------------------------------------------------------------

def q_mentions(spark: SparkSession, sf: str) -> DataFrame:
    found = ment.mentions(src.posts(spark, sf))
    return found.select("post_id", "type", "text", "start", "end", "confidence", F.round("value", 4).alias("value"),
                        F.to_json("attrs").alias("attrs"))


def q_mention_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = ment.mention_summary(ment.mentions(src.posts(spark, sf)))
    return out.select("post_id", "type", F.array_join("texts", "|").alias("texts"))


def q_tag_text(spark: SparkSession, sf: str) -> DataFrame:
    out = ment.tag_text(src.posts(spark, sf))
    return out.select("post_id", F.md5("tagged").alias("tagged_md5"), F.length("tagged").alias("n_chars"))


_W = r"[\p{L}\p{N}_]"
_quoted = lambda words: ", ".join(literal(w) for w in words)


def _places(name: str, pattern: str, source: str = "posts") -> str:
    """A CTE with each match of a pattern and its place (post_id, m, a, b)."""
    return f"""{name} AS (
  SELECT post_id, m, a, a + length(m) AS b FROM (
    SELECT post_id, m, sum(length(g) + coalesce(length(was), 0)) OVER (PARTITION BY post_id ORDER BY i) AS a FROM (
      SELECT post_id, i, m, g, lag(m) OVER (PARTITION BY post_id ORDER BY i) AS was FROM (
        SELECT post_id, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(string_split_regex(text, '{pattern}')) AS g,
          generate_subscripts(string_split_regex(text, '{pattern}'), 1) AS i FROM {source}))) WHERE m IS NOT NULL)"""


def _map_sql(names: dict[str, str]) -> str:
    return f"map([{_quoted(names)}], [{_quoted(names.values())}])"


_TICKERS = sorted({*ment.STOCKS, *(c.upper() for c in ment.COINS)})
#: Words are compared one by one; pairs of words stand for the names of two words.
MENTION_CTES = [POSTS, _places("tok", _W + "+"), """pair AS (
  SELECT post_id, a, lead(b) OVER w AS b2, lead(a) OVER w AS a2, b, m FROM tok WINDOW w AS (PARTITION BY post_id ORDER BY a))""", f"""run AS (
  SELECT post_id, a, b, m FROM tok UNION ALL
  SELECT post_id, a, b2, substr(text, a::BIGINT + 1, (b2 - a)::BIGINT) FROM pair JOIN posts USING (post_id) WHERE a2 = b + 1)""", f"""hit AS (
  SELECT * FROM run WHERE lower(m) IN ({_quoted(sorted({w.lower() for w in [*ment.COIN_PATTERN, *ment.EXCHANGES, *ment.TERMS]}))}))""", """named AS (
  SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.post_id = h.post_id AND o.a <= h.a AND o.b >= h.b AND o.b - o.a > h.b - h.a))""",
    _places("chunk", r"\S+"), _places("amount", r"\$\s?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?(?:\s?[KMBTkmbt]\b)?"),
    _places("pct", r"[+-]?[0-9]+(?:\.[0-9]+)?%"), rf"""found AS (
  SELECT post_id, t.m AS text, 'ticker' AS type, t.a - 1 AS a, t.b, 0.95::DOUBLE AS confidence, NULL::DOUBLE AS value,
    '{{"symbol":"' || t.m || '"' || coalesce(',"company":"' || {_map_sql(ment.STOCKS)}[t.m] || '"', '') || '}}' AS attrs
  FROM tok t JOIN posts USING (post_id) WHERE t.a > 0 AND substr(posts.text, t.a::BIGINT, 1) = '$' AND length(t.m) BETWEEN 2 AND 5 AND t.m IN ({_quoted(_TICKERS)})
  UNION ALL SELECT post_id, s, 'ticker', a, b, 0.85, NULL, '{{"symbol":"' || s || '","company":"' || {_map_sql(ment.STOCKS)}[s] || '"}}' FROM (
    SELECT *, regexp_extract(m, '^[^\p{{L}}\p{{N}}_]*({_W}+)[^\p{{L}}\p{{N}}_]*$', 1) AS s FROM chunk) WHERE length(s) >= 2 AND s IN ({_quoted(ment.STOCKS)})
  UNION ALL SELECT post_id, CASE WHEN kind = 'crypto' THEN m WHEN kind = 'exchange' THEN upper(l[1]) || substr(l, 2) ELSE l END, kind, a, b,
    CASE kind WHEN 'crypto' THEN 0.9 WHEN 'exchange' THEN 0.85 ELSE 0.7 END, NULL,
    CASE kind WHEN 'crypto' THEN '{{"crypto":"' || {_map_sql(ment.COINS)}[l] || '","symbol":"' || upper(m) || '"}}'
      WHEN 'exchange' THEN '{{"exchange":"' || l || '"}}' ELSE '{{"term":"' || l || '"}}' END FROM (
    SELECT *, lower(m) AS l, CASE WHEN lower(m) IN ({_quoted(c.lower() for c in ment.COIN_PATTERN)}) THEN 'crypto'
      WHEN lower(m) IN ({_quoted(ment.EXCHANGES)}) THEN 'exchange' ELSE 'financial_term' END AS kind FROM named)
  UNION ALL SELECT post_id, m, 'number', a, b, 0.95, regexp_replace(m, '[^0-9.]', '', 'g')::DOUBLE * CASE upper(m[-1])
      WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 WHEN 'T' THEN 1e12 ELSE 1 END, '{{"formatted":"' || m || '"}}' FROM amount
  UNION ALL SELECT post_id, m, 'percentage', a, b, 0.95, v, '{{"direction":"' || CASE WHEN v > 0 THEN 'up' WHEN v < 0 THEN 'down' ELSE 'neutral' END || '"}}'
  FROM (SELECT *, regexp_replace(m, '[%+]', '', 'g')::DOUBLE AS v FROM pct))""", """ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY a, confidence DESC) AS i FROM found)""", """fold AS (
  SELECT post_id, i, b AS reach, true AS kept FROM ranked WHERE i = 1 UNION ALL
  SELECT r.post_id, r.i, CASE WHEN r.a >= f.reach THEN r.b ELSE f.reach END, r.a >= f.reach FROM fold f JOIN ranked r
    ON r.post_id = f.post_id AND r.i = f.i + 1)""", """kept AS MATERIALIZED (
  SELECT r.* FROM ranked r JOIN fold USING (post_id, i) WHERE fold.kept)"""]
_mention_with = lambda *more: with_(*MENTION_CTES, *more).replace("WITH ", "WITH RECURSIVE ", 1)
SQL_MENTIONS = _mention_with() + f"""
SELECT post_id, type, text, a::INT AS "start", b::INT AS "end", confidence, {rnd('value', 4)}, attrs FROM kept"""
SQL_MENTION_SUMMARY = _mention_with() + """
SELECT post_id, type, array_to_string(list_sort(list(DISTINCT text)), '|') AS texts FROM kept GROUP BY 1, 2"""
SQL_TAG_TEXT = _mention_with("""piece AS (
  SELECT k.post_id, k.a, substr(p.text, coalesce(lag(b) OVER w, 0)::BIGINT + 1, (a - coalesce(lag(b) OVER w, 0))::BIGINT)
    || '<' || upper(type) || '>' || k.text || '</' || upper(type) || '>' AS s
  FROM kept k JOIN posts p USING (post_id) WINDOW w AS (PARTITION BY k.post_id ORDER BY a))""", """joined AS (
  SELECT p.post_id, coalesce(any_value(q.s), '') || substr(p.text, coalesce(any_value(q.b), 0)::BIGINT + 1) AS tagged
  FROM posts p LEFT JOIN (SELECT post_id, string_agg(piece.s, '' ORDER BY piece.a) AS s, max(kept.b) AS b FROM piece JOIN kept USING (post_id, a) GROUP BY 1) q
  USING (post_id) GROUP BY p.post_id, p.text)""") + "SELECT post_id, md5(tagged) AS tagged_md5, length(tagged)::INT AS n_chars FROM joined"


def q_phrase_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of two and three words of the benchmark texts, wherever a post holds them."""
    words = F.split("text", " ")

    def runs(n: int) -> Column:
        firsts = F.slice(words, 1, F.greatest(F.size(words) - n + 1, F.lit(0)))
        return F.transform(firsts, lambda w, i: F.array_join(F.slice(words, i + 1, n), " "))
    names = src.table(spark, sf, "benchmark").select(F.explode(F.concat(runs(2), runs(3))).alias("name"))
    return ph.phrase_mentions(src.posts(spark, sf), names)


SQL_PHRASE_MENTIONS = with_(POSTS, "bw AS (SELECT string_split(text, ' ') AS w FROM benchmark)", """nm AS (
  SELECT DISTINCT lower(trim(array_to_string(w[i:i + k], ' '))) AS name FROM bw, range(1, 1000) r(i), range(1, 3) s(k) WHERE i + k <= len(w))""",
    f"nw AS (SELECT name FROM nm WHERE regexp_matches(name, '{_W}'))", _places("tok", _W + "+"), """win AS (
  SELECT post_id, a, unnest([b, lead(b) OVER w, lead(b, 2) OVER w, lead(b, 3) OVER w, lead(b, 4) OVER w, lead(b, 5) OVER w, lead(b, 6) OVER w,
    lead(b, 7) OVER w, lead(b, 8) OVER w, lead(b, 9) OVER w, lead(b, 10) OVER w, lead(b, 11) OVER w]) AS b FROM tok WINDOW w AS (PARTITION BY post_id ORDER BY a))""", """hit AS (
  SELECT post_id, a, b, name FROM win JOIN posts USING (post_id) JOIN nw ON name = lower(substr(text, a::BIGINT + 1, (b - a)::BIGINT)) WHERE b IS NOT NULL)""", """ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY a, b DESC) AS i FROM hit)""", """fold AS (
  SELECT post_id, i, b AS reach, true AS kept FROM ranked WHERE i = 1 UNION ALL
  SELECT r.post_id, r.i, CASE WHEN r.a >= f.reach THEN r.b ELSE f.reach END, r.a >= f.reach FROM fold f JOIN ranked r
    ON r.post_id = f.post_id AND r.i = f.i + 1)""").replace("WITH ", "WITH RECURSIVE ", 1) + """
SELECT post_id, name, a::INT AS "start", b::INT AS "end" FROM ranked JOIN fold USING (post_id, i) WHERE kept"""


def q_mention_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = ment.mentions(src.posts(spark, sf))
    return found.where(F.col("type").isin("percentage", "number")).groupBy("post_id").agg(
        F.count_if(F.col("type") == "percentage").alias("n_percentages"),
        F.round(F.coalesce(F.sum(F.when(F.col("type") == "percentage", F.col("value"))), num(0)), 4).alias("pct_sum"),
        F.count_if(F.col("type") == "number").alias("n_amounts"),
        F.round(F.coalesce(F.sum(F.when(F.col("type") == "number", F.col("value"))), num(0)), 4).alias("amount_sum"),
    )


_PCT = r"regexp_extract_all(text, '[+-]?[0-9]+(?:\.[0-9]+)?%')"
_AMT = rf"regexp_extract_all(text, '\$\s?[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?(?:\s?[KMBTkmbt](?:{NW}|$))?')"
SQL_MENTION_COUNTS = with_(POSTS, f"""f AS (
  SELECT post_id, list_transform({_PCT}, lambda p: replace(replace(p, '%', ''), '+', '')::DOUBLE) AS pcts,
    list_transform({_AMT}, lambda a: regexp_replace(a, '[^0-9.]', '', 'g').rtrim('.')::DOUBLE *
      CASE upper(regexp_extract(a, '([KMBTkmbt]){NW}?$', 1)) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9
      WHEN 'T' THEN 1e12 ELSE 1 END) AS amts FROM posts)""") + f"""
SELECT post_id, len(pcts)::BIGINT AS n_percentages, {rnd('coalesce(list_sum(pcts), 0)', 4, 'pct_sum')},
  len(amts)::BIGINT AS n_amounts, {rnd('coalesce(list_sum(amts), 0)', 4, 'amount_sum')}
FROM f WHERE len(pcts) + len(amts) > 0"""


# --- scores ------------------------------------------------------------------

def q_fear_greed_words(spark: SparkSession, sf: str) -> DataFrame:
    strict = lex.fear_greed_score(src.posts(spark, sf))
    both = lex.fear_greed_score(strict, match="substring", prefix="sub_")
    cols = [f"{p}_{f}" for p in ("fg", "sub") for f in lex.FIELDS]
    return round_columns(both.select("post_id", *cols), {c: 6 for c in cols})


def _word_score(table: dict[str, float], test) -> str:
    parts = " + ".join(f"CASE WHEN {test(w)} THEN {v} ELSE 0 END" for w, v in table.items())
    return f"least(({parts})::DOUBLE, 10) / 10"


def _fg_ctes(name: str, test, source: str) -> str:
    return f"""{name} AS (SELECT *, {_word_score(lex.GREED_WORDS, test)} AS {name}_up,
  {_word_score(lex.FEAR_WORDS, test)} AS {name}_dn FROM {source})"""


def _fg_fields(name: str, out: str) -> str:
    up, dn = f"{name}_up", f"{name}_dn"
    return ", ".join([rnd(up, 6, f"{out}_positive"), rnd(dn, 6, f"{out}_negative"),
                      rnd(f"(1 - greatest({up}, {dn}))", 6, f"{out}_neutral"),
                      rnd(f"({up} - {dn})", 6, f"{out}_compound"),
                      rnd(f"abs({up} - {dn})", 6, f"{out}_confidence")])


SQL_FEAR_GREED_WORDS = with_(
    POSTS, "lowered AS (SELECT post_id, lower(text) AS t FROM posts)", _fg_ctes("fg", lambda w: has_word("t", w), "lowered"),
    _fg_ctes("sub", lambda w: f"contains(t, '{w}')", "fg")) + f"""
SELECT post_id, {_fg_fields('fg', 'fg')}, {_fg_fields('sub', 'sub')} FROM sub"""


def valence_ctes(source: str, keys: str, name: str) -> list[str]:
    """CTE ``name`` with one row per lexicon hit of the texts of ``source``."""
    punct = literal(string.punctuation)
    bare = f"CASE WHEN trim(w, {punct}) = '' THEN w ELSE trim(w, {punct}) END"
    up, dn = _strings(lex.BOOSTERS_UP), _strings(lex.BOOSTERS_DOWN)

    def boost(k: int, factor: float) -> str:
        return (f"CASE WHEN replace(coalesce(b{k}, ''), '''', '') IN ({up}) THEN {lex.BOOST} "
                f"WHEN replace(coalesce(b{k}, ''), '''', '') IN ({dn}) THEN -{lex.BOOST} ELSE 0 END * {factor}")
    shift = " + ".join(boost(k, f) for k, f in zip((1, 2, 3), lex.DISTANCE))
    negated = " OR ".join(f"replace(coalesce(b{k}, ''), '''', '') IN ({_strings(lex.NEGATIONS)})" for k in (1, 2, 3))
    return [rf"""{name}_w AS (
  SELECT {keys}, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS nw,
    list_transform(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''), lambda w: {bare}) AS ws
  FROM {source})""", f"""{name}_p AS (
  SELECT {keys}, ws, unnest(generate_series(1, len(ws))) AS i FROM {name}_w)""", f"""{name}_n AS (
  SELECT {keys}, ws[i] AS token, CASE WHEN i > 1 THEN ws[i - 1] END AS b1, CASE WHEN i > 2 THEN ws[i - 2] END AS b2,
    CASE WHEN i > 3 THEN ws[i - 3] END AS b3 FROM {name}_p)""", f"""{name} AS (
  SELECT {keys}, (valence + sign(valence) * ({shift})) * CASE WHEN {negated} THEN {lex.NEGATE} ELSE 1 END AS v
  FROM {name}_n JOIN lexicon USING (token))"""]


_COMPOUND = "CASE WHEN total IS NOT NULL THEN least(greatest(total / sqrt(total * total + 15), -1), 1) END"
LEX_CTES = [*valence_ctes("posts", "post_id", "hits"), """sums AS (
  SELECT post_id, sum(v) AS total, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS up,
    sum(CASE WHEN v < 0 THEN v - 1 ELSE 0 END) AS dn, count(*) FILTER (v <> 0) AS n FROM hits GROUP BY 1)""",
    f"""parts AS (
  SELECT post_id, text, lang, coalesce({_COMPOUND}, 0) AS compound, coalesce(up, 0) AS up, abs(coalesce(dn, 0)) AS dn,
    (nw - coalesce(n, 0))::DOUBLE AS plain
  FROM posts JOIN hits_w USING (post_id) LEFT JOIN sums USING (post_id))""", """lexed AS (
  SELECT *, coalesce(up / nullif(up + dn + plain, 0), 0) AS positive, coalesce(dn / nullif(up + dn + plain, 0), 0) AS negative,
    coalesce(plain / nullif(up + dn + plain, 0), 1) AS neutral FROM parts)""", """lexscore AS (
  SELECT *, CASE WHEN trim(text) = '' THEN 0 ELSE greatest(positive, negative, neutral) END AS confidence FROM lexed)"""]


def q_lexicon_score(spark: SparkSession, sf: str) -> DataFrame:
    out = lex.lexicon_score(src.posts(spark, sf), src.lexicon(spark))
    return round_columns(out.select("post_id", *lex.FIELDS), {f: 9 for f in lex.FIELDS})


SQL_LEXICON_SCORE = with_(POSTS, LEX, *LEX_CTES) + f"""
SELECT post_id, {', '.join(rnd(f, 9) for f in lex.FIELDS)} FROM lexscore"""


def q_ensemble_score(spark: SparkSession, sf: str) -> DataFrame:
    out = lex.ensemble_score(src.posts(spark, sf), src.lexicon(spark))
    return round_columns(out.select("post_id", *lex.FIELDS), {f: 9 for f in lex.FIELDS})


_FG_LEX = [POSTS, LEX, *LEX_CTES, _fg_ctes("fg", lambda w: has_word("lower(text)", w), "lexscore")]
_BLEND = {"positive": "fg_up", "negative": "fg_dn", "neutral": "1 - greatest(fg_up, fg_dn)", "compound": "fg_up - fg_dn",
          "confidence": "abs(fg_up - fg_dn)"}
SQL_ENSEMBLE_SCORE = with_(*_FG_LEX) + "SELECT post_id, " + ", ".join(
    rnd(f"({f} * 0.7 + ({x}) * 0.3)", 9, f) for f, x in _BLEND.items()) + " FROM fg"


def _native_sql() -> tuple[str, str]:
    def side(i: int) -> str:
        cases = " ".join(
            f"WHEN '{lang}' THEN " + " + ".join(f"contains(text, '{w}')::INT" for w in lists[i])
            for lang, lists in lex.NATIVE_WORDS.items())
        return f"CASE lang {cases} ELSE 0 END"
    return side(0), side(1)


_UP, _DN = _native_sql()
NATIVE_CTES = [f"nat1 AS (SELECT *, {_UP} AS nu, {_DN} AS nd FROM lexscore)", """nat AS (
  SELECT *, coalesce((nu - nd) / nullif(nu + nd, 0)::DOUBLE, 0) AS native_score,
    least((nu + nd) / 5.0::DOUBLE, 1) AS native_confidence FROM nat1)""", """routed AS (
  SELECT *, lang IN ('zh-cn', 'ja', 'ko') AND native_confidence > 0.3 AS native FROM nat)""", """langs AS (
  SELECT *, CASE WHEN native THEN 'native' ELSE 'english' END AS route,
    CASE WHEN native THEN native_score ELSE compound END AS language_score,
    CASE WHEN native THEN native_confidence ELSE abs(compound) END AS language_confidence FROM routed)"""]


def q_native_score(spark: SparkSession, sf: str) -> DataFrame:
    out = lex.native_score(src.posts(spark, sf)).select("post_id", "lang", "native_score", "native_confidence")
    return round_columns(out, {"native_score": 6, "native_confidence": 6})


SQL_NATIVE_SCORE = with_(POSTS, LEX, *LEX_CTES, *NATIVE_CTES) + f"""
SELECT post_id, lang, {rnd('native_score')}, {rnd('native_confidence')} FROM nat"""


def q_route_language(spark: SparkSession, sf: str) -> DataFrame:
    out = lex.route_language(lex.lexicon_score(lex.native_score(src.posts(spark, sf)), src.lexicon(spark)))
    return round_columns(out.select("post_id", "lang", "route", "language_score", "language_confidence"),
                         {"language_score": 6, "language_confidence": 6})


SQL_ROUTE_LANGUAGE = with_(POSTS, LEX, *LEX_CTES, *NATIVE_CTES) + f"""
SELECT post_id, lang, route, {rnd('language_score')}, {rnd('language_confidence')} FROM langs"""


def q_sarcasm(spark: SparkSession, sf: str) -> DataFrame:
    out = lex.sarcasm(src.posts(spark, sf), src.lexicon(spark))
    return round_columns(
        out.select("post_id", "is_sarcastic", "sarcasm_confidence", "adjusted_sentiment",
                   F.array_join("sarcasm_indicators", ",").alias("indicators")),
        {"sarcasm_confidence": 6, "adjusted_sentiment": 6},
    )


def _any_word(words, min_hits: int = 1) -> str:
    parts = " + ".join(f"{has_word('t', w)}::INT" for w in words)
    return f"({parts}) >= {min_hits}"


_LABELS = [("contra > 0", "sentiment_contradiction"), ("shouts >= 3", "excessive_exclamation"),
           ("asks >= 2", "multiple_questions"), ("praise > 0", "quoted_positive"), ("phrases > 0", "sarcastic_phrase"),
           ("mild", "intensifier_with_mild_sentiment"), ("caps >= 2", "caps_words"), ("dots", "ellipsis"),
           ("hyper", "hyperbole"), ("rhet > 0", "rhetorical_question"), ("smile", "emoji_sentiment_mismatch")]
_PATTERN = ("least(0.3 * (shouts >= 3)::INT + 0.2 * (asks >= 2)::INT + 0.4 * praise + 0.5 * phrases + 0.3 * mild::INT"
            " + 0.2 * (caps >= 2)::INT + 0.1 * dots::INT, 1)")
SARCASM_CTES = [rf"""sent1 AS (
  SELECT post_id, generate_subscripts(s, 1) AS pos, unnest(s) AS text
  FROM (SELECT post_id, regexp_split_to_array(text, '[.!?]+') AS s FROM posts))""",
    r"sent AS (SELECT * FROM sent1 WHERE regexp_matches(text, '\S'))", *valence_ctes("sent", "post_id, pos", "sh"),
    "sc AS (SELECT post_id, pos, sum(v) AS total FROM sh GROUP BY 1, 2)", f"""ss AS (
  SELECT post_id, s, lead(s) OVER (PARTITION BY post_id ORDER BY pos) AS nx
  FROM (SELECT post_id, pos, coalesce({_COMPOUND}, 0) AS s FROM sent LEFT JOIN sc USING (post_id, pos)))""", """con AS (
  SELECT post_id, count(*) AS n, count(*) FILTER ((s > 0.3 AND nx < -0.3) OR (s < -0.3 AND nx > 0.3)) AS turns
  FROM ss GROUP BY 1)""", """quo AS (
  SELECT post_id, generate_subscripts(q, 1) AS pos, unnest(q) AS text
  FROM (SELECT post_id, regexp_extract_all(text, '["'']([^"'']+)["'']', 1) AS q FROM posts))""",
    *valence_ctes("quo", "post_id, pos", "qh"), f"""pr AS (
  SELECT post_id, count(*) AS praise
  FROM (SELECT post_id, pos, {_COMPOUND} AS c FROM (SELECT post_id, pos, sum(v) AS total FROM qh GROUP BY 1, 2))
  WHERE c > 0.3 GROUP BY 1)""", f"""m1 AS (
  SELECT post_id, text, lang, compound, lower(text) AS t, coalesce(praise, 0) AS praise,
    CASE WHEN n >= 2 AND turns / greatest(n - 1, 1)::DOUBLE > 0.5 THEN turns / greatest(n - 1, 1)::DOUBLE ELSE 0 END AS contra,
    length(regexp_replace(text, '[^!]', '', 'g')) AS shouts, length(regexp_replace(text, '[^?]', '', 'g')) AS asks,
    len(list_filter(regexp_extract_all(text, '{W}+'), lambda x: regexp_full_match(x, '[A-Z]{{2,}}'))) AS caps,
    contains(text, '...') AS dots, regexp_matches(text, '[{lex.SMILES}]') AND compound < -0.2 AS smile
  FROM lexscore LEFT JOIN con USING (post_id) LEFT JOIN pr USING (post_id))""", f"""m2 AS (
  SELECT *, {' + '.join(f"contains(t, '{p}')::INT" for p in lex.SARCASTIC)} AS phrases,
    {_any_word(lex.INTENSIFIERS)} AND abs(compound) < 0.3 AS mild, {_any_word(lex.HYPERBOLE, 2)} AS hyper,
    CASE WHEN contains(text, '?') THEN {' + '.join(f"regexp_matches(t, '{p}')::INT" for p in lex.RHETORICAL)}
      ELSE 0 END AS rhet FROM m1)""", f"""m3 AS (
  SELECT *, CASE WHEN length(trim(text)) >= 3 THEN least(contra * 0.4 + {_PATTERN} * 0.3
      + least(0.3 * hyper::INT + 0.4 * rhet + 0.4 * smile::INT, 1) * 0.3, 1) ELSE 0 END AS conf FROM m2)""", """sarc AS (
  SELECT *, conf > 0.5 AS is_sarcastic, CASE WHEN length(trim(text)) < 3 THEN 0 WHEN conf > 0.5 THEN -compound * conf
    ELSE compound END AS adjusted FROM m3)"""]
_INDICATORS = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {c} THEN '{n}' END" for c, n in _LABELS) + "], lambda x: x IS NOT NULL), ',') AS indicators"
SQL_SARCASM = with_(POSTS, LEX, *LEX_CTES, *SARCASM_CTES) + f"""
SELECT post_id, is_sarcastic, {rnd('conf', 6, 'sarcasm_confidence')}, {rnd('adjusted', 6, 'adjusted_sentiment')},
  {_INDICATORS} FROM sarc"""


def q_image_text_flags(spark: SparkSession, sf: str) -> DataFrame:
    scored = lex.lexicon_score(lex.image_text_flags(src.posts(spark, sf)), src.lexicon(spark))
    scored = scored.withColumn("colour", (F.col("post_id") % 9 - 4) / num(10))
    out = lex.image_text_sentiment(scored, "compound", "colour")
    return round_columns(out.select("post_id", "is_chart", "is_meme", "overall_sentiment", "image_confidence"),
                         {"overall_sentiment": 6, "image_confidence": 6})


def _any_part(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


SQL_IMAGE_TEXT_FLAGS = with_(POSTS, LEX, *LEX_CTES, rf"""i1 AS (
  SELECT post_id, text, compound, (post_id % 9 - 4) / 10.0::DOUBLE AS colour, {_any_part(lex.CHART_WORDS)} AS is_chart,
    {_any_part(lex.MEME_WORDS)} OR (length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) / greatest(length(text), 1)::DOUBLE > 0.7
      AND length(text) < 100) AS is_meme, length(trim(text)) > 0 AS has FROM lexscore)""", """i2 AS (
  SELECT *, least(greatest(CASE WHEN has THEN compound * 0.7 + colour * 0.3 ELSE colour END
      * CASE WHEN is_chart THEN 0.5 ELSE 1 END * CASE WHEN is_meme THEN 1.2 ELSE 1 END, -1), 1) AS overall,
    CASE WHEN has THEN 0.8 ELSE 0.3 END::DOUBLE AS sure FROM i1)""",
    "i3 AS (SELECT *, CASE WHEN is_meme THEN least(sure * 1.1, 1) ELSE sure END AS conf FROM i2)") + f"""
SELECT post_id, is_chart, is_meme, {rnd('overall', 6, 'overall_sentiment')}, {rnd('conf', 6, 'image_confidence')} FROM i3"""


# --- votes -------------------------------------------------------------------

VOTE_WEIGHTS = {"lexicon": 0.5, "words": 0.3, "emoji": 0.2}


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with three deterministic scores."""
    d = lex.native_score(lex.fear_greed_score(src.posts(spark, sf)))
    d = d.withColumn("emoji", tx.emoji_sentiment(F.col("text")))
    return materialise(lex.lexicon_score(d, src.lexicon(spark)), "scored")


MODELS = {"lexicon": "compound", "words": "fg_compound", "emoji": "emoji"}


def q_model_vote(spark: SparkSession, sf: str) -> DataFrame:
    rows = se.long_scores(_scored(spark, sf), MODELS)
    out = None
    for method in ("voting", "weighted", "confidence"):
        one = se.vote_models(rows, method, VOTE_WEIGHTS).withColumn("method", F.lit(method))
        out = one if out is None else out.unionByName(one)
    return round_columns(out, {"ensemble_score": 6, "confidence": 6})


VOTE_CTES = [*_FG_LEX, f"""sc3 AS (
  SELECT *, fg_up - fg_dn AS fgc,
    coalesce(({_hits(tx.POSITIVE_EMOJI)} - {_hits(tx.NEGATIVE_EMOJI)}) /
      nullif({_hits(tx.POSITIVE_EMOJI)} + {_hits(tx.NEGATIVE_EMOJI)}, 0)::DOUBLE, 0) AS emo FROM fg)""", """long3 AS (
  SELECT post_id, 1 AS place, 0.5::DOUBLE AS w, compound AS score FROM sc3
  UNION ALL SELECT post_id, 2, 0.3, fgc FROM sc3 UNION ALL SELECT post_id, 3, 0.2, emo FROM sc3)""", """lab AS (
  SELECT *, CASE WHEN score >= 0.05 THEN 'positive' WHEN score <= -0.05 THEN 'negative' ELSE 'neutral' END AS label,
    abs(score) AS conf FROM long3)""", """voting AS (
  SELECT post_id, count(*) AS n, count(*) FILTER (label = 'positive') AS np, count(*) FILTER (label = 'negative') AS nn,
    count(*) FILTER (label = 'neutral') AS n0, avg(score) FILTER (label = 'positive') AS sp,
    avg(score) FILTER (label = 'negative') AS sn, avg(score) FILTER (label = 'neutral') AS s0 FROM lab GROUP BY 1)""",
    """weighted AS (SELECT post_id, sum(score * w) / sum(w) AS s FROM lab GROUP BY 1)""", """best AS (
  SELECT post_id, first(score ORDER BY conf DESC, place) AS s, first(label ORDER BY conf DESC, place) AS l, max(conf) AS c
  FROM lab GROUP BY 1)""", """votes AS (
  SELECT post_id, 'voting' AS method,
    CASE WHEN np = greatest(np, nn, n0) THEN sp WHEN nn = greatest(np, nn, n0) THEN sn ELSE s0 END AS s,
    CASE WHEN np = greatest(np, nn, n0) THEN 'positive' WHEN nn = greatest(np, nn, n0) THEN 'negative'
      ELSE 'neutral' END AS l, greatest(np, nn, n0) / n::DOUBLE AS c FROM voting
  UNION ALL SELECT post_id, 'weighted', s, CASE WHEN s > 0.05 THEN 'positive' WHEN s < -0.05 THEN 'negative'
    ELSE 'neutral' END, least(abs(s), 1) FROM weighted
  UNION ALL SELECT post_id, 'confidence', CASE WHEN c > 0 THEN s ELSE 0 END, CASE WHEN c > 0 THEN l ELSE 'neutral' END, c
  FROM best)"""]
SQL_MODEL_VOTE = with_(*VOTE_CTES) + f"""
SELECT post_id, method, {rnd('s', 6, 'ensemble_score')}, l AS ensemble_label, {rnd('c', 6, 'confidence')} FROM votes"""


def q_hybrid_score(spark: SparkSession, sf: str) -> DataFrame:
    d = _scored(spark, sf).withColumn("model", F.when(F.col("lang") == "en", F.col("fg_compound")))
    out = se.hybrid_score(d, "model", "compound", "fg_confidence")
    return round_columns(out.select("post_id", "sentiment_score", "sentiment_confidence", "sentiment_method"),
                         {"sentiment_score": 6, "sentiment_confidence": 6})


SQL_HYBRID_SCORE = with_(*VOTE_CTES, """h AS (
  SELECT post_id, CASE WHEN lang = 'en' THEN fgc * 0.7 + compound * (1 - 0.7) ELSE compound END AS s,
    CASE WHEN lang = 'en' THEN abs(fgc) ELSE abs(compound) END AS c,
    CASE WHEN lang = 'en' THEN 'hybrid' ELSE 'lexicon_fallback' END AS sentiment_method FROM sc3)""") + f"""
SELECT post_id, {rnd('s', 6, 'sentiment_score')}, {rnd('c', 6, 'sentiment_confidence')}, sentiment_method FROM h"""


def q_enrich(spark: SparkSession, sf: str) -> DataFrame:
    scored = _scored(spark, sf)
    vote = se.vote_models(se.long_scores(scored, MODELS), "weighted", VOTE_WEIGHTS).select(
        "post_id", "ensemble_score", F.col("confidence").alias("ensemble_confidence"))
    flags = lex.sarcasm(src.posts(spark, sf), src.lexicon(spark)).select(
        "post_id", "is_sarcastic", "adjusted_sentiment")
    routed = lex.route_language(scored).withColumnRenamed("compound", "sentiment_score")
    out = se.enrich(routed.join(vote, "post_id").join(flags, "post_id"))
    return round_columns(out.select("post_id", "lang", "original_sentiment", "final_score", "final_stage"),
                         {"original_sentiment": 6, "final_score": 6})


SQL_ENRICH = with_(*VOTE_CTES, *NATIVE_CTES, *SARCASM_CTES, """e1 AS (
  SELECT l.post_id, l.lang, l.compound, s.is_sarcastic, s.adjusted, w.s AS es, least(abs(w.s), 1) AS ec, l.language_score
  FROM langs l JOIN sarc s USING (post_id) JOIN weighted w USING (post_id))""", """e2 AS (
  SELECT *, CASE WHEN lang <> 'en' THEN language_score WHEN ec > 0.8 THEN es WHEN is_sarcastic THEN adjusted
      ELSE compound END AS f,
    CASE WHEN lang <> 'en' THEN 'language' WHEN ec > 0.8 THEN 'ensemble' WHEN is_sarcastic THEN 'sarcasm'
      ELSE 'base' END AS final_stage FROM e1)""") + f"""
SELECT post_id, lang, {rnd('compound', 6, 'original_sentiment')}, {rnd('f', 6, 'final_score')}, final_stage FROM e2"""


QUERIES = {
    "clean_posts": (q_clean_posts, SQL_CLEAN_POSTS),
    "post_tokens": (q_post_tokens, SQL_POST_TOKENS),
    "clean_basic": (q_clean_basic, SQL_CLEAN_BASIC),
    "route_asset": (q_route_asset, SQL_ROUTE_ASSET),
    "dedupe_posts": (q_dedupe_posts, SQL_DEDUPE_POSTS),
    "mentions": (q_mentions, SQL_MENTIONS),
    "mention_summary": (q_mention_summary, SQL_MENTION_SUMMARY),
    "phrase_mentions": (q_phrase_mentions, SQL_PHRASE_MENTIONS),
    "mention_counts": (q_mention_counts, SQL_MENTION_COUNTS),
    "tag_text": (q_tag_text, SQL_TAG_TEXT),
    "fear_greed_words": (q_fear_greed_words, SQL_FEAR_GREED_WORDS),
    "lexicon_score": (q_lexicon_score, SQL_LEXICON_SCORE),
    "ensemble_score": (q_ensemble_score, SQL_ENSEMBLE_SCORE),
    "native_score": (q_native_score, SQL_NATIVE_SCORE),
    "route_language": (q_route_language, SQL_ROUTE_LANGUAGE),
    "sarcasm": (q_sarcasm, SQL_SARCASM),
    "image_text_flags": (q_image_text_flags, SQL_IMAGE_TEXT_FLAGS),
    "model_vote": (q_model_vote, SQL_MODEL_VOTE),
    "hybrid_score": (q_hybrid_score, SQL_HYBRID_SCORE),
    "enrich": (q_enrich, SQL_ENRICH),
}
