"""Pieces of the check SQL: the adapter views as CTEs and rounding without -0.0."""

from __future__ import annotations

from marketpulse.sources.adapters import LEXICON, PHRASE_LANGS, PHRASES


def rnd(expr: str, digits: int = 6, name: str | None = None) -> str:
    """Rounded column; tiny negatives become 0.0, as in Spark."""
    name = name or expr
    half = 0.5 * 10.0 ** -digits
    return f"CASE WHEN abs({expr}) < {half:.{digits + 1}f} THEN 0.0 ELSE round({expr}, {digits}) END AS {name}"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


HOURLY = """hourly AS (
  SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""

DAILY = """daily AS (
  SELECT o_orderpriority AS symbol, o_orderdate::TIMESTAMP AS ts,
         first(o_totalprice ORDER BY o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         last(o_totalprice ORDER BY o_orderkey) AS close, sum(o_totalprice) AS volume
  FROM orders GROUP BY 1, 2)"""

SENTIMENT = """sentiment AS (
  SELECT event_id, user_id, ts, event_type AS asset,
         CASE user_id % 3 WHEN 0 THEN 'twitter' WHEN 1 THEN 'reddit' ELSE 'news' END AS source,
         CAST(json_extract_string(props, '$.k') AS INT) AS k,
         CAST(json_extract_string(props, '$.k') AS INT) / 50.0::DOUBLE - 1 AS score,
         (user_id * 7919) % 20000 AS followers, (user_id * 104729) % 3000 AS karma,
         user_id % 5 = 0 AS verified
  FROM events)"""

SENT_HOURLY = """sent_hourly AS (
  SELECT asset AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts,
         sum(k) / 50.0::DOUBLE / count(k) - 1 AS sentiment, count(*) AS posts,
         count(DISTINCT source) AS source_count
  FROM sentiment GROUP BY 1, 2)"""

PRICE_SENT = """price_sent AS (
  SELECT symbol, ts, close, volume, sentiment FROM hourly JOIN sent_hourly USING (symbol, ts))"""

_cases = " ".join(f"WHEN {i} THEN {literal(p)}" for i, p in enumerate(PHRASES))
_langs = " ".join(f"WHEN {i} THEN '{v}'" for i, v in PHRASE_LANGS.items())
POSTS = f"""posts AS (
  SELECT doc_id AS post_id, CASE doc_id % 12 {_langs} ELSE lang END AS lang, source,
         concat_ws(' ', CASE doc_id % 12 {_cases} END, text) AS text
  FROM documents)"""

_words = ", ".join(f"({literal(t)}, {v}::DOUBLE)" for t, v in LEXICON.items())
LEX = f"lexicon(token, valence) AS (VALUES {_words})"


def win(name: str = "w", by: str = "symbol", order: str = "ts") -> str:
    return f"{name} AS (PARTITION BY {by} ORDER BY {order})"


def strict(agg: str, x: str, n: int, by: str = "symbol", order: str = "ts") -> str:
    """agg(x) over n rows, NULL until n values are there."""
    f = f"OVER (PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {f} >= {n} THEN {agg}({x}) {f} END"


def lag(x: str, n: int = 1, by: str = "symbol", order: str = "ts") -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY {by} ORDER BY {order})"
