"""All registered queries with their check SQL."""

from __future__ import annotations

from marketpulse.plans import crowds, evaluation, feeds, market, moods, regimes, stores, texts, trading

_ALL = {
    **market.QUERIES, **regimes.QUERIES, **texts.QUERIES, **moods.QUERIES, **trading.QUERIES, **crowds.QUERIES,
    **evaluation.QUERIES, **feeds.QUERIES, **stores.QUERIES,
}


def queries() -> dict:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
