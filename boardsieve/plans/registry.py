"""All registered queries and their SQL texts."""

from __future__ import annotations

from boardsieve.plans import ledger_queries, oracle_ledger, oracle_rules, oracle_sources, rule_queries, source_queries, stream_queries


def queries() -> dict:
    return {**source_queries.QUERIES, **rule_queries.QUERIES, **ledger_queries.QUERIES,
            **stream_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**oracle_sources.SQL, **oracle_rules.SQL, **oracle_ledger.SQL, **stream_queries.SQL}
