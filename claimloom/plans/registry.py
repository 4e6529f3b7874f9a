"""All queries over the given tables, by name, with their SQL."""

from __future__ import annotations

from claimloom.plans import citations, evidence, gold, ingest, lookups, outcomes, records, rollup, snapshots, splitting, workflow

_PLANS = (evidence, ingest, workflow, citations, records, lookups, outcomes, snapshots, splitting, gold, rollup)
QUERIES: dict = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
