"""Registered queries and their SQL."""

from __future__ import annotations

from tidemark.plans import checkup, discounted, evaluation, factors, filters, relational, rescreen, rolling, screener, shortlist, signals, simulation, statistics, strata, trees

FLAGSHIP = "factor_chain_pct60"
QUERIES: dict = {**relational.QUERIES, **rolling.QUERIES, **statistics.QUERIES, **simulation.QUERIES, **factors.QUERIES, **evaluation.QUERIES, **signals.QUERIES, **checkup.QUERIES, **trees.QUERIES, **screener.QUERIES, **filters.QUERIES, **discounted.QUERIES, **rescreen.QUERIES, **strata.QUERIES, **shortlist.QUERIES}
ORACLE_SQL: dict[str, str] = {**relational.ORACLE_SQL, **rolling.ORACLE_SQL, **statistics.ORACLE_SQL, **simulation.ORACLE_SQL, **factors.ORACLE_SQL, **evaluation.ORACLE_SQL, **signals.ORACLE_SQL, **checkup.ORACLE_SQL, **trees.ORACLE_SQL, **screener.ORACLE_SQL, **filters.ORACLE_SQL, **discounted.ORACLE_SQL, **rescreen.ORACLE_SQL, **strata.ORACLE_SQL, **shortlist.ORACLE_SQL}
