"""Registered queries of the reference's operators, with their DuckDB oracles."""

from __future__ import annotations

from attestor.plans import evidence_queries, knowledge_queries, record_queries, retrieval_queries

QUERIES = {**retrieval_queries.QUERIES, **evidence_queries.QUERIES, **record_queries.QUERIES, **knowledge_queries.QUERIES}
ORACLES = {**retrieval_queries.ORACLES, **evidence_queries.ORACLES, **record_queries.ORACLES, **knowledge_queries.ORACLES}
