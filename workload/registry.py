"""All registered queries and their SQL."""

from __future__ import annotations

from workload import answers, evaluation, ingestion, reports, retrieval, streams, texts

MODULES = [retrieval, answers, evaluation, texts, ingestion, reports, streams]
QUERIES = {name: fn for module in MODULES for name, fn in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
