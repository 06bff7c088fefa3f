"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from groundwell.llm import queries, sql

QUERIES = queries.QUERIES | {"pipeline": corpus_pipeline.run}
ORACLE = sql.ORACLE | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
