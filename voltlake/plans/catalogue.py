"""All queries of the core with their SQL."""

from __future__ import annotations

from voltlake.plans import etl, memory, pages, prompts, quality, records, retrieval

PARTS = (retrieval, quality, memory, etl, prompts, pages, records)
QUERIES = {k: f for p in PARTS for k, f in p.QUERIES.items()}
SQL = {k: s for p in PARTS for k, s in p.SQL.items()}
