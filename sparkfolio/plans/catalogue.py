"""All core queries by name and their SQL."""

from __future__ import annotations

from sparkfolio.plans import checks, model, records, retrieval, tables

QUERIES: dict = {**retrieval.QUERIES, **checks.QUERIES, **model.QUERIES, **records.QUERIES, **tables.QUERIES}
SQL: dict[str, str] = {**retrieval.SQL, **checks.SQL, **model.SQL, **records.SQL, **tables.SQL}


def flagship(spark, sf_dir):
    return retrieval.bm25_topk(spark, sf_dir)
