"""Rank fusion, metadata filters and reranking over runs (query_id, rank, key)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import jaccard, tokenize


def reciprocal_rank_fusion(runs: list[DataFrame], key: str, k: int = 60, weights: list[float] | None = None, keep: int | None = None) -> DataFrame:
    """Rows (query_id, rank, key, score) with score = sum over the runs of weight / (k + rank).

    A key that a run ranks twice counts twice. Runs beyond the given weights are left out. One aggregation, whatever the number of runs.
    """
    weights = weights if weights is not None else [1.0] * len(runs)
    parts = [r.select("query_id", key, (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for r, w in zip(runs, weights)]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    s = u.groupBy("query_id", key).agg(F.round(F.sum("part"), 9).alias("score"))
    out = s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return (out.where(F.col("rank") <= keep) if keep else out).select("query_id", "rank", key, "score")


def metadata_filter(cpc_section: str | None = None, language: str | None = None, section_kind: str | None = None, min_year: int | None = None) -> Column:
    """A predicate over cpc (array), lang, section_kind and publication_date; empty arguments don't filter.

    A null attribute fails a filter on it.
    """
    p = F.lit(True)
    if cpc_section:
        p &= F.exists(F.coalesce("cpc", F.array().cast("array<string>")), lambda c: c.startswith(cpc_section))
    if language:
        p &= F.col("lang") == language
    if section_kind:
        p &= F.col("section_kind") == section_kind
    if min_year:
        p &= F.year("publication_date") >= min_year
    return F.coalesce(p, F.lit(False))


def post_filter(run: DataFrame, key: str, attributes: DataFrame, predicate: Column, k: int) -> DataFrame:
    """The first k of each query that fulfil the predicate, in the order of the run; there may be fewer. Ranks are counted anew."""
    kept = run.join(attributes, key).where(predicate)
    new = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("new_rank", new).where(F.col("new_rank") <= k).select("query_id", F.col("new_rank").alias("rank"), key, "score")


def documents_of(run: DataFrame, key: str, chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """Rows (query_id, rank, document): documents by their first chunk in the run."""
    first = run.join(chunks.select(key, document), key).groupBy("query_id", document).agg(F.min("rank").alias("first"))
    return first.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("first", document)).alias("rank"), document)


def lexical_score(query, text) -> Column:
    """The default reranker: the share of the query's tokens in the text, plus their Jaccard likeness as a tie break."""
    q, t = F.array_distinct(tokenize(query)), F.array_distinct(tokenize(text))
    share = F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))
    return share + 0.1 * jaccard(q, t)


def rerank(shortlist: DataFrame, key: str, keep: int | None = None, scorer: Callable[[list[str], list[str]], list[float]] | None = None) -> DataFrame:
    """Rows (query_id, rank, key, score) of a shortlist (query_id, query, key, text), best first.

    `scorer` scores pairs of query and text in batches (a cross-encoder, loaded once per task); the default is lexical_score(). keep None or
    0 keeps all.
    """
    if scorer is None:
        s = shortlist.select("query_id", key, F.round(lexical_score("query", "text"), 6).alias("score"))
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"query_id": b["query_id"], key: b[key], "score": scorer(b["query"].tolist(), b["text"].tolist())})

        kinds = {f.name: f.dataType.simpleString() for f in shortlist.schema}
        s = shortlist.select("query_id", "query", key, "text").mapInPandas(run, f"query_id {kinds['query_id']}, {key} {kinds[key]}, score double")
    out = s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return (out.where(F.col("rank") <= keep) if keep else out).select("query_id", "rank", key, "score")
