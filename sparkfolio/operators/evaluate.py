"""Retrieval, answer and agent metrics: one plan over all queries and configurations.

A run has (config, query_id, rank, doc); qrels have (query_id, doc, gain). A query without a hit counts with 0, so averages are over the topics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f1(p, r) -> Column:
    return F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def query_metrics(runs: DataFrame, qrels: DataFrame, doc: str, ks: tuple[int, ...] = (5, 10), ndcg_at: int = 10) -> DataFrame:
    """Rows (config, query_id, p_at_k..., r_at_k..., rr, ndcg).

    Precision divides by k even if fewer came; recall without a relevant document is 1. DCG discounts by log2(rank + 1).
    """
    # one row per relevant document, ranked for the ideal; the number of them per query comes along
    by_gain = Window.partitionBy("query_id").orderBy(F.desc("gain"), doc)
    ideal = qrels.withColumn("ideal_rank", F.row_number().over(by_gain))
    per_query = ideal.groupBy("query_id").agg(
        F.count("*").alias("relevant"), F.sum(F.when(F.col("ideal_rank") <= ndcg_at, F.col("gain") / F.log2(F.col("ideal_rank") + 1))).alias("idcg")
    )
    hit = F.col("gain").isNotNull()
    judged = runs.join(qrels.select("query_id", doc, "gain"), ["query_id", doc], "left")
    found = judged.groupBy("config", "query_id").agg(
        *[F.sum(F.when(hit & (F.col("rank") <= k), 1).otherwise(0)).alias(f"hits_{k}") for k in ks],
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        F.sum(F.when(hit & (F.col("rank") <= ndcg_at), F.col("gain") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    every = runs.select("config").distinct().crossJoin(F.broadcast(per_query))  # configurations are few
    m = every.join(found, ["config", "query_id"], "left")
    hits = {k: F.coalesce(f"hits_{k}", F.lit(0)) for k in ks}
    return m.select(
        "config",
        "query_id",
        *[(hits[k] / k).alias(f"p_at_{k}") for k in ks],
        *[F.when(F.col("relevant") == 0, 1.0).otherwise(hits[k] / F.col("relevant")).alias(f"r_at_{k}") for k in ks],
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
        F.when(F.coalesce("idcg", F.lit(0.0)) == 0, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"),
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means over the queries of each configuration (an ablation table)."""
    names = [c for c in metrics.columns if c not in ("config", "query_id")]
    return metrics.groupBy("config").agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias("mrr" if c == "rr" else c) for c in names])


def confusion(df: DataFrame, truth, predicted) -> DataFrame:
    """One row: tp, tn, fp, fn, precision, recall, f1, false_positive_rate (over all rows) and over_refusal_rate (over the negatives)."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    c = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))

    def share(a, b):
        return F.when(b == 0, 0.0).otherwise(a / b)

    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    prec, rec = share(tp, tp + fp), share(tp, tp + fn)
    return c.select(
        "*",
        F.round(prec, 6).alias("precision"),
        F.round(rec, 6).alias("recall"),
        F.round(f1(prec, rec), 6).alias("f1"),
        F.round(share(fp, tp + tn + fp + fn), 6).alias("false_positive_rate"),
        F.round(share(fp, F.greatest(F.lit(1), fp + tn)), 6).alias("over_refusal_rate"),
    )


def multiset_common(a, b) -> Column:
    """Size of the common part of two arrays as multisets."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))


def tool_precision_recall(predicted, gold) -> tuple[Column, Column, Column]:
    """(precision, recall, f1) of predicted tool names against the wanted ones, as multisets."""
    common = multiset_common(predicted, gold)
    p, r = common / F.greatest(F.lit(1), F.size(predicted)), common / F.greatest(F.lit(1), F.size(gold))
    return p, r, f1(p, r)


def argument_correctness(predicted, gold) -> Column:
    """Share of the wanted arguments that stand at the same place among the predicted; 1 if none are wanted."""
    same = F.size(F.filter(F.zip_with(predicted, gold, lambda x, y: x.isNotNull() & y.isNotNull() & (x == y)), lambda x: x))
    return F.when(F.size(gold) == 0, 1.0).otherwise(same / F.size(gold))


def trajectory_match(predicted, gold, mode: str = "exact") -> Column:
    """Whether two tool sequences are the same: exact, unordered (as multisets), or subset (all wanted ones occur)."""
    if mode == "exact":
        return predicted == gold
    if mode == "unordered":
        return F.array_sort(predicted) == F.array_sort(gold)
    if mode == "subset":
        return F.size(F.array_except(gold, predicted)) == 0
    raise ValueError(mode)


def context_precision(retrieved, relevant) -> Column:
    """Share of the retrieved documents, repeats counted, that are relevant; 0 if none came."""
    return F.when(F.size(retrieved) == 0, 0.0).otherwise(F.size(F.filter(retrieved, lambda d: F.array_contains(relevant, d))) / F.size(retrieved))


def context_recall(retrieved, relevant) -> Column:
    """Share of the relevant documents that came; 1 if none are relevant."""
    return F.when(F.size(relevant) == 0, 1.0).otherwise(F.size(F.array_intersect(retrieved, relevant)) / F.size(F.array_distinct(relevant)))


def present_gold(gold: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """The rows of `gold` (query_id, key) whose document is there; queries that have none left are gone."""
    return gold.join(docs.select(key).distinct(), key, "left_semi")


def judge_score(text) -> Column:
    """The number `score` of the first JSON object in a judge's reply; 0 if there is none. Any number of JSON counts, with exponents too."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(F.get_json_object(F.when(found != "", found), "$.score").try_cast("double"), F.lit(0.0))


def index_recall(approximate: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """Rows (query_id, recall): the share of the exact neighbours that the index found too; 1 where there are none."""
    n = exact.groupBy("query_id").agg(F.count("*").alias("wanted"))
    both = approximate.select("query_id", key).distinct().join(exact.select("query_id", key), ["query_id", key]).groupBy("query_id").agg(F.count("*").alias("common"))
    return n.join(both, "query_id", "left").select("query_id", F.when(F.col("wanted") == 0, 1.0).otherwise(F.coalesce("common", F.lit(0)) / F.col("wanted")).alias("recall"))


def latency_percentiles(df: DataFrame, group: str, value: str, accuracy: int | None = None) -> DataFrame:
    """Rows (group, n, p50, p95) with linear interpolation between the nearest values.

    The exact percentiles keep the distinct values of a group together. `accuracy`: take values of a sketch instead, whose ranks are off by n / accuracy
    at most and whose size doesn't grow with the group.
    """
    if accuracy:
        p = [F.percentile_approx(value, q, accuracy).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"))]
    else:
        p = [F.round(F.percentile(value, F.lit(q)), 6).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"))]
    return df.groupBy(group).agg(F.count(value).alias("n"), *p)
