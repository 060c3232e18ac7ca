"""Budgeted contexts, prompts, extractive answers and their citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import col, strip
from sparkfolio.operators.documents import citation_label

BUDGET, PER_DOCUMENT, KEY = 1200, 2, 120
NOTHING = "I could not find supporting passages in the provided context."
#: What a live model is told.
INSTRUCTIONS = "Answer from the passages only, and cite the tag of the passage behind every statement."


def admit(rows: list[tuple[str, str, int]], budget: int = BUDGET, per_document: int = PER_DOCUMENT, key: int = KEY) -> list[int]:
    """Places of the passages (document, text, tokens) that are admitted, in their order.

    A passage is passed over if an admitted one begins with the same `key` characters, or if its document has its share; the first that
    doesn't fit the budget ends the context, unless it would be the only one.
    """
    seen: set[str] = set()
    per: dict[str, int] = {}
    used, out = 0, []
    for i, (doc, text, tokens) in enumerate(rows):
        head = text[:key]
        if head in seen or per.get(doc, 0) >= per_document:
            continue
        if out and used + tokens > budget:
            break
        out.append(i)
        seen.add(head)
        per[doc] = per.get(doc, 0) + 1
        used += tokens
    return out


def build_context(ranked: DataFrame, budget: int = BUDGET, per_document: int = PER_DOCUMENT) -> DataFrame:
    """Rows (query_id, position, rank, chunk_id, document_id, text, tokens) of ranked passages without position: exactly admit().

    A query's shortlist is bounded by the retrieval depth and comes to one task.
    """
    names = ["query_id", "rank", "chunk_id", "document_id", "text", "tokens"]
    kinds = {f.name: f.dataType.simpleString() for f in ranked.schema}

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank", kind="stable").reset_index(drop=True)
        keep = admit(list(zip(g["document_id"], g["text"].fillna(""), g["tokens"].fillna(0).astype(int))), budget, per_document)
        return g.iloc[keep].assign(position=range(1, len(keep) + 1))[["position", *names]]

    return ranked.select(*names).groupBy("query_id").applyInPandas(one, "position int, " + ", ".join(f"{n} {kinds[n]}" for n in names)).select("query_id", "position", *names[1:])


def build_context_sql(ranked: DataFrame, budget: int = BUDGET, per_document: int = PER_DOCUMENT) -> DataFrame:
    """The same by windows: first of each beginning, then the share of each document, then the running budget.

    It differs from build_context() only where a passage that its document's share keeps out has the beginning of a later one.
    """
    q = Window.partitionBy("query_id")
    d = ranked.withColumn("n", F.row_number().over(Window.partitionBy("query_id", F.substring("text", 1, KEY)).orderBy("rank"))).where("n = 1")
    d = d.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("rank"))).where(F.col("n") <= per_document)
    d = d.withColumn("used", F.sum("tokens").over(q.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))).withColumn("position", F.row_number().over(q.orderBy("rank")))
    return d.where((F.col("used") <= budget) | (F.col("position") == 1)).select("query_id", "position", "rank", "chunk_id", "document_id", "text", "tokens")


def label(passages: DataFrame) -> Column:
    have = passages.columns
    return citation_label("document_id", "section" if "section" in have else F.lit(None).cast("string"), "claim_number" if "claim_number" in have else F.lit(None).cast("int"), "chunk_id")


def prompts(passages: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (query_id, prompt): the labelled passages of each query in order, then the question."""
    block = F.concat(label(passages), F.lit("\n"), "text")
    blocks = passages.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", block.alias("b")))).alias("p"))
    text = F.concat(F.lit("Context:\n\n"), F.array_join("p.b", "\n\n"), F.lit("\n\nQuestion: "), "query", F.lit("\nAnswer:"))
    return blocks.join(queries, "query_id").select("query_id", text.alias("prompt"))


def first_sentence(text) -> Column:
    """The first sentence, cut to 317 characters and three points if it has 320 or more."""
    s = F.get(F.split(strip(text), r"(?<=[.!?])\s+"), F.lit(0))
    return F.when(F.length(s) < 320, s).otherwise(F.concat(F.substring(s, 1, 317), F.lit("...")))


def extractive_answers(passages: DataFrame, queries: DataFrame, most: int = 2) -> DataFrame:
    """Rows (query_id, answer): the first sentences of the first passages, each with its tag. It works on passages, not on a prompt."""
    part = F.concat(first_sentence("text"), F.lit(" "), label(passages))
    said = passages.where(F.col("position") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", part.alias("t")))).alias("p"))
    return queries.join(said, "query_id", "left").select("query_id", F.coalesce(F.array_join("p.t", " "), F.lit(NOTHING)).alias("answer"))


def complete(prompts: DataFrame, provider: Callable[[], Callable[[str, str], str]]) -> DataFrame:
    """Rows (query_id, answer) from a live model: provider() is called once per task and answers (prompt, instructions)."""
    kind = prompts.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = provider()
        for b in batches:
            yield pd.DataFrame({"query_id": b["query_id"], "answer": [ask(p, INSTRUCTIONS) for p in b["prompt"]]})

    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, answer string")


def citations(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """Rows (query_id, position, chunk_id, document_id): the passages whose tags an answer has, once each, in the order of the tags."""
    tags = F.regexp_extract_all("answer", F.lit(r"\[PATENT=[^\]]*CHUNK=([A-Za-z0-9]+)[^\]]*\]"), F.lit(1))
    cited = answers.select("query_id", F.posexplode(F.array_distinct(tags)).alias("pos", "chunk_id"))
    hit = cited.join(passages.select("query_id", "chunk_id", "document_id").distinct(), ["query_id", "chunk_id"])
    at = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return hit.select("query_id", at.alias("position"), "chunk_id", "document_id")


def without_tags(answer) -> Column:
    return F.trim(F.replace(F.regexp_replace(col(answer), r"\[PATENT=[^\]]+\]", ""), F.lit("  "), F.lit(" ")))


def answer_confidence(n_citations) -> Column:
    n = col(n_citations)
    return F.when(n > 0, F.least(F.lit(1.0), 0.4 + 0.2 * n)).otherwise(0.1)


def checked_confidence(groundedness, valid, cited) -> Column:
    """Half the share of supported sentences, half the share of valid citations; three places."""
    return F.bround(0.5 * col(groundedness) + 0.5 * (col(valid) / F.greatest(F.lit(1), col(cited))), 3)


def provenance(cited: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Rows (query_id, chunk_id, resolved, document_id, section, claim_number, norm_start, norm_end, recovered) of cited (query_id, chunk_id).

    recovered: the first 160 characters of the section's text that the offsets span, for chunks that are no claims.
    """
    c = chunks.select("chunk_id", "document_id", "section", "claim_number", "norm_start", "norm_end").dropDuplicates(["chunk_id"])
    s = sections.select(F.col("section_id").alias("section"), F.col("text").alias("section_text")).dropDuplicates(["section"])
    j = cited.join(c, "chunk_id", "left").join(s, "section", "left")
    cut = F.substring(F.col("section_text").substr(F.col("norm_start") + 1, F.col("norm_end") - F.col("norm_start")), 1, 160)
    return j.select(
        "query_id", "chunk_id", F.col("document_id").isNotNull().alias("resolved"), "document_id", "section", "claim_number", "norm_start", "norm_end",
        F.when(F.col("claim_number").isNull(), cut).alias("recovered"),
    )
