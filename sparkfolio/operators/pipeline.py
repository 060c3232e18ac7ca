"""The guarded pipeline from queries to checked answers, over a batch of queries, with a trace of its stages; and lazy stages."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.text import estimate_tokens
from sparkfolio.operators import context, guards
from sparkfolio.operators.fusion import reciprocal_rank_fusion, rerank
from sparkfolio.operators.sparse import bm25, tfidf
from sparkfolio.session import cut

#: Depths of the cascade: candidates per retriever, of the shortlist, and the factors of top_k kept by the reranker and the context.
CANDIDATES, SHORTLIST, RERANKED, IN_CONTEXT = 40, 30, 3, 2


def input_guards(queries: DataFrame, check_scope: bool = True) -> DataFrame:
    """`queries` with blocked and reason; the first of injection, unsafe content and scope gives the reason."""
    reason = F.when(F.size(guards.injection_hits("query")) > 0, "prompt_injection").when(F.size(guards.unsafe_terms("query")) > 0, "unsafe_content")
    if check_scope:
        reason = reason.when(guards.scope_blocked("query"), "out_of_scope")
    return queries.withColumn("reason", F.coalesce(reason, F.lit(""))).withColumn("blocked", F.col("reason") != "")


class Pipeline:
    """Chunks (chunk_id, document_id, text, section, claim_number, norm_start, norm_end) and documents (document_id, access_level).

    `dense(queries, k)` gives a run (query_id, rank, chunk_id); without it a second sparse run takes its place. `provider` is a live model's,
    see context.complete(); without it answers are extracts.
    """

    def __init__(self, chunks: DataFrame, documents: DataFrame, role: str = "researcher", dense: Callable | None = None, provider: Callable | None = None):
        self.chunks, self.documents, self.role, self.dense, self.provider = chunks, documents, role, dense, provider
        self.spans: list[tuple[str, float]] = []

    def _timed(self, stage: str, df: DataFrame) -> DataFrame:
        """Materialise a stage, which is small (queries times depth), and note how long it took."""
        t = time.perf_counter()
        out = cut(df)
        self.spans.append((stage, (time.perf_counter() - t) * 1000))
        return out

    def run(self, queries: DataFrame, top_k: int = 5, use_reranker: bool = True, check_scope: bool = True) -> DataFrame:
        """Rows (query_id, blocked, reason, answer, citations, valid_citations, groundedness, confidence); blocked queries go no further."""
        checked = self._timed("input_guards", input_guards(queries, check_scope))
        asked = checked.where("not blocked").select("query_id", "query")
        sparse = self._timed("sparse_retrieval", bm25(self.chunks, "chunk_id", "text", asked, CANDIDATES))
        other = self.dense(asked, CANDIDATES) if self.dense else tfidf(self.chunks, "chunk_id", "text", asked, CANDIDATES)
        fused = self._timed("fusion", reciprocal_rank_fusion([sparse, other], "chunk_id", keep=SHORTLIST))
        have = self.chunks.select("chunk_id", "document_id", "text", "section", "claim_number")
        short = fused.join(have, "chunk_id").join(asked, "query_id")
        if use_reranker:
            ranked = rerank(short.select("query_id", "query", "chunk_id", "text"), "chunk_id", keep=RERANKED * top_k)
        else:
            ranked = fused.where(F.col("rank") <= RERANKED * top_k)
        ranked = self._timed("rerank", ranked)
        readable = self.documents.where(guards.may_read("access_level", F.lit(self.role))).select("document_id").distinct()
        open_ = ranked.join(have, "chunk_id").join(readable, "document_id", "left_semi")
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        open_ = self._timed("authorization", open_.withColumn("rank", place).where(F.col("rank") <= IN_CONTEXT * top_k))
        passages = context.build_context(open_.withColumn("tokens", estimate_tokens("text")))
        passages = self._timed("context", passages.join(have.select("chunk_id", "section", "claim_number"), "chunk_id"))
        answers = context.complete(context.prompts(passages, asked), self.provider) if self.provider else context.extractive_answers(passages, asked)
        answers = self._timed("generation", answers)
        cited = self._timed("citations", context.citations(answers, passages))
        ground = guards.supported_sentences(answers, cited.join(have.select("chunk_id", "text"), "chunk_id").select("query_id", "text"), "query_id")
        valid = guards.verify_citations(cited, open_, self.chunks).groupBy("query_id").agg(F.count("*").alias("citations"), F.count_if("valid").alias("valid_citations"))
        out = checked.select("query_id", "blocked", "reason").join(answers, "query_id", "left").join(valid, "query_id", "left")
        out = out.join(ground.select("query_id", F.col("score").alias("groundedness")), "query_id", "left").fillna(0, ["citations", "valid_citations"])
        confidence = context.checked_confidence("groundedness", "valid_citations", "citations")
        return self._timed("output_guards", out.withColumn("confidence", F.when(~F.col("blocked"), confidence)).withColumn("output_unsafe", F.size(guards.unsafe_terms("answer")) > 0))

    def trace(self) -> DataFrame:
        """Rows (seq, stage, latency_ms) of the last run."""
        rows = [(i, s, round(ms, 1)) for i, (s, ms) in enumerate(self.spans)]
        return self.chunks.sparkSession.createDataFrame(rows, "seq int, stage string, latency_ms double")


def trace_json(spans: DataFrame, trace: str, stage: str, latency: str, data: str) -> DataFrame:
    """Rows (trace, total_ms, doc): each trace as JSON, its spans in order of `seq` with their data flattened into them."""
    span = F.map_concat(F.create_map(F.lit("stage"), F.col(stage), F.lit("latency_ms"), F.round(latency, 1).cast("string")), F.col(data))
    g = spans.groupBy(trace).agg(F.round(F.sum(latency), 1).alias("total_ms"), F.array_sort(F.collect_list(F.struct("seq", F.to_json(span).alias("j")))).alias("s"))
    return g.select(trace, "total_ms", F.concat(F.lit('{"total_ms":'), F.col("total_ms").cast("string"), F.lit(',"spans":['), F.array_join("s.j", ","), F.lit("]}")).alias("doc"))


class Stages:
    """Named lazily built tables with their dependencies, kept as Parquet below a folder and built at most once per version."""

    def __init__(self, spark, folder: str, version: str = "1"):
        self.spark, self.folder, self.version = spark, folder, version
        self._builders: dict[str, tuple[tuple[str, ...], Callable]] = {}

    def register(self, name: str, needs: tuple[str, ...], build: Callable) -> None:
        """`build` gets the needed tables in order and returns a DataFrame."""
        self._builders[name] = (needs, build)

    def order(self, upto: str) -> list[str]:
        """Stages in the order in which they can be built; ValueError for an unknown stage or a circle."""
        out: list[str] = []
        open_: set[str] = set()

        def visit(n: str) -> None:
            if n in out:
                return
            if n in open_ or n not in self._builders:
                raise ValueError(f"stage {n!r} is " + ("part of a circle" if n in open_ else "unknown"))
            open_.add(n)
            for d in self._builders[n][0]:
                visit(d)
            open_.discard(n)
            out.append(n)

        visit(upto)
        return out

    def path(self, name: str) -> str:
        return f"{self.folder}/v{self.version}/{name}"

    def has(self, name: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def ensure(self, upto: str, rebuild: bool = False) -> DataFrame:
        for n in self.order(upto):
            if rebuild or not self.has(n):
                needs, build = self._builders[n]
                build(*(self.spark.read.parquet(self.path(d)) for d in needs)).write.mode("overwrite").parquet(self.path(n))
        return self.spark.read.parquet(self.path(upto))


