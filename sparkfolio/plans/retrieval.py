"""Queries over the search operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.functions import text as tx
from sparkfolio.operators import blockwise, context, evaluate, fusion, guards, sparse, vectors
from sparkfolio.session import cut, spread, table

#: The queries asked of documents and of chunks.
ASKED = (
    (1, "magnetic electrode keeps a ratio stable"),
    (2, "pump pump valve cooling"),
    (3, "Wärmetauscher flexible Übertragung"),
    (4, "search report D1 gear"),
    (5, "non-volatile dictionary byte-level cache"),
    (6, "unknownword"),
    (7, "dispositivo óptico célula"),
)
_VALUES = ", ".join(f"({i}, '{q}')" for i, q in ASKED)
_TOK = r"regexp_extract_all(lower({}), '[a-z0-9]+(?:[./-][a-z0-9]+)*')"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ASKED), "query_id int, query string")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def tokenize_counts(spark, sf_dir):
    t = tx.tokenize("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n"), F.get(t, F.lit(0)).alias("first"), F.element_at(F.when(F.size(t) > 0, t), -1).alias("last"))


def token_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", tx.estimate_tokens("text").cast("long").alias("n"))


def sentence_counts(spark, sf_dir):
    s = tx.sentences("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n"), F.aggregate(s, F.lit(0), lambda a, x: F.greatest(a, F.length(x))).cast("long").alias("longest"))


def paragraph_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(tx.paragraphs("text")).cast("long").alias("n"), tx.word_count("text").cast("long").alias("words"))


def fixed_window_chunks(spark, sf_dir):
    w = _docs(spark, sf_dir).select("doc_id", F.posexplode(tx.fixed_windows(tx.tokenize("text"), 180, 20)).alias("seq", "piece"))
    return w.select("doc_id", "seq", tx.stable_chunk_id("doc_id", F.lit("window"), "seq", "piece").alias("chunk_id"), F.length("piece").cast("long").alias("n_chars"))


def postings(spark, sf_dir):
    p = sparse.postings(_docs(spark, sf_dir), "doc_id", "text")
    return p.select("term", "doc_id", "tf", F.get("positions", F.lit(0)).cast("long").alias("first"), F.element_at("positions", -1).cast("long").alias("last"))


def document_frequency(spark, sf_dir):
    return sparse.document_frequency(_docs(spark, sf_dir), "doc_id", "text")


def boolean_and(spark, sf_dir):
    return sparse.boolean_and(_docs(spark, sf_dir), "doc_id", "text", "magnetic", "Electrode array", "!", "stable")


def bm25_topk(spark, sf_dir):
    return sparse.bm25(_docs(spark, sf_dir), "doc_id", "text", asked(spark))


def bm25_okapi_topk(spark, sf_dir):
    """The SQL takes the mean idf over the query terms only; here it is over all terms, so the scores of common terms differ."""
    return sparse.bm25(_docs(spark, sf_dir), "doc_id", "text", asked(spark), idf="okapi")


def tfidf_topk(spark, sf_dir):
    return sparse.tfidf(_docs(spark, sf_dir), "doc_id", "text", asked(spark))


def bm25_prefiltered(spark, sf_dir):
    """The universe is filtered first, so the statistics are those of what is left."""
    return sparse.bm25(_docs(spark, sf_dir).where(fusion.metadata_filter(language="de")), "doc_id", "text", asked(spark))


def bm25_postfiltered(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    run = sparse.bm25(docs, "doc_id", "text", asked(spark), k=30)
    return fusion.post_filter(run, "doc_id", docs.select("doc_id", "lang"), fusion.metadata_filter(language="de"), 10)


def rrf_fusion(spark, sf_dir):
    found = cut(sparse.matches(_docs(spark, sf_dir), "doc_id", "text", asked(spark)))
    runs = [sparse.bm25_of(found, "doc_id", 40), sparse.tfidf_of(found, "doc_id", 40)]
    return fusion.reciprocal_rank_fusion(runs, "doc_id", weights=[1.0, 0.5], keep=10)


def _chunks(spark, sf_dir):
    return spread(table(spark, sf_dir, "chunks"))


def chunk_run(spark, sf_dir):
    return sparse.bm25(_chunks(spark, sf_dir), "chunk_id", "text", asked(spark), 50)


def chunk_documents(spark, sf_dir):
    return fusion.documents_of(chunk_run(spark, sf_dir), "chunk_id", _chunks(spark, sf_dir))


def chunk_rerank(spark, sf_dir):
    short = chunk_run(spark, sf_dir).where("rank <= 30").join(_chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id").join(asked(spark), "query_id")
    return fusion.rerank(short, "chunk_id", keep=15)


def _shortlist(spark, sf_dir):
    c = _chunks(spark, sf_dir).select("chunk_id", "document_id", "text", "section", "claim_number", F.col("token_estimate").alias("tokens"))
    return cut(chunk_run(spark, sf_dir).where("rank <= 30").join(c, "chunk_id"))


def context_budget(spark, sf_dir):
    return context.build_context_sql(_shortlist(spark, sf_dir), budget=600).select("query_id", "position", "rank", "chunk_id", "document_id", "tokens")


def context_exact(spark, sf_dir):
    return context.build_context(_shortlist(spark, sf_dir), budget=600).select("query_id", "position", "rank", "chunk_id", "document_id", "tokens")


def _passages(spark, sf_dir):
    s = _shortlist(spark, sf_dir)
    return cut(context.build_context(s, budget=600).join(s.select("query_id", "chunk_id", "section", "claim_number"), ["query_id", "chunk_id"]))


def context_prompts(spark, sf_dir):
    return context.prompts(_passages(spark, sf_dir), asked(spark))


def extractive_answers(spark, sf_dir):
    p = _passages(spark, sf_dir)
    a = context.extractive_answers(p, asked(spark))
    n = context.citations(a, p).groupBy("query_id").agg(F.count("*").alias("n"))
    out = a.join(n, "query_id", "left").fillna(0, ["n"])
    return out.select("query_id", "answer", context.without_tags("answer").alias("plain"), "n", context.answer_confidence("n").alias("confidence"))


def _cited(spark, sf_dir):
    """The shortlist as citations, one of them of a chunk that isn't there."""
    c = chunk_run(spark, sf_dir).where("rank <= 5").select("query_id", "chunk_id")
    return c.unionByName(spark.createDataFrame([(1, "nosuchchunk0")], "query_id int, chunk_id string"))


def citation_checks(spark, sf_dir):
    return guards.verify_citations(_cited(spark, sf_dir), chunk_run(spark, sf_dir).where("rank <= 3"), _chunks(spark, sf_dir))


def citation_provenance(spark, sf_dir):
    s = table(spark, sf_dir, "patent_sections").where("section_id is not null").groupBy("section_id").agg(F.min(F.array_join("paragraphs", "\n\n")).alias("text"))
    return context.provenance(_cited(spark, sf_dir), _chunks(spark, sf_dir), s)


def _known_items(spark, sf_dir):
    """Titles of every hundredth record as queries, the document as the only relevant one."""
    p = table(spark, sf_dir, "patents").where("record_id % 100 = 0 and title is not null")
    return p.select(F.col("record_id").alias("query_id"), F.col("title").alias("query"), F.col("doc_id").alias("document_id"), F.lit(1.0).alias("gain"))


def known_item_metrics(spark, sf_dir):
    """The queries grow with the chunks, so no row of a query and a chunk is kept unless it is among the best of a block."""
    q, c = _known_items(spark, sf_dir), _chunks(spark, sf_dir)
    runs = cut(blockwise.best(c, "chunk_id", "text", q.select("query_id", "query"), 50))
    fused = fusion.reciprocal_rank_fusion([runs.where(F.col("config") == name) for name in ("bm25", "tfidf")], "chunk_id", keep=50)
    u = runs.unionByName(fused.withColumn("config", F.lit("fused")))
    d = fusion.documents_of(u.withColumn("query_id", F.struct("config", "query_id")), "chunk_id", c).select("query_id.*", "rank", "document_id")
    return evaluate.mean_metrics(evaluate.query_metrics(cut(d), q.select("query_id", "document_id", "gain"), "document_id"))


def bm25_filled(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return sparse.filled(sparse.bm25(docs, "doc_id", "text", asked(spark)), docs, asked(spark), "doc_id", 10)


def _targets(spark):
    """Chunks of these documents are targets of the first two queries."""
    return spark.createDataFrame([(1, "US"), (2, "EP")], "query_id int, office string")


def target_ranks(spark, sf_dir):
    """The first rank of a chunk of a document of an office, and how many are among the first fifteen."""
    run = cut(chunk_run(spark, sf_dir))
    t = _targets(spark).join(_chunks(spark, sf_dir).select("chunk_id", F.substring("document_id", 1, 2).alias("office")), "office").select("query_id", "chunk_id")
    return sparse.first_rank_of(run, asked(spark), "chunk_id", t).join(sparse.count_in_top(run, t, "chunk_id", 15), "query_id", "left").select("query_id", "first", "n")


def gold_in_corpus(spark, sf_dir):
    """Citations of the records as gold, as far as they are in the corpus under that very name."""
    p = table(spark, sf_dir, "patents")
    g = p.select(F.col("record_id").alias("query_id"), F.explode("citations").alias("doc_id")).distinct()
    return evaluate.present_gold(g, p, "doc_id")


def bm25_curves(spark, sf_dir):
    f = spark.range(0, 20).select(F.col("id").cast("int").alias("f"), (F.col("id") / 5.0).alias("r"))
    a, b = sparse.term_curves()
    return f.select("f", F.round(a, 6).alias("saturation"), F.round(b, 6).alias("penalty"))


# ------------------------------------------------------------------ vectors


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e, e.where("vec_id % 100 = 0")


def knn_dot(spark, sf_dir):
    return vectors.exact_topk(*_vectors(spark, sf_dir), "vec_id", "embedding")


def knn_cosine(spark, sf_dir):
    return vectors.exact_topk(*_vectors(spark, sf_dir), "vec_id", "embedding", metric="cosine")


def knn_l2(spark, sf_dir):
    return vectors.exact_topk(*_vectors(spark, sf_dir), "vec_id", "embedding", metric="l2")


def knn_label_metrics(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    run = vectors.exact_topk(e, q, "vec_id", "embedding").withColumn("config", F.lit("exact"))
    labels = e.select("vec_id", "label")
    gold = q.select(F.col("vec_id").alias("query_id"), "label").join(labels, "label").select("query_id", "vec_id", F.lit(1.0).alias("gain"))
    m = evaluate.query_metrics(run, gold, "vec_id")
    return m.select("config", "query_id", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


def int8_topk(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    coded = vectors.int8_quantise(e, "embedding", 64).select("vec_id", F.col("restored").alias("embedding"))
    return vectors.exact_topk(coded, q, "vec_id", "embedding")


def int8_codes(spark, sf_dir):
    e, _ = _vectors(spark, sf_dir)
    c = vectors.int8_quantise(e, "embedding", 64)
    worst = F.array_max(F.zip_with("embedding", "restored", lambda a, b: F.abs(a.cast("double") - b)))
    return c.select("vec_id", F.aggregate("code", F.lit(0), lambda a, x: a + x).cast("long").alias("code_sum"), F.round(worst, 6).alias("worst"))


def ann_ivf(spark, sf_dir):
    return vectors.ivf_topk(*_vectors(spark, sf_dir), "vec_id", "embedding")


def _pq(spark, sf_dir):
    e, q = _vectors(spark, sf_dir)
    books = vectors.pq_fit(e, "embedding")
    return vectors.pq_topk(vectors.pq_encode(e, "vec_id", "embedding", books), q, books, "vec_id", "embedding", 50)


def pq_refined(spark, sf_dir):
    """Fifty candidates by codes, ranked anew by their vectors."""
    from sparkfolio.functions.vector import dot

    e, q = _vectors(spark, sf_dir)
    c = _pq(spark, sf_dir).select("query_id", "vec_id").join(e.select("vec_id", "embedding"), "vec_id").join(q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id")
    return sparse.top_k(c.select("query_id", "vec_id", dot("q", "embedding").alias("score")), "vec_id", 10)


def ann_recall(spark, sf_dir):
    """Mean recall of the ten nearest, per index."""
    exact = cut(knn_dot(spark, sf_dir))
    out = None
    for name, run, size in (("ivf", ann_ivf, 256), ("int8", int8_topk, 64), ("pq", pq_refined, 16)):
        r = evaluate.index_recall(run(spark, sf_dir), exact, "vec_id").agg(F.round(F.avg("recall"), 4).alias("recall")).withColumn("index", F.lit(name)).withColumn("bytes", F.lit(size))
        out = r if out is None else out.unionByName(r)
    return out.select("index", "bytes", "recall")


def ann_probe_sweep(spark, sf_dir):
    """Mean recall of the ten nearest by the number of cells looked into."""
    exact = cut(knn_dot(spark, sf_dir))
    out = None
    for probes in (1, 4, 12, 32):
        run = vectors.ivf_topk(*_vectors(spark, sf_dir), "vec_id", "embedding", probes=probes)
        r = evaluate.index_recall(run, exact, "vec_id").agg(F.round(F.avg("recall"), 4).alias("recall")).withColumn("probes", F.lit(probes))
        out = r if out is None else out.unionByName(r)
    return out.select("probes", "recall")


def maxsim_topk(spark, sf_dir):
    """Eight vectors in a row are a document's tokens; every hundredth document is a query."""
    e, _ = _vectors(spark, sf_dir)
    t = e.select(F.floor(F.col("vec_id") / 8).cast("long").alias("doc"), "embedding")
    return vectors.maxsim_topk(t, t.where("doc % 100 = 0"), "doc", "embedding", 5)


def memory_report(spark, sf_dir):
    from sparkfolio.functions.vector import memory_bytes

    sizes = spark.createDataFrame([(n, k, b) for n in (1_000, 1_000_000, 100_000_000) for k, b in (("float32", 4.0), ("float16", 2.0), ("int8", 1.0), ("pq48", 0.125))], "n long, kind string, each double")
    return sizes.select("n", "kind", F.round(memory_bytes("n", F.lit(384), "each") / 1e9, 6).alias("gb"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_counts, token_estimate, sentence_counts, paragraph_counts, fixed_window_chunks, postings, document_frequency, boolean_and, bm25_topk, bm25_okapi_topk, tfidf_topk, bm25_prefiltered,
        bm25_postfiltered, rrf_fusion, chunk_run, chunk_documents, chunk_rerank, context_budget, context_exact, context_prompts, extractive_answers, citation_checks, citation_provenance, known_item_metrics,
        knn_dot, knn_cosine, knn_l2, knn_label_metrics, int8_topk, int8_codes, ann_ivf, pq_refined, ann_recall, ann_probe_sweep, maxsim_topk, bm25_filled, target_ranks, gold_in_corpus, bm25_curves, memory_report,
    )
}


# ------------------------------------------------------------------ SQL

_Q = f"q AS (SELECT * FROM (VALUES {_VALUES}) AS t(query_id, query))"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _scored(source: str, key: str, queries: str, part: str, k: int, name: str, where: str = "TRUE") -> str:
    """CTEs that end in `name`: the k best of `source` for the queries in CTE `queries`."""
    p = name
    return rf"""
{p}_d AS (SELECT {key} AS key, {_TOK.format('text')} AS toks FROM {source} WHERE {where}),
{p}_s AS (SELECT count(*) AS n, sum(coalesce(len(toks), 0)) / greatest(count(*), 1) AS avgdl FROM {p}_d),
{p}_t AS (SELECT key, dl, term, count(*) AS tf FROM (SELECT key, len(toks) AS dl, unnest(toks) AS term FROM {p}_d) GROUP BY 1, 2, 3),
{p}_f AS (SELECT term, count(*) AS df FROM {p}_t GROUP BY 1),
{p}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_TOK.format('query')}) AS term FROM {queries}) GROUP BY 1, 2),
{p}_m AS (SELECT query_id, key, qtf, tf, dl, df, n, avgdl, term FROM {p}_t JOIN {p}_q USING (term) JOIN {p}_f USING (term), {p}_s),
{p}_g AS (SELECT query_id, key, round(sum({part.replace('@', p)}), 6) AS score FROM {p}_m GROUP BY 1, 2),
{name} AS (SELECT query_id, rank, key, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INT) AS rank FROM {p}_g) WHERE rank <= {k})"""


_BM25 = "qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"
_OKAPI = """qtf * (CASE WHEN ln((n - df + 0.5) / (df + 0.5)) < 0 THEN 0.25 * (SELECT avg(ln((n - df + 0.5) / (df + 0.5))) FROM (SELECT DISTINCT term, n, df FROM @_m))
 ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))"""
_TFIDF = "qtf * (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1)"


def _top(part: str, k: int = 10, where: str = "TRUE", source: str = "documents", key: str = "doc_id") -> str:
    return f"WITH {_Q}, {_scored(source, key, 'q', part, k, 'r', where)} SELECT query_id, rank, key AS {key}, score FROM r"


def _fused(a: str, b: str, key: str, wa: float, wb: float, keep: int, name: str) -> str:
    return f"""{name} AS (SELECT query_id, rank, key, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INT) AS rank FROM (
 SELECT query_id, key, round(sum(part), 9) AS score FROM (SELECT query_id, key, {wa} / (60 + rank) AS part FROM {a} UNION ALL SELECT query_id, key, {wb} / (60 + rank) FROM {b}) GROUP BY 1, 2)) WHERE rank <= {keep})"""


_RUN = f"WITH {_Q}, {_scored('chunks', 'chunk_id', 'q', _BM25, 50, 'r')}"
_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_KNN = """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({score}, 6) AS score FROM embeddings a, {base} b WHERE a.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 10"""
_LABEL = "'[PATENT=' || document_id || CASE WHEN coalesce(section, '') <> '' THEN ' | SECTION=' || section ELSE '' END || CASE WHEN claim_number IS NOT NULL THEN ' | CLAIM=' || claim_number ELSE '' END || ' | CHUNK=' || chunk_id || ']'"
_CONTEXT = f"""{_RUN}, c AS (SELECT r.query_id, r.rank, r.key AS chunk_id, c.document_id, c.text, c.section, c.claim_number, c.token_estimate AS tokens FROM r JOIN chunks c ON c.chunk_id = r.key WHERE rank <= 30),
d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, left(text, 120) ORDER BY rank) = 1),
e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) <= 2),
f AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS used, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS position FROM e),
g AS (SELECT * FROM f WHERE used <= 600 OR position = 1)"""
_INT8 = """i AS (SELECT generate_subscripts(embedding, 1) AS d, unnest(embedding::DOUBLE[]) AS v FROM embeddings), m AS (SELECT d, min(v) AS lo, max(v) AS hi FROM i GROUP BY 1),
mm AS (SELECT list(lo ORDER BY d) AS lo, list(hi ORDER BY d) AS hi FROM m),
k AS (SELECT vec_id, embedding::DOUBLE[] AS e, [CASE WHEN hi[x] = lo[x] THEN 0 ELSE CAST(floor((embedding[x]::DOUBLE - lo[x]) / (hi[x] - lo[x]) * 255 + 0.5) AS INT) END FOR x IN range(1, 65)] AS code, lo, hi FROM embeddings, mm),
z AS (SELECT vec_id, e, code, [lo[x] + code[x] / 255.0 * (hi[x] - lo[x]) FOR x IN range(1, 65)] AS embedding FROM k)"""
_METRICS = """
h AS (SELECT r.*, g.gain FROM {run} r LEFT JOIN {gold} g ON g.query_id = r.query_id AND g.doc = r.doc),
i AS (SELECT query_id, count(*) AS relevant, sum(CASE WHEN n <= 10 THEN gain / log2(n + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc) AS n FROM {gold}) GROUP BY 1),
f AS (SELECT config, query_id, count(*) FILTER (WHERE gain IS NOT NULL AND rank <= 5) AS h5, count(*) FILTER (WHERE gain IS NOT NULL AND rank <= 10) AS h10, min(rank) FILTER (WHERE gain IS NOT NULL) AS first,
 sum(CASE WHEN gain IS NOT NULL AND rank <= 10 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY 1, 2),
m AS (SELECT c.config, i.query_id, coalesce(h5, 0) / 5 AS p_at_5, coalesce(h10, 0) / 10 AS p_at_10, coalesce(h5, 0) / relevant AS r_at_5, coalesce(h10, 0) / relevant AS r_at_10, coalesce(1 / first, 0) AS rr, coalesce(dcg, 0) / idcg AS ndcg
 FROM (SELECT DISTINCT config FROM {run}) c CROSS JOIN i LEFT JOIN f ON f.config = c.config AND f.query_id = i.query_id)"""

SQL = {
    "tokenize_counts": f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, t[1] AS first, t[-1] AS last FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)",
    "token_estimate": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]')) AS BIGINT) AS n FROM documents",
    "sentence_counts": rf"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n, CAST(CASE WHEN s IS NULL THEN NULL ELSE coalesce(list_max([length(x) FOR x IN s]), 0) END AS BIGINT) AS longest FROM (
    SELECT doc_id, [y FOR y IN [{_STRIP.format('x')} FOR x IN string_split(regexp_replace({_STRIP.format('text')}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))] IF y <> ''] AS s FROM documents)""",
    "paragraph_counts": rf"""SELECT doc_id, CAST(len([y FOR y IN [{_STRIP.format('x')} FOR x IN string_split_regex(text, '\n\s*\n')] IF y <> '']) AS BIGINT) AS n,
    CAST(CASE WHEN text IS NULL THEN NULL WHEN {_STRIP.format('text')} = '' THEN 0 ELSE len(string_split_regex({_STRIP.format('text')}, '\s+')) END AS BIGINT) AS words FROM documents""",
    "fixed_window_chunks": f"""WITH t AS (SELECT doc_id, {_TOK.format('text')} AS k FROM documents), w AS (SELECT doc_id, unnest(range(0, len(k), 160)) AS a, k FROM t),
    p AS (SELECT doc_id, CAST(a // 160 AS INT) AS seq, array_to_string(k[a + 1 : a + 180], ' ') AS piece FROM w)
    SELECT doc_id, seq, left(sha1(concat_ws('|', CAST(doc_id AS VARCHAR), 'window', CAST(seq AS VARCHAR), piece)), 12) AS chunk_id, CAST(length(piece) AS BIGINT) AS n_chars FROM p""",
    "postings": f"""SELECT term, doc_id, count(*) AS tf, CAST(min(pos) AS BIGINT) AS first, CAST(max(pos) AS BIGINT) AS last FROM (
    SELECT doc_id, unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)) GROUP BY 1, 2""",
    "document_frequency": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) GROUP BY 1",
    "boolean_and": f"SELECT DISTINCT doc_id FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents) WHERE list_has_all(t, ['magnetic', 'electrode', 'stable'])",
    "bm25_topk": _top(_BM25),
    "bm25_okapi_topk": _top(_OKAPI),
    "tfidf_topk": _top(_TFIDF),
    "bm25_filled": f"""WITH {_Q}, {_scored('documents', 'doc_id', 'q', _BM25, 10, 'r')}, a AS (SELECT query_id, key, score FROM r UNION ALL SELECT query_id, doc_id, 0.0 FROM q CROSS JOIN (SELECT DISTINCT doc_id FROM documents) d
    WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.query_id = q.query_id AND r.key = d.doc_id)), b AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INT) AS rank, key AS doc_id, score FROM a) SELECT * FROM b WHERE rank <= 10""",
    "target_ranks": _RUN + """, t AS (SELECT o.query_id, chunk_id FROM (VALUES (1, 'US'), (2, 'EP')) AS o(query_id, office) JOIN chunks c ON left(c.document_id, 2) = o.office),
    h AS (SELECT r.query_id, rank, t.chunk_id IS NOT NULL AS hit FROM r LEFT JOIN t ON t.query_id = r.query_id AND t.chunk_id = r.key)
    SELECT q.query_id, min(rank) FILTER (WHERE hit) AS first, CASE WHEN count(rank) = 0 THEN NULL ELSE count(*) FILTER (WHERE hit AND rank <= 15) END AS n FROM q LEFT JOIN h ON h.query_id = q.query_id GROUP BY 1""",
    "gold_in_corpus": "SELECT DISTINCT record_id AS query_id, c AS doc_id FROM (SELECT record_id, unnest(citations) AS c FROM patents) WHERE c IN (SELECT doc_id FROM patents)",
    "bm25_curves": "SELECT CAST(f AS INT) AS f, round(f * 2.5 / (f + 1.5), 6) AS saturation, round(0.25 + 0.75 * (f / 5.0), 6) AS penalty FROM range(0, 20) AS t(f)",
    "bm25_prefiltered": _top(_BM25, where="coalesce(lang = 'de', FALSE)"),
    "bm25_postfiltered": f"""WITH {_Q}, {_scored('documents', 'doc_id', 'q', _BM25, 30, 'r')}, k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INT) AS rank, key AS doc_id, score
    FROM r JOIN documents d ON d.doc_id = r.key WHERE d.lang = 'de') SELECT * FROM k WHERE rank <= 10""",
    "rrf_fusion": f"""WITH {_Q}, {_scored('documents', 'doc_id', 'q', _BM25, 40, 'a')}, {_scored('documents', 'doc_id', 'q', _TFIDF, 40, 'b')}, {_fused('a', 'b', 'doc_id', 1.0, 0.5, 10, 'x')}
    SELECT query_id, rank, key AS doc_id, score FROM x""",
    "chunk_run": _RUN + " SELECT query_id, rank, key AS chunk_id, score FROM r",
    "chunk_documents": _RUN + """, d AS (SELECT query_id, document_id, min(rank) AS first FROM r JOIN chunks c ON c.chunk_id = r.key GROUP BY 1, 2)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first, document_id) AS INT) AS rank, document_id FROM d""",
    "chunk_rerank": _RUN + f""", s AS (SELECT r.query_id, r.key AS chunk_id, list_distinct({_TOK.format('query')}) AS a, list_distinct({_TOK.format('text')}) AS b FROM r JOIN chunks c ON c.chunk_id = r.key JOIN q USING (query_id) WHERE rank <= 30),
    t AS (SELECT query_id, chunk_id, round(len(list_intersect(a, b)) / len(a) + 0.1 * len(list_intersect(a, b)) / len(list_distinct(a || b)), 6) AS score FROM s),
    u AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank, chunk_id, score FROM t) SELECT * FROM u WHERE rank <= 15""",
    "context_budget": _CONTEXT + " SELECT query_id, position, rank, chunk_id, document_id, tokens FROM g",
    "context_prompts": _CONTEXT + f""" SELECT query_id, 'Context:' || chr(10) || chr(10) || string_agg({_LABEL} || chr(10) || text, chr(10) || chr(10) ORDER BY position) || chr(10) || chr(10) || 'Question: ' || any_value(query) || chr(10) || 'Answer:' AS prompt
    FROM g JOIN q USING (query_id) GROUP BY query_id""",
    "extractive_answers": _CONTEXT + rf""", y AS (SELECT *, string_split(regexp_replace({_STRIP.format('text')}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31))[1] AS s FROM g WHERE position <= 2),
    o AS (SELECT query_id, string_agg(CASE WHEN length(s) < 320 THEN s ELSE left(s, 317) || '...' END || ' ' || {_LABEL}, ' ' ORDER BY position) AS a, count(DISTINCT chunk_id) AS n FROM y GROUP BY 1)
    SELECT query_id, coalesce(a, '{context.NOTHING}') AS answer, trim(replace(regexp_replace(coalesce(a, '{context.NOTHING}'), '\[PATENT=[^\]]+\]', '', 'g'), '  ', ' ')) AS plain, coalesce(n, 0) AS n,
    CASE WHEN n > 0 THEN least(1.0::DOUBLE, 0.4 + 0.2 * n) ELSE 0.1 END AS confidence FROM q LEFT JOIN o USING (query_id)""",
    "citation_checks": _RUN + """, c AS (SELECT query_id, key AS chunk_id FROM r WHERE rank <= 5 UNION ALL SELECT 1, 'nosuchchunk0'), t AS (SELECT chunk_id, bool_or(coalesce(norm_start >= 0 AND norm_end >= norm_start, FALSE)) AS ok FROM chunks GROUP BY 1)
    SELECT c.query_id, c.chunk_id, t.ok IS NOT NULL AS source_exists, g.key IS NOT NULL AS was_retrieved, coalesce(t.ok, FALSE) AS offsets_resolve, t.ok IS NOT NULL AND g.key IS NOT NULL AND coalesce(t.ok, FALSE) AS valid
    FROM c LEFT JOIN t USING (chunk_id) LEFT JOIN (SELECT * FROM r WHERE rank <= 3) g ON g.query_id = c.query_id AND g.key = c.chunk_id""",
    "citation_provenance": _RUN + """, c AS (SELECT query_id, key AS chunk_id FROM r WHERE rank <= 5 UNION ALL SELECT 1, 'nosuchchunk0'), s AS (SELECT section_id, min(array_to_string(paragraphs, chr(10) || chr(10))) AS text FROM patent_sections WHERE section_id IS NOT NULL GROUP BY 1)
    SELECT c.query_id, c.chunk_id, k.document_id IS NOT NULL AS resolved, k.document_id, k.section, k.claim_number, k.norm_start, k.norm_end,
    CASE WHEN k.claim_number IS NULL THEN left(substr(s.text, k.norm_start + 1, k.norm_end - k.norm_start), 160) END AS recovered FROM c LEFT JOIN chunks k USING (chunk_id) LEFT JOIN s ON s.section_id = k.section""",
    "known_item_metrics": f"""WITH q AS (SELECT record_id AS query_id, title AS query, doc_id AS doc, 1.0 AS gain FROM patents WHERE record_id % 100 = 0 AND title IS NOT NULL),
    {_scored('chunks', 'chunk_id', 'q', _BM25, 50, 'a')}, {_scored('chunks', 'chunk_id', 'q', _TFIDF, 50, 'b')}, {_fused('a', 'b', 'chunk_id', 1.0, 1.0, 50, 'x')},
    u AS (SELECT 'bm25' AS config, * FROM a UNION ALL SELECT 'tfidf', * FROM b UNION ALL SELECT 'fused', * FROM x),
    v AS (SELECT config, query_id, document_id AS doc, min(rank) AS first FROM u JOIN chunks c ON c.chunk_id = u.key GROUP BY 1, 2, 3),
    run AS (SELECT config, query_id, doc, CAST(row_number() OVER (PARTITION BY config, query_id ORDER BY first, doc) AS INT) AS rank FROM v), {_METRICS.format(run='run', gold='q')}
    SELECT config, count(*) AS queries, round(avg(p_at_5), 6) AS p_at_5, round(avg(p_at_10), 6) AS p_at_10, round(avg(r_at_5), 6) AS r_at_5, round(avg(r_at_10), 6) AS r_at_10, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m GROUP BY 1""",
    "knn_dot": _KNN.format(score=_DOT, base="embeddings"),
    "knn_cosine": _KNN.format(score="list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", base="embeddings"),
    "knn_l2": _KNN.format(score="-(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2)", base="embeddings"),
    "knn_label_metrics": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc, round({_DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
    run AS (SELECT 'exact' AS config, * FROM (SELECT query_id, doc, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INT) AS rank FROM s) WHERE rank <= 10),
    gold AS (SELECT a.vec_id AS query_id, b.vec_id AS doc, 1.0 AS gain FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 100 = 0), {_METRICS.format(run='run', gold='gold')}
    SELECT config, query_id, round(p_at_5, 6) AS p_at_5, round(p_at_10, 6) AS p_at_10, round(r_at_5, 6) AS r_at_5, round(r_at_10, 6) AS r_at_10, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM m""",
    "int8_topk": f"WITH {_INT8}, " + _KNN.format(score="list_inner_product(a.embedding::DOUBLE[], b.embedding)", base="z")[5:],
    "int8_codes": f"WITH {_INT8} SELECT vec_id, CAST(list_sum(code) AS BIGINT) AS code_sum, round(list_max([abs(e[x] - embedding[x]) FOR x IN range(1, 65)]), 6) AS worst FROM z",
    "maxsim_topk": """WITH t AS (SELECT vec_id // 8 AS doc, vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.doc AS query_id, a.vec_id, b.doc, max(list_cosine_similarity(a.e, b.e)) AS s FROM t a, t b WHERE a.doc % 100 = 0 GROUP BY 1, 2, 3),
    s AS (SELECT query_id, doc, round(sum(s), 6) AS score FROM p GROUP BY 1, 2), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS INT) AS rank, doc, score FROM s) SELECT * FROM r WHERE rank <= 5""",
    "memory_report": """SELECT n, kind, round(CAST(n AS DOUBLE) * 384 * b / 1e9, 6) AS gb FROM (VALUES (1000::BIGINT), (1000000), (100000000)) AS t(n), (VALUES ('float32', 4.0), ('float16', 2.0), ('int8', 1.0), ('pq48', 0.125)) AS k(kind, b)""",
}
