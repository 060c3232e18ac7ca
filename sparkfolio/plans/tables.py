"""Queries over whole tables for what other modules show on few rows: kept indexes, agents, judges, guards, lineage; with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.operators import agent, evaluate, fusion, guards, sparse, vectors
from sparkfolio.operators.hierarchy import descendants, hierarchy
from sparkfolio.plans import checks
from sparkfolio.plans.records import _TREE
from sparkfolio.plans.retrieval import _BM25, _OKAPI, _TFIDF, _fused, _Q, _scored, _top, asked
from sparkfolio.session import cut, ensure_checkpoint_dir, spread, table

# ------------------------------------------------------------------ a kept index


def _index(spark: SparkSession, sf_dir: str) -> sparse.Index:
    folder = f"{ensure_checkpoint_dir(spark)}/indexes/{uuid.uuid4().hex}"
    return sparse.Index.build(spread(table(spark, sf_dir, "documents")), "doc_id", "text", folder)


def index_bm25(spark, sf_dir):
    """BM25 from an index that is built and kept; the same rows as bm25_topk."""
    return _index(spark, sf_dir).bm25(asked(spark))


def index_okapi(spark, sf_dir):
    """The variant with negative idf, whose mean is over all terms of the collection."""
    return _index(spark, sf_dir).bm25(asked(spark), idf="okapi")


def index_fusion(spark, sf_dir):
    """Two searches of one index, fused."""
    found = cut(_index(spark, sf_dir).matches(asked(spark)))
    runs = [sparse.bm25_of(found, "doc_id", 40), sparse.tfidf_of(found, "doc_id", 40)]
    return fusion.reciprocal_rank_fusion(runs, "doc_id", weights=[1.0, 0.5], keep=10)


def index_frequencies(spark, sf_dir):
    return _index(spark, sf_dir).document_frequency()


def ann_cells(spark, sf_dir):
    """Every hundredth vector against all, by a kept index of cells."""
    e = spread(table(spark, sf_dir, "embeddings")).select("vec_id", "embedding")
    index = vectors.CellIndex.build(e, "vec_id", "embedding", f"{ensure_checkpoint_dir(spark)}/indexes/{uuid.uuid4().hex}")
    return index.search(e.where("vec_id % 100 = 0"), "vec_id", "embedding")


# ------------------------------------------------------------------ agents, judges, guards


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question about every record: of each third one its classification, of each third one its claims."""
    p = table(spark, sf_dir, "patents").where("doc_id is not null")
    kind = F.col("record_id") % 3
    q = F.when(kind == 0, "Classify ").when(kind == 1, "Which claim of ").otherwise("Find ")
    return p.select(F.col("record_id").alias("query_id"), F.concat(q, F.col("doc_id"), F.lit(" "), F.coalesce("title", F.lit(""))).alias("query"))


def agent_steps(spark, sf_dir):
    """The planned calls of all questions and whether a guest may make them."""
    s = agent.decisions(agent.steps(_questions(spark, sf_dir)), F.lit("guest"))
    return s.select("query_id", "step", "tool", "publication_number", "top_k", "decision")


def agent_lookups(spark, sf_dir):
    """What the two tools that look a publication up give for all questions: the titles and numbers of classes found."""
    p = table(spark, sf_dir, "patents").select("doc_id", "title", "abstract", "cpc", "publication_date").where("doc_id is not null and title is not null")
    no_chunks = spark.createDataFrame([], "chunk_id string, document_id string, section string, claim_number int, text string")
    tools = {k: f for k, f in agent.search_tools(no_chunks, p).items() if k in ("fetch_patent", "lookup_classification")}
    t = agent.trajectories(tools, _questions(spark, sf_dir), F.lit("researcher")).where(F.col("tool").isin(*tools))
    return t.select("query_id", "tool", F.get_json_object("result", "$[0].title").alias("title"), F.get_json_object("result", "$[0].error").alias("error"), F.json_array_length("result").alias("rows"))


def judge_replies(spark, sf_dir):
    """Judges' replies with whole, broken, large, small and signed numbers."""
    e = table(spark, sf_dir, "events").where("event_id is not null")
    n, kind = F.col("event_id").cast("string"), F.col("event_id") % 5
    score = F.when(kind == 0, F.concat(n, F.lit(".8754"))).when(kind == 1, F.concat(n, F.lit("e-3"))).when(kind == 2, F.concat(F.lit("-"), n)).when(kind == 3, F.concat(F.lit('"'), n, F.lit('"'))).otherwise(F.lit('"none"'))
    return e.select("event_id", evaluate.judge_score(F.concat(F.lit('Sure: {"score": '), score, F.lit(', "why": "x"} so it is'))).alias("score"))


def document_safety(spark, sf_dir):
    """Unsafe terms, scope and shapes of personal data in all documents."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(guards.unsafe_terms("text"), ",").alias("unsafe"), guards.scope_rule("text").alias("rule"), F.array_join(guards.pii_shapes("text"), ",").alias("shapes"))


def personal_documents(spark, sf_dir):
    """All chunks with their personal data masked, and whether the masks read back give the text."""
    m = table(spark, sf_dir, "chunks").select("chunk_id", "text", guards.mask_pii("text").alias("m"))
    return m.select("chunk_id", (guards.unmask("m.masked", "m.mapping") == F.col("text")).alias("reads_back"))


def citation_recall_at_2(spark, sf_dir):
    """Precision and recall of the first two citations of a record against the American ones it cites."""
    p = table(spark, sf_dir, "patents").where("citations is not null")
    r, g = F.slice(F.filter("citations", lambda c: c.isNotNull()), 1, 2), F.filter(F.array_distinct("citations"), lambda c: c.rlike("^US"))
    return p.select("record_id", F.round(evaluate.context_precision(r, g), 6).alias("precision"), F.round(evaluate.context_recall(r, g), 6).alias("recall"))


# ------------------------------------------------------------------ lineage of claims


def p5_ancestors(spark, sf_dir):
    """Every claim with each claim on its way up, circles included, in long form."""
    c = table(spark, sf_dir, "patent_claims")
    t = cut(hierarchy(c, "doc_id", "number", "dependent_on", ("loaded_at", "claim_id")))
    d = descendants(t, "doc_id", "number", c, "dependent_on", ("loaded_at", "claim_id"))
    return d.select("doc_id", F.col("descendant").cast("int").alias("number"), F.col("number").cast("int").alias("ancestor"), F.col("distance").cast("int"))


QUERIES = {f.__name__: f for f in (index_bm25, index_okapi, index_fusion, index_frequencies, ann_cells, agent_steps, agent_lookups, judge_replies, document_safety, personal_documents, citation_recall_at_2, p5_ancestors)}

_ASKED = """t AS (SELECT record_id AS query_id, doc_id, record_id % 3 AS kind, CASE record_id % 3 WHEN 0 THEN 'Classify ' WHEN 1 THEN 'Which claim of ' ELSE 'Find ' END || doc_id || ' ' || coalesce(title, '') AS query
 FROM patents WHERE doc_id IS NOT NULL), m AS (SELECT *, regexp_extract(query, '\\b([A-Z]{2}\\d{5,}[A-Z]\\d?)\\b', 1) AS number, lower(query) AS low FROM t)"""
_EVERY = _OKAPI.replace("(SELECT DISTINCT term, n, df FROM @_m)", "@_f, @_s")
_TERMS = ", ".join(f"CASE WHEN contains(lower(coalesce(text, '')), '{t}') THEN '{t}' END" for t in guards.UNSAFE_TERMS)
_SCOPE = " ".join(
    f"WHEN {' OR '.join(f'''contains(lower(coalesce(text, '')), '{t}')''' for t in terms)} THEN '{name}'" for name, terms in (("off_scope_hint", guards.OFF_SCOPE), ("in_scope_term", guards.IN_SCOPE))
)
_SHAPES = ", ".join(f"CASE WHEN regexp_matches(text, {checks._quoted(p)}) THEN '{n}' END" for n, p in guards.PII)
SQL = {
    "index_bm25": _top(_BM25),
    "index_okapi": _top(_EVERY),
    "index_fusion": f"WITH {_Q}, {_scored('documents', 'doc_id', 'q', _BM25, 40, 'a')}, {_scored('documents', 'doc_id', 'q', _TFIDF, 40, 'b')}, {_fused('a', 'b', 'doc_id', 1.0, 0.5, 10, 'x')} SELECT query_id, rank, key AS doc_id, score FROM x",
    "index_frequencies": "SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[./-][a-z0-9]+)*')) AS term FROM documents) GROUP BY 1",
    "agent_steps": f"""WITH {_ASKED}, s AS (SELECT query_id, number, unnest(list_filter([CASE WHEN number <> '' THEN 'fetch_patent' END, CASE WHEN number <> '' AND (contains(low, 'classif') OR contains(low, 'cpc')) THEN 'lookup_classification' END,
    CASE WHEN regexp_matches(low, '\\bclaim') THEN 'search_claims' END, 'retrieve_passages'], lambda x: x IS NOT NULL)) AS tool, length(query) AS n FROM m), o AS (SELECT *, CASE tool WHEN 'fetch_patent' THEN 0 WHEN 'lookup_classification' THEN 1 WHEN 'search_claims' THEN 2 ELSE 3 END AS place FROM s)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS INT) AS step, tool, CASE WHEN place < 2 THEN number END AS publication_number, CASE place WHEN 2 THEN 5 WHEN 3 THEN 8 ELSE 1 END AS top_k,
    CASE WHEN tool = 'lookup_classification' THEN 'insufficient_permission' WHEN place > 1 AND (n < 2 OR n > 400) THEN 'invalid_arguments' ELSE '' END AS decision FROM o""",
    "agent_lookups": f"""WITH {_ASKED}, k AS (SELECT doc_id, any_value(title) AS title FROM patents WHERE doc_id IS NOT NULL AND title IS NOT NULL GROUP BY 1),
    c AS (SELECT query_id, number, 'fetch_patent' AS tool FROM m WHERE number <> '' UNION ALL SELECT query_id, number, 'lookup_classification' FROM m WHERE number <> '' AND (contains(low, 'classif') OR contains(low, 'cpc')))
    SELECT query_id, tool, CASE WHEN tool = 'fetch_patent' THEN title END AS title, CASE WHEN tool = 'fetch_patent' AND k.doc_id IS NULL THEN 'not found' END AS error, CAST(1 AS INT) AS rows FROM c LEFT JOIN k ON k.doc_id = c.number""",
    "judge_replies": """SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(event_id || '.8754' AS DOUBLE) WHEN 1 THEN CAST(event_id || 'e-3' AS DOUBLE) WHEN 2 THEN -CAST(event_id AS DOUBLE) WHEN 3 THEN CAST(event_id AS DOUBLE) ELSE 0.0 END AS score
    FROM events WHERE event_id IS NOT NULL""",
    "document_safety": f"""SELECT doc_id, array_to_string(list_filter([{_TERMS}], lambda x: x IS NOT NULL), ',') AS unsafe, CASE {_SCOPE} ELSE 'similarity' END AS rule,
    array_to_string(list_filter([{_SHAPES}], lambda x: x IS NOT NULL), ',') AS shapes FROM documents""",
    "personal_documents": "SELECT chunk_id, CASE WHEN text IS NOT NULL THEN TRUE END AS reads_back FROM chunks",
    "citation_recall_at_2": """WITH x AS (SELECT record_id, ([c FOR c IN citations IF c IS NOT NULL])[1:2] AS r, [c FOR c IN list_distinct(citations) IF starts_with(c, 'US')] AS g FROM patents WHERE citations IS NOT NULL)
    SELECT record_id, round(CASE WHEN len(r) = 0 THEN 0.0 ELSE len([d FOR d IN r IF list_contains(g, d)]) / len(r) END, 6) AS precision, round(CASE WHEN len(g) = 0 THEN 1.0 ELSE len(list_intersect(r, g)) / len(g) END, 6) AS recall FROM x""",
    "p5_ancestors": _TREE.split("\nw AS (")[0]
    + """
    u AS (SELECT n.doc_id, n.number, n.up FROM n JOIN n q ON q.doc_id = n.doc_id AND q.number = n.up),
    a AS (SELECT doc_id, number, up AS ancestor, 1 AS distance, [number, up] AS way FROM u WHERE up <> number
      UNION ALL SELECT a.doc_id, a.number, u.up, a.distance + 1, list_append(a.way, u.up) FROM a JOIN u ON u.doc_id = a.doc_id AND u.number = a.ancestor WHERE NOT list_contains(a.way, u.up))
    SELECT doc_id, number, CAST(ancestor AS INT) AS ancestor, CAST(distance AS INT) AS distance FROM a""",
}
