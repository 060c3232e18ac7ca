"""Queries of the llm operators, by name, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm.bpe import encode_documents
from sparkfolio.llm.lookalike import consistent_text, find_oddities
from sparkfolio.llm.names import variant_spellings
from sparkfolio.llm.neardup import duplicate_classes, duplicate_keys
from sparkfolio.llm.packing import pack_documents
from sparkfolio.llm.scans import reflowed, scan_faults
from sparkfolio.llm.spam import find_spam, spam_features
from sparkfolio.session import spread, table


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (src, rec_key, doc, text, title) of chunks and sections; a section's paragraphs are parted by a blank line."""
    chunks = spread(table(spark, sf_dir, "chunks")).select(F.lit("chunk").alias("src"), F.col("chunk_id").alias("rec_key"), F.col("document_id").alias("doc"), "text")
    joined = F.array_join("paragraphs", "\n\n")
    sections = spread(table(spark, sf_dir, "patent_sections")).select(F.lit("section").alias("src"), F.col("section_id").alias("rec_key"), F.col("doc_id").alias("doc"), joined.alias("text"))
    titles = table(spark, sf_dir, "patents").where("doc_id is not null and title is not null").groupBy(F.col("doc_id").alias("doc")).agg(F.min("title").alias("title"))
    return chunks.unionByName(sections).join(titles, "doc", "left")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_faults(_scanned(spark, sf_dir), ["src", "rec_key"]).select("src", "rec_key", "defect", "item").distinct()


def p2_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reflowed(_scanned(spark, sf_dir), ["src", "rec_key"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_spellings(table(spark, sf_dir, "patents"))


def _patent_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (src, key, text) of abstracts and sections; a section's paragraphs are joined by a blank."""
    abstracts = spread(table(spark, sf_dir, "patents")).select(F.lit("abstract").alias("src"), F.col("doc_id").alias("key"), F.col("abstract").alias("text"))
    joined = F.array_join("paragraphs", " ")  # leaves null paragraphs out
    sections = spread(table(spark, sf_dir, "patent_sections")).select(F.lit("section").alias("src"), F.col("section_id").alias("key"), joined.alias("text"))
    return abstracts.unionByName(sections)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(_patent_texts(spark, sf_dir), "key", "text", size=3, least=0.5, within="src")


def p6_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by the likeness of bags: runs of five words count as often as they occur."""
    return duplicate_classes(_patent_texts(spark, sf_dir), "key", "text", within="src")


def _texts_as_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    abstracts = spread(table(spark, sf_dir, "patents")).select(F.lit("abstract").alias("src"), F.col("doc_id").alias("rec_key"), F.col("abstract").alias("text"))
    sections = spread(table(spark, sf_dir, "normalized_sections")).select(F.lit("section").alias("src"), F.col("section_id").alias("rec_key"), F.col("original").alias("text"))
    return abstracts.unionByName(sections)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_oddities(_texts_as_received(spark, sf_dir), ["src", "rec_key"], "text")


def p7_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_text(_texts_as_received(spark, sf_dir), ["src", "rec_key"], "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spread(table(spark, sf_dir, "documents")))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spread(table(spark, sf_dir, "documents")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spam(spread(table(spark, sf_dir, "documents")), lang="lang", known=())


def p10_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_features(spread(table(spark, sf_dir, "documents")), lang="lang", known=())


QUERIES = {f.__name__: f for f in (p2_found, p2_text, p4_found, p6_found, p6_weighted, p7_found, p7_text, p8_ids, p9_containers, p10_found, p10_features)}

#: Encoding, packing and the learned repairs cannot be said in SQL; tests hold them against brute force and exact round trips.
SQL: dict[str, str] = {
    "p6_found": r"""WITH t AS (SELECT DISTINCT 'abstract' AS src, doc_id AS key, abstract AS text FROM patents WHERE doc_id IS NOT NULL AND abstract IS NOT NULL
    UNION SELECT DISTINCT 'section', section_id, array_to_string(paragraphs, ' ') FROM patent_sections WHERE section_id IS NOT NULL AND paragraphs IS NOT NULL),
    i AS (SELECT *, row_number() OVER () AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM t),
    s AS (SELECT src, id, list_distinct([w[x] || ' ' || w[x + 1] || ' ' || w[x + 2] FOR x IN range(1, len(w) - 1)]) AS g FROM i WHERE len(w) > 2),
    e AS (SELECT src, id, unnest(g) AS g FROM s), p AS (SELECT a.src, a.id AS a, b.id AS b, count(*) AS n FROM e a JOIN e b ON a.src = b.src AND a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3),
    f AS (SELECT p.* FROM p JOIN s x ON x.id = a JOIN s y ON y.id = b WHERE n / (len(x.g) + len(y.g) - n) >= 0.5)
    SELECT DISTINCT f.src, least(x.key, y.key) AS key_a, greatest(x.key, y.key) AS key_b FROM f JOIN i x ON x.id = a JOIN i y ON y.id = b WHERE x.key <> y.key""",
    "p6_weighted": r"""WITH RECURSIVE t AS (SELECT DISTINCT 'abstract' AS src, doc_id AS key, abstract AS text FROM patents WHERE doc_id IS NOT NULL AND abstract IS NOT NULL
    UNION SELECT DISTINCT 'section', section_id, array_to_string(paragraphs, ' ') FROM patent_sections WHERE section_id IS NOT NULL AND paragraphs IS NOT NULL),
    u AS (SELECT src, text, row_number() OVER () AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT src, text FROM t)),
    g AS (SELECT src, id, unnest([array_to_string(w[x : x + 4], ' ') FOR x IN range(1, len(w) - 3)]) AS g FROM u WHERE len(w) > 4),
    e AS (SELECT src, id, g, count(*) AS n FROM g GROUP BY ALL), z AS (SELECT id, sum(n) AS n FROM e GROUP BY 1),
    p AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS n FROM e a JOIN e b ON a.src = b.src AND a.g = b.g AND a.id < b.id GROUP BY 1, 2),
    f AS (SELECT a, b FROM p JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE p.n / (x.n + y.n - p.n) >= 0.8),
    m AS (SELECT t.src, t.key, u.id FROM t JOIN u ON u.src = t.src AND u.text = t.text WHERE len(u.w) > 4),
    l AS (SELECT id AS x, count(*) AS links FROM (SELECT a AS id FROM f UNION ALL SELECT b FROM f) GROUP BY 1),
    k AS (SELECT DISTINCT x.src, x.key AS ka, y.key AS kb FROM (SELECT a, b FROM f UNION ALL SELECT b, a FROM f UNION ALL SELECT id, id FROM z) q JOIN m x ON x.id = q.a JOIN m y ON y.id = q.b),
    r AS (SELECT src, ka, kb FROM k UNION SELECT r.src, r.ka, k.kb FROM r JOIN k ON k.src = r.src AND k.ka = r.kb)
    SELECT r.src, r.ka AS key, min(r.kb) AS class_id, CAST(any_value(n.links) AS BIGINT) AS links FROM r
    JOIN (SELECT src, key, coalesce(sum(links), 0) AS links FROM m LEFT JOIN l ON l.x = m.id GROUP BY 1, 2) n ON n.src = r.src AND n.key = r.ka GROUP BY 1, 2""",
}
