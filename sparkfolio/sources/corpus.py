"""Corpus records from JSON files, from tables of a crawl, and from a query service; and the sinks for records and artifacts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.functions.text import iso_date, strip

#: One record per file; fields that may be missing are null.
RECORD = """doc_id string, publication_number string, application_number string, title string, abstract string, assignees array<string>, inventors array<string>,
priority_date string, filing_date string, publication_date string, cpc array<string>, ipc array<string>, citations array<string>, language string, access_level string,
claims array<struct<number:int,text:string,dependent_on:int>>, description array<struct<heading:string,paragraphs:array<string>>>, pdf_url string, source map<string,string>"""


def read_corpus(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Rows of RECORD with the file they are from, one record per file; no file at all is an error."""
    df = spark.read.schema(RECORD).option("multiLine", True).option("pathGlobFilter", pattern).json(folder).withColumn("file", F.col("_metadata.file_path"))
    if df.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return df


def canonical(records: DataFrame) -> DataFrame:
    """Documents of records: dates read (a bad one is null), missing lists empty, and the abstract and description as sections.

    A section is (section_id, heading, text, ord): the abstract, if any, first as {doc}:abstract, then {doc}:sec{n} with the paragraphs joined
    by blank lines.
    """
    has = F.coalesce("abstract", F.lit("")) != ""
    first = F.when(has, F.array(F.struct(F.concat("doc_id", F.lit(":abstract")).alias("section_id"), F.lit("Abstract").alias("heading"), F.col("abstract").alias("text"), F.lit(0).alias("ord"))))
    base = F.when(has, 1).otherwise(0)
    blocks = F.coalesce("description", F.array().cast("array<struct<heading:string,paragraphs:array<string>>>"))
    rest = F.transform(
        blocks,
        lambda b, i: F.struct(
            F.concat("doc_id", F.lit(":sec"), (i + base).cast("string")).alias("section_id"),
            b["heading"].alias("heading"),
            F.array_join(b["paragraphs"], "\n\n").alias("text"),
            (i + base).cast("int").alias("ord"),
        ),
    )
    empty = F.array().cast("array<string>")
    dates = {d: iso_date(d) for d in ("priority_date", "filing_date", "publication_date")}
    lists = {c: F.coalesce(c, empty) for c in ("assignees", "inventors", "cpc", "ipc", "citations")}
    sections = F.concat(F.coalesce(first, F.array().cast("array<struct<section_id:string,heading:string,text:string,ord:int>>")), rest)
    more = {"language": F.coalesce("language", F.lit("en")), "access_level": F.coalesce("access_level", F.lit("public")), "sections": sections}
    return records.withColumns({**dates, **lists, **more}).drop("description")


def acceptable(records: DataFrame, claims: int = 2, paragraphs: int = 5) -> DataFrame:
    """Records with enough claims and paragraphs to be worth keeping."""
    n = F.aggregate(F.coalesce("description", F.array().cast("array<struct<heading:string,paragraphs:array<string>>>")), F.lit(0), lambda a, b: a + F.greatest(F.size(b["paragraphs"]), F.lit(0)))
    return records.where((F.coalesce(F.size("claims"), F.lit(0)) >= claims) & (n >= paragraphs))


def write_records(docs: DataFrame, folder: str) -> None:
    """One JSON file set per corpus; file sizes are Spark's business, one file per record doesn't scale."""
    docs.write.mode("overwrite").json(folder)


def index_rows(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, title, cpc, n_claims) of an index: two classifications, the number of claims."""
    return docs.select("doc_id", "title", F.slice("cpc", 1, 2).alias("cpc"), F.size("claims").alias("n_claims"))


# ------------------------------------------------------------------ paragraphs under headings


def under_headings(lines: DataFrame, key: str, order: str, is_heading, text: str, default: str = "DESCRIPTION") -> DataFrame:
    """Rows (key, heading, section, order, text) of the paragraphs of documents, each under the heading before it.

    `lines` are the headings and paragraphs of a document in order; a blank heading reads SECTION, and headings without
    paragraphs are gone.
    """
    w = Window.partitionBy(key).orderBy(order)
    h = F.when(is_heading, F.when(strip(text) == "", "SECTION").otherwise(strip(text)))
    marked = lines.withColumn("heading", F.coalesce(F.last(h, ignorenulls=True).over(w), F.lit(default))).withColumn("section", F.sum(F.when(is_heading, 1).otherwise(0)).over(w))
    return marked.where(~is_heading).select(key, "heading", "section", order, text)


def within_budget(paragraphs: DataFrame, key: str, order: list[str], budget: int = 60) -> DataFrame:
    """The first `budget` paragraphs of each document, across its sections."""
    return paragraphs.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= budget).drop("__n")


def first_claims(claims: DataFrame, key: str, order: str) -> DataFrame:
    """Rows (key, number, text, dependent_on) of claims (key, number, text): the first of each number; it depends on the least claim it names."""
    w = Window.partitionBy(key, "number").orderBy(order)
    named = F.array_min(F.transform(F.regexp_extract_all("text", F.lit(r"claim\s+(\d+)"), F.lit(1)), lambda x: x.try_cast("int")))
    return claims.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(key, "number", "text", named.alias("dependent_on"))


def claim_text(text):
    """A claim's text without its number and with single blanks."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^\d+\s*\.\s*", "")


def fetch(get: Callable[[str], bytes], url: str, tries: int = 5, pause: float = 3.0) -> bytes:
    """get(url), tried again with a pause that grows by `pause`; the last error is raised. For ingestion outside the engine."""
    for i in range(tries):
        try:
            return get(url)
        except Exception:
            if i == tries - 1:
                raise
            time.sleep(pause * (i + 1))
    raise AssertionError


def accepted_numbers(found: DataFrame, number: str, want: int) -> DataFrame:
    """The first `want` granted publications per query of a search (query_id, position, number)."""
    ok = found.where(F.col(number).rlike(r"^US\d+B[12]$"))
    return ok.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).where(F.col("__n") <= want).drop("__n")
