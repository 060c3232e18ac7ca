"""Queries over the document model, chunking, formats and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkfolio.functions import offsets
from sparkfolio.functions import text as tx
from sparkfolio.functions.language import MARKERS, detect_language
from sparkfolio.operators import chunking, documents, evaluate
from sparkfolio.session import table
from sparkfolio.sources import corpus, pages, xml
from sparkfolio.streaming import sessions


def _first_delivery(df, keys: list[str], order, cols: list):
    """One row per key with the given columns (names or expressions) of its first delivery; nothing else is read."""
    known = F.lit(True)
    for k in keys:
        known &= F.col(k).isNotNull()
    return df.where(known).groupBy(*keys).agg(F.min_by(F.struct(*cols), order).alias("r")).select(*keys, "r.*")


def _patents(spark, sf_dir, *cols):
    return _first_delivery(table(spark, sf_dir, "patents"), ["doc_id"], F.struct("ingested_at", "record_id"), list(cols))


def _claims(spark, sf_dir, *cols):
    return _first_delivery(table(spark, sf_dir, "patent_claims"), ["doc_id", "number"], F.struct("loaded_at", "claim_id"), list(cols))


def _sections(spark, sf_dir, *cols):
    return _first_delivery(table(spark, sf_dir, "patent_sections"), ["section_id"], F.col("section_row"), list(cols))


def section_kinds(spark, sf_dir):
    return table(spark, sf_dir, "patent_sections").groupBy("heading", documents.section_kind("heading").alias("kind")).agg(F.count("*").alias("n"))


def classifications(spark, sf_dir):
    p = table(spark, sf_dir, "patents")
    return p.select("record_id", F.array_join(documents.cpc_sections("cpc"), "").alias("sections"), F.array_join(documents.cpc_codes("cpc", 3), " ").alias("codes"))


def parsed_dates(spark, sf_dir):
    p = table(spark, sf_dir, "patents")
    return p.select("record_id", *[tx.iso_date(c).alias(c) for c in ("priority_date", "filing_date", "publication_date")], F.year(tx.iso_date("publication_date")).alias("year"))


def chunk_labels(spark, sf_dir):
    c = table(spark, sf_dir, "chunks")
    return c.select("chunk_id", documents.citation_label("document_id", "section", "claim_number", "chunk_id").alias("label"), documents.valid_publication_number("publication_number").alias("valid"))


def full_texts(spark, sf_dir):
    p = _patents(spark, sf_dir, "title", "abstract")
    s = _sections(spark, sf_dir, "doc_id", "ord", "heading", "paragraphs").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "section_id", "heading", F.array_join("paragraphs", "\n\n").alias("text")))).alias("sections"))
    # claims of publications that are no documents here (the largest set among them) are not gathered
    c = _claims(spark, sf_dir, "claim_text").join(p.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", F.col("claim_text").alias("text")))).alias("claims"))
    j = p.join(s, "doc_id", "left").join(c, "doc_id", "left")
    none_s, none_c = F.array().cast("array<struct<ord:int,section_id:string,heading:string,text:string>>"), F.array().cast("array<struct<number:int,text:string>>")
    text = documents.full_text("title", "abstract", F.coalesce("sections", none_s), F.coalesce("claims", none_c))
    return j.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest"))


def manifest(spark, sf_dir):
    return documents.manifest(*(table(spark, sf_dir, t) for t in ("patents", "patent_claims", "patent_sections")))


def document_rollup(spark, sf_dir):
    c = _claims(spark, sf_dir, "dependent_on", F.length("claim_text").alias("chars"))
    independent = F.col("dependent_on").isNull()
    return c.groupBy("doc_id").agg(
        F.count_if(independent).alias("n_independent"), F.count_if(~independent).alias("n_dependent"), F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("claim_chars")
    )


def claim_parents(spark, sf_dir):
    """Each dependent claim with its parent's text length; a parent that isn't there is null."""
    c = _claims(spark, sf_dir, "dependent_on", F.length("claim_text").alias("chars"))
    p = c.select("doc_id", F.col("number").alias("dependent_on"), F.col("chars").alias("parent_chars"), F.lit(True).alias("there"))
    j = c.where("dependent_on is not null").join(p, ["doc_id", "dependent_on"], "left")
    return j.select("doc_id", "number", "dependent_on", "parent_chars", F.coalesce("there", F.lit(False)).alias("resolved"))


def claim_chunks(spark, sf_dir):
    return chunking.claim_chunks(_claims(spark, sf_dir, "claim_text"))


def enriched_claims(spark, sf_dir):
    c = claim_chunks(spark, sf_dir).join(_claims(spark, sf_dir, "dependent_on").select(F.col("doc_id").alias("document_id"), F.col("number").alias("claim_number"), F.col("dependent_on").isNull().alias("independent")), ["document_id", "claim_number"])
    p = _patents(spark, sf_dir, "title", "cpc").withColumnRenamed("doc_id", "document_id")
    text = chunking.enriched("text", "document_id", "title", "claim_number", "independent", "section", "cpc")
    return c.join(p, "document_id").select("document_id", "claim_number", documents.index_text(text, "text").alias("enriched"))


def section_chunks(spark, sf_dir):
    s = _sections(spark, sf_dir, F.array_join("paragraphs", "\n\n").alias("text"))
    return chunking.section_chunks(s, ["section_id"], "text", target=90)


def recursive_chunks(spark, sf_dir):
    return chunking.recursive_chunks(table(spark, sf_dir, "chunks"), "chunk_id", "text")


def offset_roundtrip(spark, sf_dir):
    """Spans of every normalised text that lead back to their original: all of it, and the characters 5 to 40."""
    t = table(spark, sf_dir, "normalized_sections").withColumn("m", offsets.build_offset_map("original"))
    n = F.size("m.orig_start")
    return t.select(
        "section_id", (F.col("m.normalized") == offsets.normalize_text("original")).alias("same"), (offsets.recover_original("m", F.lit(0), n) == F.col("original")).alias("whole"),
        offsets.recover_original("m", F.least(F.lit(5), n), F.least(F.lit(40), n)).alias("part"),
    )


def normalised(spark, sf_dir):
    return table(spark, sf_dir, "normalized_sections").select("section_id", offsets.normalize_text("original").alias("text"))


def languages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang", detect_language("text").alias("detected")).agg(F.count("*").alias("n"))


def title_error_rate(spark, sf_dir):
    """Errors of titles against their lower case: how many letters a reader of lower case gets wrong."""
    return table(spark, sf_dir, "patents").select("record_id", F.round(tx.char_error_rate("title", F.lower("title")), 6).alias("cer"), tx.exact_match("title", F.lower("title")).alias("same"))


def chunk_histogram(spark, sf_dir):
    return documents.length_histogram(table(spark, sf_dir, "chunks"), F.col("token_estimate"), 30)


def chunk_percentiles(spark, sf_dir):
    return evaluate.latency_percentiles(table(spark, sf_dir, "chunks"), "section_kind", "token_estimate")


def compact_xml(spark, sf_dir):
    p = _patents(spark, sf_dir, "title", "abstract", tx.iso_date("publication_date").cast("string").alias("day"))
    first = _claims(spark, sf_dir, "claim_text").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("number"))).where("n <= 5")
    c = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", F.col("claim_text").alias("text")))).alias("claims"))
    j = p.join(c, "doc_id", "left").withColumn("claims", F.coalesce("claims", F.array().cast("array<struct<number:int,text:string>>")))
    return j.select("doc_id", xml.compact_xml("doc_id", "title", "day", "abstract", "claims").alias("xml"))


def compact_xml_valid(spark, sf_dir):
    return compact_xml(spark, sf_dir).select("doc_id", F.size(xml.validate_compact("xml")).alias("errors"), xml.by_local_name("xml", "invention-title").alias("title"))


def index_rows(spark, sf_dir):
    c = table(spark, sf_dir, "patent_claims").where("number is not null").select("doc_id", "number").distinct().groupBy("doc_id").agg(F.count("*").alias("n_claims"))
    p = _patents(spark, sf_dir, "title", "cpc").join(c, "doc_id", "left")
    return p.select("doc_id", "title", F.array_join(F.slice("cpc", 1, 2), " ").alias("cpc"), F.coalesce("n_claims", F.lit(0)).alias("n_claims"))


def named_parents(spark, sf_dir):
    """The least claim that a claim's text names, against the one that its record does."""
    c = table(spark, sf_dir, "patent_claims").select("doc_id", "number", F.col("claim_text").alias("text"), "claim_id")
    return corpus.first_claims(c.where("doc_id is not null and number is not null"), "doc_id", "claim_id").select("doc_id", "number", "dependent_on")


def paragraph_budget(spark, sf_dir):
    s = _sections(spark, sf_dir, "doc_id", "ord", "paragraphs").select("doc_id", "ord", "section_id", F.posexplode("paragraphs").alias("pos", "text"))
    b = corpus.within_budget(s, "doc_id", ["ord", "section_id", "pos"], 6)
    return b.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("ord").alias("last"))


def under_headings(spark, sf_dir):
    """Paragraphs of documents with lines 'word: text' as headings."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    h = corpus.under_headings(d, "doc_id", "pos", F.col("line").rlike(r"^[a-z]+: "), "line")
    return h.groupBy("doc_id", "section", "heading").agg(F.count("*").alias("n"))


def link_hosts(spark, sf_dir):
    links = F.regexp_extract_all("text", F.lit(r"https?://[^\s|<>)\"]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.explode(links).alias("url")).groupBy(tx.url_host("url").alias("host")).agg(F.count("*").alias("n"))


PAGES = (
    (1, '<html><head><title> A <b>pump</b></title><meta name="DC.date" content="2020-01-02"><style>x{}</style></head><body><h1>FIELD</h1><p>one &amp; two</p></body></html>'),
    (2, "<p>no title<script>var a = 1;</script> text</p>"),
    (3, ""),
)


def html_pages(spark, sf_dir):
    p = pages.html_fields(spark.createDataFrame(list(PAGES), "page_id int, html string"), "html")
    return p.select("page_id", "title", "text", F.array_join("dates", ",").alias("dates"), F.array_join("headings", ",").alias("headings"))


def topic_document(spark, sf_dir):
    t = None
    for topic in ("cross-modal", "Pump", "no such thing"):
        r = documents.find_document(table(spark, sf_dir, "patents"), "doc_id", topic).withColumn("topic", F.lit(topic))
        t = r if t is None else t.unionByName(r)
    return t.select("topic", "found")


def numbers_in_claims(spark, sf_dir):
    """Numbers of claims' texts: how many there are, the first, and how many words are nothing but a number."""
    c = table(spark, sf_dir, "patent_claims")
    n = tx.numbers("claim_text")
    alone = F.size(F.filter(F.split("claim_text", " "), tx.is_number))
    return c.select("claim_id", F.size(n).cast("long").alias("n"), F.get(n, F.lit(0)).alias("first"), alone.cast("long").alias("alone"))


BOXES = ((1, 0.0, 0.0, 2.0, 3.0), (2, 5.0, 1.0, 4.0, 2.0))


def box_sizes(spark, sf_dir):
    w, h, ok = documents.box_size("x0", "y0", "x1", "y1")
    return spark.createDataFrame(list(BOXES), "id int, x0 double, y0 double, x1 double, y1 double").select("id", w.alias("width"), h.alias("height"), ok.alias("valid"))


def event_percentiles(spark, sf_dir):
    return evaluate.latency_percentiles(table(spark, sf_dir, "events"), "event_type", "value")


def event_history(spark, sf_dir):
    h = sessions.history(table(spark, sf_dir, "events").where("user_id is not null"), "user_id", "event_id", "event_type")
    return h.select("user_id", "n", F.md5(F.array_join("turns", ",")).alias("digest"))


def event_windows(spark, sf_dir):
    """Extension: events per hour and type."""
    return sessions.windowed(table(spark, sf_dir, "events"), "ts", "1 hour").select("start", "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark, sf_dir):
    """Extension: sessions of users, closed by half an hour without an event."""
    return sessions.sessions(table(spark, sf_dir, "events").where("user_id is not null"), "user_id", "ts", "30 minutes").select("user_id", "start", "n")


def pricing_summary(spark, sf_dir):
    """Extension: the pricing summary over line items."""
    x = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    g = x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(price).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))
    return g.select("l_returnflag", "l_linestatus", F.round("sum_qty", 2).alias("sum_qty"), F.round("revenue", 2).alias("revenue"), F.round("avg_disc", 6).alias("avg_disc"), "n")


def segment_revenue(spark, sf_dir):
    """Extension: revenue by segment and nation over four joined tables."""
    line, orders, customer, nation = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == customer["c_custkey"]).join(nation, F.col("c_nationkey") == nation["n_nationkey"])
    return j.groupBy("c_mktsegment", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


QUERIES = {
    f.__name__: f
    for f in (
        section_kinds, classifications, parsed_dates, chunk_labels, full_texts, manifest, document_rollup, claim_parents, claim_chunks, enriched_claims, section_chunks, recursive_chunks, offset_roundtrip, normalised, languages,
        title_error_rate, chunk_histogram, chunk_percentiles, compact_xml, compact_xml_valid, index_rows, named_parents, paragraph_budget, under_headings, link_hosts, html_pages, topic_document, numbers_in_claims, box_sizes, event_percentiles, event_history, event_windows,
        event_sessions, pricing_summary, segment_revenue,
    )
}

_P = "p AS (SELECT * FROM patents WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ingested_at, record_id) = 1)"
_C = "c AS (SELECT doc_id, number, claim_text, dependent_on FROM patent_claims WHERE doc_id IS NOT NULL AND number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY loaded_at, claim_id) = 1)"
_S = "s AS (SELECT * FROM patent_sections WHERE section_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY section_row) = 1)"
_DATE = "CASE WHEN regexp_matches(left({0}, 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN TRY_CAST(left({0}, 10) AS DATE) END"
_NL2 = "chr(10) || chr(10)"
_CHUNK_ID = "left(sha1(doc_id || '|claim' || number || '|0|' || claim_text), 12)"
_EST = r"CAST(len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}]')) AS INT)"


def _escaped(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _kind_sql() -> str:
    out = r"CASE WHEN h IN ('claims', 'claim') OR contains(h, 'what is claimed') OR starts_with(h, 'claims') THEN 'claims'"
    for name, needles in documents.HEADINGS:
        out += " WHEN " + " OR ".join(f"contains(h, '{n}')" for n in needles) + f" THEN '{name}'"
    return out + " ELSE 'other' END"


def _language_sql() -> str:
    counts = {lang: f"len([w FOR w IN w IF w IN ({', '.join(repr(m) for m in marks)})])" for lang, marks in MARKERS.items()}
    cols = ", ".join(f"{n} AS {lang}" for lang, n in counts.items())
    best = "greatest(" + ", ".join([*counts, "ja"]) + ")"
    case = "CASE WHEN length(t) < 3 OR b = 0 THEN 'unknown' WHEN ja = b THEN 'ja' " + " ".join(f"WHEN {lang} = b THEN '{lang}'" for lang in counts) + " END"
    return rf"""WITH a AS (SELECT lang, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents), k AS (SELECT lang, t, string_split_regex(lower(t), '[^\p{{L}}]+') AS w, length(t) - length(regexp_replace(t, '[ぁ-ゖ]', '', 'g')) AS ja FROM a),
    n AS (SELECT lang, t, ja, {cols} FROM k), o AS (SELECT *, {best} AS b FROM n) SELECT lang, {case} AS detected, count(*) AS n FROM o GROUP BY 1, 2"""


_PAGES = ", ".join(f"({i}, '{h}')" for i, h in PAGES)
SQL = {
    "section_kinds": rf"SELECT heading, {_kind_sql()} AS kind, count(*) AS n FROM (SELECT heading, lower(regexp_replace(coalesce(heading, ''), '^\s+|\s+$', '', 'g')) AS h FROM patent_sections) GROUP BY 1, 2",
    "classifications": r"""SELECT record_id, array_to_string(list_sort(list_distinct([left(x, 1) FOR x IN cpc IF x <> ''])), '') AS sections,
    array_to_string([x FOR x, i IN cpc IF regexp_matches(x, '^[A-H]\d\d[A-Z]') AND list_position(cpc, x) = i][1:3], ' ') AS codes FROM patents""",
    "parsed_dates": "SELECT record_id, " + ", ".join(f"{_DATE.format(c)} AS {c}" for c in ("priority_date", "filing_date", "publication_date")) + f", CAST(year({_DATE.format('publication_date')}) AS INT) AS year FROM patents",
    "chunk_labels": r"""SELECT chunk_id, '[PATENT=' || coalesce(document_id, '') || CASE WHEN coalesce(section, '') <> '' THEN ' | SECTION=' || section ELSE '' END || CASE WHEN claim_number IS NOT NULL THEN ' | CLAIM=' || claim_number ELSE '' END
    || CASE WHEN coalesce(chunk_id, '') <> '' THEN ' | CHUNK=' || chunk_id ELSE '' END || ']' AS label, coalesce(regexp_matches(regexp_replace(publication_number, '^\s+|\s+$', '', 'g'), '^[A-Z]{2}\d{5,}[A-Z]\d?$'), FALSE) AS valid FROM chunks""",
    "full_texts": f"""WITH {_P}, {_C}, {_S}, ss AS (SELECT doc_id, string_agg(coalesce(heading, '') || chr(10) || coalesce(array_to_string(paragraphs, {_NL2}), ''), {_NL2} ORDER BY ord NULLS FIRST, section_id) AS t FROM s GROUP BY 1),
    cc AS (SELECT doc_id, string_agg('Claim ' || number || '. ' || coalesce(claim_text, ''), {_NL2} ORDER BY number) AS t FROM c GROUP BY 1),
    f AS (SELECT p.doc_id, concat_ws({_NL2}, nullif(title, ''), nullif(abstract, ''), ss.t, cc.t) AS t FROM p LEFT JOIN ss ON ss.doc_id = p.doc_id LEFT JOIN cc ON cc.doc_id = p.doc_id)
    SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest FROM f""",
    "manifest": "SELECT (SELECT count(DISTINCT doc_id) FROM patents) AS n_docs, (SELECT count(*) FROM (SELECT DISTINCT doc_id, number FROM patent_claims)) AS n_claims, (SELECT count(DISTINCT section_id) FROM patent_sections) AS n_sections",
    "document_rollup": f"WITH {_C} SELECT doc_id, count(*) FILTER (WHERE dependent_on IS NULL) AS n_independent, count(*) FILTER (WHERE dependent_on IS NOT NULL) AS n_dependent, CAST(coalesce(sum(length(claim_text)), 0) AS BIGINT) AS claim_chars FROM c GROUP BY 1",
    "claim_parents": f"WITH {_C} SELECT c.doc_id, c.number, c.dependent_on, CAST(length(q.claim_text) AS INT) AS parent_chars, q.doc_id IS NOT NULL AS resolved FROM c LEFT JOIN c q ON q.doc_id = c.doc_id AND q.number = c.dependent_on WHERE c.dependent_on IS NOT NULL",
    "claim_chunks": f"WITH {_C} SELECT {_CHUNK_ID} AS chunk_id, doc_id AS document_id, 'Claims' AS section, 'claims' AS section_kind, number AS claim_number, claim_text AS text, {_EST.format('claim_text')} AS token_estimate FROM c WHERE claim_text IS NOT NULL",
    "enriched_claims": f"""WITH {_P}, {_C} SELECT c.doc_id AS document_id, number AS claim_number, 'Patent ' || c.doc_id || ': ' || coalesce(title, '') || ' | Claim ' || number || CASE WHEN dependent_on IS NULL THEN ' (independent claim)' ELSE ' (dependent claim)' END
    || CASE WHEN len(cpc) > 0 THEN coalesce(' | CPC: ' || cpc[1], '') ELSE '' END || chr(10) || claim_text AS enriched FROM c JOIN p ON p.doc_id = c.doc_id WHERE claim_text IS NOT NULL""",
    "normalised": "SELECT section_id, nfc_normalize(original) AS text FROM normalized_sections",
    "languages": _language_sql(),
    "title_error_rate": r"""SELECT record_id, round(CASE WHEN length(a) = 0 THEN 0.0 ELSE levenshtein(a, b) / length(a) END, 6) AS cer, lower(regexp_replace(title, '^\s+|\s+$', '', 'g')) = lower(regexp_replace(lower(title), '^\s+|\s+$', '', 'g')) AS same
    FROM (SELECT record_id, title, trim(regexp_replace(title, '\s+', ' ', 'g')) AS a, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS b FROM patents)""",
    "chunk_histogram": """SELECT CAST(CASE WHEN hi = lo THEN 1 ELSE least(30, floor((v - lo) * 30 / (hi - lo)) + 1) END AS INT) AS bin, count(*) AS n FROM (SELECT CAST(token_estimate AS DOUBLE) AS v FROM chunks WHERE token_estimate IS NOT NULL),
    (SELECT CAST(min(token_estimate) AS DOUBLE) AS lo, CAST(max(token_estimate) AS DOUBLE) AS hi FROM chunks) GROUP BY 1""",
    "chunk_percentiles": "SELECT section_kind, count(token_estimate) AS n, round(quantile_cont(CAST(token_estimate AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(token_estimate AS DOUBLE), 0.95), 6) AS p95 FROM chunks GROUP BY 1",
    "compact_xml": f"""WITH {_P}, {_C}, k AS (SELECT doc_id, string_agg('    <claim num="' || number || '"><claim-text>' || {_escaped("coalesce(claim_text, '')")} || '</claim-text></claim>' || chr(10), '' ORDER BY number) AS t
    FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY number) <= 5) GROUP BY 1)
    SELECT p.doc_id, '<patent-document lang="en" country="US" doc-number="' || {_escaped('p.doc_id')} || '" kind="B2">' || chr(10) || '  <bibliographic-data>' || chr(10) || '    <invention-title>' || {_escaped("coalesce(title, '')")} || '</invention-title>' || chr(10)
    || '    <publication-date>' || coalesce(CAST({_DATE.format('publication_date')} AS VARCHAR), '') || '</publication-date>' || chr(10) || '  </bibliographic-data>' || chr(10)
    || CASE WHEN coalesce(abstract, '') <> '' THEN '  <abstract>' || chr(10) || '    <p>' || {_escaped('abstract')} || '</p>' || chr(10) || '  </abstract>' || chr(10) ELSE '' END
    || CASE WHEN k.t IS NOT NULL THEN '  <claims>' || chr(10) || k.t || '  </claims>' || chr(10) ELSE '' END || '</patent-document>' AS xml FROM p LEFT JOIN k ON k.doc_id = p.doc_id""",
    "compact_xml_valid": f"WITH {_P} SELECT doc_id, CAST(0 AS INT) AS errors, nullif(trim(title), '') AS title FROM p",
    "index_rows": f"WITH {_P}, {_C}, n AS (SELECT doc_id, count(*) AS n_claims FROM c GROUP BY 1) SELECT p.doc_id, title, array_to_string(cpc[1:2], ' ') AS cpc, coalesce(n_claims, 0) AS n_claims FROM p LEFT JOIN n ON n.doc_id = p.doc_id",
    "named_parents": r"""SELECT doc_id, number, list_min([CAST(x AS INT) FOR x IN regexp_extract_all(claim_text, 'claim\s+(\d+)', 1)]) AS dependent_on FROM patent_claims WHERE doc_id IS NOT NULL AND number IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY claim_id) = 1""",
    "paragraph_budget": f"""WITH {_S}, x AS (SELECT doc_id, ord, section_id, unnest(range(0, len(paragraphs))) AS pos FROM s), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord NULLS FIRST, section_id, pos) AS n FROM x)
    SELECT doc_id, count(*) AS n, max(ord) AS last FROM y WHERE n <= 6 GROUP BY 1""",
    "under_headings": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL), m AS (SELECT *, regexp_matches(line, '^[a-z]+: ') AS is_h FROM l),
    w AS (SELECT *, coalesce(last_value(CASE WHEN is_h THEN CASE WHEN regexp_replace(line, '^\s+|\s+$', '', 'g') = '' THEN 'SECTION' ELSE regexp_replace(line, '^\s+|\s+$', '', 'g') END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'DESCRIPTION') AS heading,
    CAST(sum(CASE WHEN is_h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM m) SELECT doc_id, section, heading, count(*) AS n FROM w WHERE NOT is_h GROUP BY 1, 2, 3""",
    "link_hosts": r"""SELECT lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]+)', 1)) AS host, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, 'https?://[^\s|<>)"]+')) AS url FROM documents) GROUP BY 1""",
    "html_pages": rf"""WITH h AS (SELECT * FROM (VALUES {_PAGES}) AS t(page_id, html)), s AS (SELECT *, regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM h)
    SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title,
    trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS text,
    array_to_string(regexp_extract_all(html, '(?i)<meta[^>]*name="DC.date"[^>]*content="([^"]*)"', 1), ',') AS dates,
    array_to_string([trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) FOR x IN regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)], ',') AS headings FROM s""",
    "topic_document": " UNION ALL ".join(f"SELECT '{t}' AS topic, coalesce(min(doc_id), 'none') AS found FROM patents WHERE contains(lower(concat_ws(' ', title, abstract)), lower('{t}'))" for t in ("cross-modal", "Pump", "no such thing")),
    "numbers_in_claims": r"""SELECT claim_id, CAST(len(regexp_extract_all(claim_text, '\d[\d.,]*')) AS BIGINT) AS n, regexp_extract_all(claim_text, '\d[\d.,]*')[1] AS first,
    CAST(len([x FOR x IN string_split(claim_text, ' ') IF regexp_full_match(x, '\d[\d.,]*')]) AS BIGINT) AS alone FROM patent_claims""",
    "box_sizes": "SELECT id, CAST(x1 - x0 AS DOUBLE) AS width, CAST(y1 - y0 AS DOUBLE) AS height, x1 >= x0 AS valid FROM (VALUES " + ", ".join(map(str, BOXES)) + ") AS t(id, x0, y0, x1, y1)",
    "event_percentiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1",
    "event_history": "SELECT user_id, count(*) AS n, md5(string_agg(event_type, ',' ORDER BY event_id)) AS digest FROM events WHERE user_id IS NOT NULL GROUP BY 1",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, s""",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    "segment_revenue": """SELECT c_mktsegment, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
}
