"""The document model: section kinds, claims, classifications, labels, validation and manifests as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.text import col, strip

SECTION_KINDS = ("abstract", "technical_field", "background", "summary", "brief_description_drawings", "detailed_description", "claims", "other")
# What a heading contains, in the order it is looked for.
HEADINGS = (
    ("technical_field", ("technical field", "field of")),
    ("background", ("background",)),
    ("summary", ("summary",)),
    ("brief_description_drawings", ("brief description of the draw", "description of the draw")),
    ("detailed_description", ("detailed description", "detailed desc", "embodiment")),
    ("abstract", ("abstract",)),
)
PUBLICATION_NUMBER = r"^[A-Z]{2}\d{5,}[A-Z]\d?$"
CPC_CODE = r"^[A-H]\d\d[A-Z]"


def section_kind(heading) -> Column:
    """Kind of a section by its heading; a null heading is 'other'."""
    h = F.lower(strip(F.coalesce(col(heading), F.lit(""))))
    kind = F.when(h.isin("claims", "claim") | h.contains("what is claimed") | h.startswith("claims"), "claims")
    for name, needles in HEADINGS:
        hit = F.lit(False)
        for n in needles:
            hit |= h.contains(n)
        kind = kind.when(hit, name)
    return kind.otherwise("other")


def cpc_sections(cpc) -> Column:
    """Sorted distinct first letters of the non-empty codes."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(col(cpc), lambda c: c != ""), lambda c: F.substring(c, 1, 1))))


def cpc_codes(cpc, most: int = 12) -> Column:
    """The first `most` distinct codes that look like classifications, in order."""
    return F.slice(F.array_distinct(F.filter(col(cpc), lambda c: c.rlike(CPC_CODE))), 1, most)


def index_text(enriched, text) -> Column:
    """The enriched text, or the text where that is null or empty."""
    return F.coalesce(F.nullif(col(enriched), F.lit("")), col(text))


def citation_label(document, section, claim_number, chunk_id) -> Column:
    """[PATENT=... | SECTION=... | CLAIM=... | CHUNK=...]; empty parts are left out, claim 0 is not empty."""

    def part(name: str, x: Column, there: Column) -> Column:
        return F.when(there, F.concat(F.lit(f"{name}="), x.cast("string")))

    s, k, c = (F.coalesce(col(x), F.lit("")) for x in (section, chunk_id, document))
    body = F.concat_ws(" | ", F.concat(F.lit("PATENT="), c), part("SECTION", s, s != ""), part("CLAIM", col(claim_number), col(claim_number).isNotNull()), part("CHUNK", k, k != ""))
    return F.concat(F.lit("["), body, F.lit("]"))


def box_size(x0, y0, x1, y1) -> tuple[Column, Column, Column]:
    """(width, height, whether the box is valid): x1 >= x0 is asked for, an order of y is not."""
    return col(x1) - col(x0), col(y1) - col(y0), col(x1) >= col(x0)


def word_anchor(document, page, x0, y0, x1, y1) -> Column:
    """The place of a word on a page."""
    box = F.struct(col(page).alias("page"), *[col(v).cast("double").alias(n) for v, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"))])
    return F.struct(col(document).alias("document_id"), col(page).alias("page"), box.alias("bbox"))


def full_text(title, abstract, sections, claims) -> Column:
    """Title, abstract, heading and text of the sections, and the claims, parted by blank lines; empty parts are left out."""
    head = F.array(F.coalesce(col(title), F.lit("")), F.coalesce(col(abstract), F.lit("")))
    body = F.transform(col(sections), lambda s: F.concat(F.coalesce(s["heading"], F.lit("")), F.lit("\n"), F.coalesce(s["text"], F.lit(""))))
    last = F.transform(col(claims), lambda c: F.concat(F.lit("Claim "), c["number"].cast("string"), F.lit(". "), F.coalesce(c["text"], F.lit(""))))
    return F.array_join(F.filter(F.concat(head, body, last), lambda t: t != ""), "\n\n")


def query_argument_errors(query, top_k) -> Column:
    """What is wrong with search arguments: query of 2 to 400 characters, top_k of 1 to 50."""
    n, k = F.length(col(query)), col(top_k)
    return F.array_compact(
        F.array(
            F.when(col(query).isNull() | (n < 2), "query too short"),
            F.when(n > 400, "query too long"),
            F.when(k.isNull() | (k < 1), "top_k below 1"),
            F.when(k > 50, "top_k above 50"),
        )
    )


def valid_publication_number(text) -> Column:
    return F.coalesce(strip(text).rlike(PUBLICATION_NUMBER), F.lit(False))


def manifest(patents: DataFrame, claims: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: documents, claims and sections of a corpus, each counted once however often it was delivered."""
    d = patents.agg(F.count_distinct("doc_id").alias("n_docs"))
    c = claims.select("doc_id", "number").distinct().agg(F.count("*").alias("n_claims"))
    s = sections.agg(F.count_distinct("section_id").alias("n_sections"))
    return d.crossJoin(c).crossJoin(s)  # one row each


def find_document(docs: DataFrame, key: str, topic: str) -> DataFrame:
    """One row: the first document by key whose title and abstract hold the topic, 'none' if there is none."""
    hit = F.contains(F.lower(F.concat_ws(" ", "title", "abstract")), F.lit(topic.lower()))
    return docs.where(hit).agg(F.coalesce(F.min(key), F.lit("none")).alias("found"))


def length_histogram(df: DataFrame, value, bins: int = 30) -> DataFrame:
    """Rows (bin, n): equal-width bins from the least to the greatest value, which is in the last bin."""
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    b = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.lit(bins), F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1))
    return v.crossJoin(F.broadcast(ends)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def unexpected_keys(json_text, allowed: tuple[str, ...]) -> Column:
    """Names of a JSON object that are not allowed; null for a text that is none."""
    return F.array_except(F.json_object_keys(col(json_text)), F.array(*map(F.lit, allowed)))


def constraint_errors(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks; a rule that is null for a row is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()]))
