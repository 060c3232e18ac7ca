"""Queries over references, nested records and hierarchies, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.operators.flatten import flatten, typed_table, write_tables
from sparkfolio.operators.hierarchy import circles, descendants, hierarchy
from sparkfolio.operators.references import citation_references, claim_references, orphan_references, reference_counts
from sparkfolio.session import cut, ensure_checkpoint_dir, table


def _references(spark: SparkSession, sf_dir: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    claims, patents, prior = (table(spark, sf_dir, t) for t in ("patent_claims", "patents", "prior_art"))
    return {"patent_claims": claim_references(claims), "patents": citation_references(patents, prior)}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(_references(spark, sf_dir))


def p1_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_counts(_references(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten(table(spark, sf_dir, "patent_intake"), "record_id", "payload", payload=False).drop("node_depth")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all tables, written once for each input of a session, partitioned by tag; a table is one folder of it."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _WRITTEN:
        folder = f"{ensure_checkpoint_dir(spark)}/tagged/{uuid.uuid4().hex}"
        write_tables(flatten(table(spark, sf_dir, "patent_intake"), "record_id", "payload", root="record"), folder)
        _WRITTEN[at] = folder
    return spark.read.schema(TAGGED).parquet(_WRITTEN[at])


_WRITTEN: dict[tuple[str, str], str] = {}
TAGGED = "record_id bigint, node_path string, parent_path string, node_depth int, body string, child_kind string"


def _p3_table(tag: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return typed_table(_tagged(spark, sf_dir), tag)

    return query


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "patent_claims")


def _claim_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(_claims(spark, sf_dir), "doc_id", "number", "dependent_on", ("loaded_at", "claim_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _claim_trees(spark, sf_dir)
    return t.select("doc_id", F.col("number").cast("int"), F.col("root").cast("int").alias("root_number"), F.col("node_depth").cast("int"), "node_path")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL walks from roots only: it lacks the pairs of the claims on circles and below them, which come out here."""
    d = descendants(cut(_claim_trees(spark, sf_dir)), "doc_id", "number", _claims(spark, sf_dir), "dependent_on", ("loaded_at", "claim_id"))
    return d.select("doc_id", F.col("number").cast("int"), F.col("descendant").cast("int"), F.col("distance").cast("int"))


def p5_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = circles(_claim_trees(spark, sf_dir), _claims(spark, sf_dir), "doc_id", "number", "dependent_on", ("loaded_at", "claim_id"))
    return c.select("doc_id", F.col("circle").cast("int"), F.col("number").cast("int"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p3_found, p5_found, p5_descendants, p5_circles)}
QUERIES |= {f"p3_{t}s": _p3_table(t) for t in ("record", "assignee", "contact", "claim", "limitation", "section", "paragraph")}

_P1 = r"""
WITH c AS (SELECT doc_id, number, min(loaded_at) AS born, min(cancelled_at) AS gone FROM patent_claims
           WHERE doc_id IS NOT NULL AND number IS NOT NULL GROUP BY 1, 2),
cr AS (SELECT DISTINCT doc_id, number, dependent_on FROM patent_claims
       WHERE doc_id IS NOT NULL AND number IS NOT NULL AND dependent_on IS NOT NULL),
a AS (SELECT 'patent_claims' AS ref_table, r.doc_id, CAST(r.number AS VARCHAR) AS ref_from, CAST(r.dependent_on AS VARCHAR) AS ref_to,
             k.born AS seen, t.born, t.gone, t.doc_id IS NOT NULL AS known
      FROM cr r JOIN c k ON k.doc_id = r.doc_id AND k.number = r.number
      LEFT JOIN c t ON t.doc_id = r.doc_id AND t.number = r.dependent_on),
p AS (SELECT doc_id, min(b) AS born, min(g) AS gone FROM (
        SELECT doc_id, ingested_at AS b, removed_at AS g FROM patents UNION ALL SELECT doc_id, registered_at, removed_at FROM prior_art)
      WHERE doc_id IS NOT NULL GROUP BY 1),
pb AS (SELECT doc_id, min(ingested_at) AS seen FROM patents WHERE doc_id IS NOT NULL GROUP BY 1),
pr AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, regexp_replace(upper(x), '[^\p{L}\p{N}]', '', 'g') AS k
        FROM (SELECT doc_id, unnest(citations) AS x FROM patents WHERE doc_id IS NOT NULL))
       WHERE regexp_matches(k, '^[A-Z]{2}[0-9]{4,}[A-Z][0-9]?$')),
b AS (SELECT 'patents' AS ref_table, r.doc_id, '' AS ref_from, r.k AS ref_to, pb.seen, t.born, t.gone, t.doc_id IS NOT NULL AS known
      FROM pr r JOIN pb ON pb.doc_id = r.doc_id LEFT JOIN p t ON t.doc_id = r.k),
u AS (SELECT *, CASE WHEN NOT known THEN 'missing' WHEN gone <= seen THEN 'deleted' WHEN born > seen THEN 'late' END AS ref_state
      FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
"""
_TREE = """
WITH RECURSIVE n AS (SELECT doc_id, number, arg_min(coalesce(dependent_on, -1), (loaded_at, claim_id)) AS up FROM patent_claims
                     WHERE doc_id IS NOT NULL AND number IS NOT NULL GROUP BY 1, 2),
w AS (SELECT n.doc_id, n.number, n.number AS root, 0 AS d, CAST(n.number AS VARCHAR) AS path FROM n
      LEFT JOIN n q ON q.doc_id = n.doc_id AND q.number = n.up WHERE q.number IS NULL
      UNION ALL
      SELECT n.doc_id, n.number, w.root, w.d + 1, w.path || '/' || n.number FROM w JOIN n ON n.doc_id = w.doc_id AND n.up = w.number)
"""
_P3 = r"""
WITH v AS (SELECT record_id, CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'OBJECT' THEN payload END END AS p FROM patent_intake),
t AS (SELECT record_id, substr(fullkey, 3) AS k FROM v, json_tree(v.p) j
      WHERE v.p IS NOT NULL AND type <> 'NULL' AND fullkey <> '$' AND (type <> 'ARRAY' OR ends_with(fullkey, ']')) AND NOT contains(fullkey, '][')),
u AS (SELECT record_id, [CASE WHEN ends_with(x, ']') THEN x ELSE x || '[0]' END FOR x IN string_split(k, '.')] AS parts, regexp_replace(k, '\[\d+\]', '', 'g') AS names FROM t),
w AS (SELECT *, CASE WHEN names = 'assignees' THEN 'assignee' WHEN names = 'assignees.contacts' THEN 'contact' WHEN names = 'claims' THEN 'claim'
      WHEN regexp_full_match(names, 'claims\.limitations(\.sub)*') THEN 'limitation' WHEN regexp_full_match(names, '(sections|description)(\.subsections)*') THEN 'section'
      WHEN regexp_full_match(names, '(sections|description)(\.subsections)*\.paragraphs') THEN 'paragraph' END AS child_kind FROM u)
SELECT record_id, child_kind, array_to_string(parts, '.') AS node_path, array_to_string(parts[1 : len(parts) - 1], '.') AS parent_path FROM w WHERE child_kind IS NOT NULL
"""
_P3_ROWS = _P3[: _P3.rindex("SELECT record_id, child_kind")].replace("substr(fullkey, 3) AS k FROM", "substr(fullkey, 3) AS k, j.value AS x, j.type AS kind FROM").replace("SELECT record_id, [CASE", "SELECT record_id, x, kind, [CASE")


def _p3_sql(tag: str, **columns: str) -> str:
    """SQL of the table of a tag: its columns by their paths in an element; '' is a lone value. Nothing of the given payloads is left for `rest`."""
    cols = "".join(f", {expr} AS {name}" for name, expr in columns.items())
    return _P3_ROWS + f"""SELECT record_id, array_to_string(parts, '.') AS node_path, array_to_string(parts[1 : len(parts) - 1], '.') AS parent_path, CAST(len(parts) AS INT) AS node_depth{cols}, CAST(NULL AS VARCHAR) AS rest
    FROM w WHERE child_kind = '{tag}'"""


def _field(path: str, kind: str = "VARCHAR") -> str:
    return f"TRY_CAST(CASE WHEN kind = 'OBJECT' THEN x ->> '$.{path}' END AS {kind})"


_LONE = "CASE WHEN kind NOT IN ('OBJECT', 'ARRAY') THEN x ->> '$' END"
SQL = {
    "p3_found": _P3,
    "p3_records": _P3[: _P3.index(",\nt AS")] + """ SELECT record_id, '' AS node_path, '' AS parent_path, CAST(0 AS INT) AS node_depth, p ->> '$.doc_id' AS doc_id, p ->> '$.title' AS title, p ->> '$.source.provider' AS source_provider,
    p ->> '$.source.note' AS source_note, CAST(NULL AS VARCHAR) AS rest FROM v WHERE p IS NOT NULL""",
    "p3_assignees": _p3_sql("assignee", name=f"coalesce({_field('name')}, {_LONE})", address_city=_field("address.city"), address_country=_field("address.country")),
    "p3_contacts": _p3_sql("contact", type=_field("type"), value=_field("value")),
    "p3_claims": _p3_sql("claim", number=_field("number", "INT"), text=_field("text"), dependent_on=f"coalesce({_field('dependent_on', 'INT')}, {_field('dependentOn', 'INT')})"),
    "p3_limitations": _p3_sql("limitation", text=_field("text"), label=_field("label")),
    "p3_sections": _p3_sql("section", heading=_field("heading")),
    "p3_paragraphs": _p3_sql("paragraph", text=_LONE),
    "p5_circles": _TREE
    + """, bad AS (SELECT n.* FROM n LEFT JOIN w ON w.doc_id = n.doc_id AND w.number = n.number WHERE w.number IS NULL),
    r AS (SELECT doc_id, number AS s, up AS c FROM bad UNION SELECT r.doc_id, r.s, b.up FROM r JOIN bad b ON b.doc_id = r.doc_id AND b.number = r.c),
    o AS (SELECT doc_id, s FROM r WHERE s = c) SELECT r.doc_id, CAST(min(r.c) AS INT) AS circle, r.s AS number FROM r JOIN o ON o.doc_id = r.doc_id AND o.s = r.s GROUP BY r.doc_id, r.s""",
    "p1_found": _P1 + "SELECT ref_table, doc_id, ref_from, ref_to, ref_state, strftime(seen, '%Y-%m') AS ref_month FROM u WHERE ref_state IS NOT NULL",
    "p1_counts": _P1 + "SELECT ref_table, strftime(seen, '%Y-%m') AS ref_month, ref_state, count(*) AS refs FROM u WHERE ref_state IS NOT NULL GROUP BY 1, 2, 3",
    "p5_found": _TREE
    + """SELECT n.doc_id, n.number, coalesce(w.root, -1) AS root_number, coalesce(w.d, -1) AS node_depth, coalesce(w.path, '') AS node_path
    FROM n LEFT JOIN w ON w.doc_id = n.doc_id AND w.number = n.number""",
    "p5_descendants": _TREE
    + """SELECT doc_id, CAST(a AS INT) AS number, number AS descendant, CAST(d - i + 1 AS INT) AS distance FROM (
    SELECT doc_id, number, d, unnest(string_split(path, '/')) AS a, unnest(range(1, d + 2)) AS i FROM w WHERE d > 0) WHERE i <= d""",
}
