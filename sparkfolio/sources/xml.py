"""XML instances: scan, bibliographic data and claims by local names, a compact writer, migration and validation."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.functions.text import col, xml_escape

BIBLIO = {
    "publication_number": "PublicationNumber",
    "kind_code": "PatentDocumentKindCode",
    "publication_date": "PublicationDate",
    "application_number": "ApplicationNumberText",
    "title": "InventionTitle",
    "ip_office": "IPOfficeCode",
}
#: Elements of the compact format and what each may hold, in order; a trailing ? or + as in a DTD. Attributes that must be there.
COMPACT = {
    "patent-document": ("bibliographic-data", "abstract?", "description?", "claims?"),
    "bibliographic-data": ("invention-title", "publication-date?"),
    "abstract": ("p+",),
    "description": ("p+",),
    "claims": ("claim+",),
    "claim": ("claim-text",),
}
COMPACT_TEXT = {"invention-title", "publication-date", "p", "claim-text"}
COMPACT_ATTRIBUTES = {"patent-document": ("lang", "country", "doc-number"), "claim": ("num",)}


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, xml): whole instances as text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"^\s*<\?xml[^>]*\?>", "").alias("xml"))


def read_rows(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One row per element `tag`, with an inferred schema."""
    return spark.read.format("xml").option("rowTag", tag).load(path)


def by_local_name(xml, name: str) -> Column:
    """Text of the first element of that local name, stripped; null if there is none or it is blank."""
    return F.nullif(F.trim(F.xpath_string(col(xml), F.lit(f"//*[local-name()='{name}']/text()"))), F.lit(""))


def bibliography(df: DataFrame, xml: str = "xml") -> DataFrame:
    """`df` with the BIBLIO columns and the version that the root states."""
    version = F.nullif(F.xpath_string(xml, F.lit("string(/*/@*[local-name()='st96Version'])")), F.lit(""))
    return df.withColumns({c: by_local_name(xml, n) for c, n in BIBLIO.items()} | {"st96_version": version})


def claims_of(xml) -> Column:
    """Array of the claims' texts, all text below each joined by single blanks; empty ones are left out."""

    @F.pandas_udf("array<string>")
    def texts(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[str]:
            if not x:
                return []
            try:
                root = ET.fromstring(x)
            except ET.ParseError:
                return []
            out = [" ".join(" ".join(t.split()) for t in e.itertext() if t.strip()) for e in root.iter() if e.tag.rpartition("}")[2] == "Claim"]
            return [t for t in out if t]

        return s.map(one)

    return texts(col(xml))


def xpath(xml, expression: str) -> Column:
    """All matches of an XPath 1.0 expression; prefixes cannot be bound, so name elements by local-name()."""
    return F.xpath(col(xml), F.lit(expression))


def node_paths(xml) -> Column:
    """Array of (path, text) of all elements with text: a path leads back to its node by xpath(). Null and malformed texts have none."""

    @F.pandas_udf("array<struct<path:string,text:string>>")
    def paths(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[dict]:
            if not x:
                return []
            try:
                out, todo = [], [(ET.fromstring(x), "")]
            except ET.ParseError:
                return []
            while todo:
                e, at = todo.pop()
                name = e.tag.rpartition("}")[2]
                here = at or f"/*[local-name()='{name}']"
                if e.text and e.text.strip():
                    out.append({"path": here, "text": e.text.strip()})
                count: dict[str, int] = {}
                kids = []
                for k in e:
                    n = k.tag.rpartition("}")[2]
                    count[n] = count.get(n, 0) + 1
                    kids.append((k, f"{here}/*[local-name()='{n}'][{count[n]}]"))
                todo.extend(reversed(kids))
            return out

        return s.map(one)

    return paths(col(xml))


def compact_xml(number, title, date, abstract, claims, most: int = 5) -> Column:
    """A document in the compact format, with its first claims (number, text); abstract and claims are left out if empty."""
    head = F.concat(
        F.lit('<patent-document lang="en" country="US" doc-number="'), xml_escape(number), F.lit('" kind="B2">\n  <bibliographic-data>\n    <invention-title>'), xml_escape(F.coalesce(col(title), F.lit(""))),
        F.lit("</invention-title>\n    <publication-date>"), F.coalesce(col(date), F.lit("")), F.lit("</publication-date>\n  </bibliographic-data>\n"),
    )
    a = F.when(F.coalesce(col(abstract), F.lit("")) != "", F.concat(F.lit("  <abstract>\n    <p>"), xml_escape(abstract), F.lit("</p>\n  </abstract>\n"))).otherwise("")
    rows = F.transform(F.slice(col(claims), 1, most), lambda c: F.concat(F.lit('    <claim num="'), c["number"].cast("string"), F.lit('"><claim-text>'), xml_escape(F.coalesce(c["text"], F.lit(""))), F.lit("</claim-text></claim>\n")))
    b = F.when(F.size(col(claims)) > 0, F.concat(F.lit("  <claims>\n"), F.array_join(rows, ""), F.lit("  </claims>\n"))).otherwise("")
    return F.concat(head, a, b, F.lit("</patent-document>"))


def migrate(xml) -> Column:
    """An instance of version V8_0 as V9_0: the version attributes and the namespace of formulas."""
    t = F.replace(col(xml), F.lit('st96Version="V8_0"'), F.lit('st96Version="V9_0"'))
    return F.replace(t, F.lit("http://www.w3.org/1998/Math/MathML3"), F.lit("http://www.w3.org/1998/Math/MathML"))


def compact_errors(xml: str | None) -> list[str]:
    """What keeps a text from being an instance of the compact format; [] if nothing does."""
    if not xml:
        return ["no document"]
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        return [f"{e.position[0]}: not well formed"]
    errors = [] if root.tag == "patent-document" else [f"root is {root.tag}"]
    for e in root.iter():
        for a in COMPACT_ATTRIBUTES.get(e.tag, ()):
            if a not in e.attrib:
                errors.append(f"{e.tag}: attribute {a} is missing")
        if e.tag in COMPACT_TEXT:
            if len(e):
                errors.append(f"{e.tag}: holds elements")
            continue
        model = COMPACT.get(e.tag)
        if model is None:
            errors.append(f"{e.tag}: not declared")
            continue
        kids = [k.tag for k in e]
        for m in model:
            name, n = m.rstrip("?+"), 0
            while kids and kids[0] == name and (n == 0 or m.endswith("+")):
                kids.pop(0)
                n += 1
            if n == 0 and not m.endswith("?"):
                errors.append(f"{e.tag}: {name} is missing")
        errors += [f"{e.tag}: {k} is out of place" for k in kids]
    return errors


def validate_compact(xml) -> Column:
    """Array of errors of compact_errors()."""

    @F.pandas_udf("array<string>")
    def errors(s: pd.Series) -> pd.Series:
        return s.map(compact_errors)

    return errors(col(xml))


def read_validated(spark: SparkSession, path: str, tag: str, xsd: str) -> DataFrame:
    """One row per element `tag` that is valid under a schema file; the schema file must be on all nodes (addFile)."""
    return spark.read.format("xml").option("rowTag", tag).option("rowValidationXSDPath", xsd).load(path)
