"""Page images and PDF files by pluggable extractors, HTML pages by expressions."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.functions.text import collapse, html_meta, html_text, html_title

WORDS = "path string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, conf double, error string"
#: (bytes, path) -> rows (page, text, x0, y0, x1, y1, conf); conf is null where the extractor has none.
Extractor = Callable[[bytes, str], list[tuple]]


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def words(files: DataFrame, extractor: Callable[[], Extractor]) -> DataFrame:
    """Rows of WORDS from binary files; extractor() is called once per task (a PDF or OCR library).

    A file that it cannot read gives one row with the error and nothing else; `error` is null in all others.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = extractor()
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    got = read(content, path)
                except Exception as e:
                    rows.append((path, *[None] * 8, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(path, w[0], i, *w[1:], None) for i, w in enumerate(got)]
            yield pd.DataFrame(rows, columns=["path", "page", "seq", "text", "x0", "y0", "x1", "y1", "conf", "error"])

    return files.select("path", "content").mapInPandas(run, WORDS)


def page_texts(found: DataFrame) -> DataFrame:
    """Rows (path, page, n_words, text): the words of each page in order; files that could not be read have none."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda w: w["text"]), " ")
    return found.where("page is not null").groupBy("path", "page").agg(F.count("*").alias("n_words"), text.alias("text"))


def images(files: DataFrame, renderer: Callable[[], Callable[[bytes], list[tuple[int, bytes, str]]]]) -> DataFrame:
    """Rows (path, page, image, ext): rendered pages or embedded images; renderer() is called once per task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw = renderer()
        for b in batches:
            rows = [(path, *r) for path, content in zip(b["path"], b["content"]) for r in draw(content)]
            yield pd.DataFrame(rows, columns=["path", "page", "image", "ext"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, image binary, ext string")


def ocr_summary(found: DataFrame) -> DataFrame:
    """Rows (path, n_words, mean_conf, least): words with text and a confidence of 0 or more; 0.0 without any; the five least sure ones."""
    ok = F.when((F.trim("text") != "") & (F.col("conf") >= 0), F.col("conf"))
    lists = F.sort_array(F.collect_list(F.when(ok.isNotNull(), F.struct("conf", "text"))))
    return found.groupBy("path").agg(F.count(ok).alias("n_words"), F.coalesce(F.avg(ok), F.lit(0.0)).alias("mean_conf"), F.transform(F.slice(lists, 1, 5), lambda x: x["text"]).alias("least"))


def columns_of(found: DataFrame, group: str) -> DataFrame:
    """Rows (group, middle, left, right): words on either side of the median of their centres."""
    x = (F.col("x0") + F.col("x1")) / 2
    m = found.groupBy(group).agg(F.percentile(x, F.lit(0.5)).alias("middle"))
    return found.join(m, group).groupBy(group, "middle").agg(F.count_if(x < F.col("middle")).alias("left"), F.count_if(x >= F.col("middle")).alias("right"))


def page_preview(found: DataFrame, most: int = 400) -> DataFrame:
    """The first words of the first page of the first file, as a sample of a collection."""
    first = found.agg(F.min("path").alias("path"))
    return found.join(F.broadcast(first), "path").where("page = 0").orderBy("seq").limit(most)


def html_fields(df: DataFrame, html: str) -> DataFrame:
    """`df` with title, text, and the names and dates that a page's meta elements state."""
    return df.withColumns(
        {
            "title": html_title(html),
            "text": html_text(html),
            "assignees": html_meta(html, "DC.contributor"),
            "dates": html_meta(html, "DC.date"),
            "headings": F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), lambda h: collapse(F.regexp_replace(h, r"<[^>]*>", " "))),
        }
    )


def unpack(archive: str, folder: str, pattern: str = "*.xsd") -> list[str]:
    """Extract an archive once: nothing is done if files of the pattern are there. Returns them. A step on the driver."""
    there = sorted(map(str, Path(folder).rglob(pattern)))
    if not there:
        with zipfile.ZipFile(archive) as z:
            z.extractall(folder)
        there = sorted(map(str, Path(folder).rglob(pattern)))
    return there


def table_rows(cells: Column) -> Column:
    """Rows of a page's table as maps: the first row has the names."""
    return F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda r: F.map_from_arrays(cells[0], r))
