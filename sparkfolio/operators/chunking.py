"""Citable chunks with offsets: packing of paragraphs, claims as chunks, enrichment and provenance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.functions.offsets import offset_map
from sparkfolio.functions.text import col, estimate_tokens, stable_chunk_id

TARGET, OVERLAP = 180, 1
_PIECE = re.compile(r"\w+|[^\w\s]")
_BREAK = re.compile(r"\n(?:[^\S\n]*\n)+")


def paragraph_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the paragraphs of a text, which blank lines part; leading line ends belong to none."""
    out, at = [], 0
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        a = at
        while a < end and text[a] == "\n":
            a += 1
        if text[a:end].strip():
            out.append((a, end))
        at = m.end() if m else end
    return out


def pack(sizes: list[int], target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Ranges [i, j) of paragraphs: each takes paragraphs while it is empty or stays within the target, and the next begins `overlap` before
    its end, but at least one further. The last range ends with the last paragraph."""
    out, i, n = [], 0, len(sizes)
    while i < n:
        total, j = 0, i
        while j < n and (total == 0 or total + sizes[j] <= target):
            total += sizes[j]
            j += 1
        out.append((i, j))
        if j == n:
            break
        i = max(i + 1, j - overlap)
    return out


_CHUNKS = "norm_start int, norm_end int, orig_start int, orig_end int, text string, token_estimate int"


def section_chunks(sections: DataFrame, keys: list[str], text: str, target: int = TARGET, overlap: int = OVERLAP, form: str = "NFC") -> DataFrame:
    """Rows (keys, norm_start, norm_end, orig_start, orig_end, text, token_estimate): the packed paragraphs of each text.

    Offsets are code points of the normalised text and of the original. The text of a chunk joins its stripped paragraphs by a blank line.
    Packing is sequential within a section, so it runs per row; null and blank texts give no chunks.
    """
    schema = T.StructType([sections.schema[k] for k in keys] + list(T.StructType.fromDDL(_CHUNKS)))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, original in enumerate(b.column(n).to_pylist()):
                if not original or not original.strip():
                    continue
                shadow, starts, ends = offset_map(original, form)
                spans = paragraph_spans(shadow)
                sizes = [len(_PIECE.findall(shadow[a:e])) for a, e in spans]
                for p, q in pack(sizes, target, overlap):
                    a, e = spans[p][0], spans[q - 1][1]
                    body = "\n\n".join(shadow[x:y].strip() for x, y in spans[p:q])
                    at.append(i)
                    rows.append((a, e, min(starts[a:e]), max(ends[a:e]), body, len(_PIECE.findall(body))))
            if rows:
                kinds = (pa.int32(),) * 4 + (pa.string(), pa.int32())
                where = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(b.column(j).take(where) for j in range(n)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=schema.names)

    return sections.select(*keys, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def claim_chunks(claims: DataFrame) -> DataFrame:
    """One chunk per claim (doc_id, number, claim_text): chunk_id, document_id, section, claim_number, text, token_estimate."""
    return claims.where("claim_text is not null").select(
        stable_chunk_id("doc_id", F.concat(F.lit("claim"), F.col("number").cast("string")), F.lit(0), "claim_text").alias("chunk_id"),
        F.col("doc_id").alias("document_id"),
        F.lit("Claims").alias("section"),
        F.lit("claims").alias("section_kind"),
        F.col("number").alias("claim_number"),
        F.col("claim_text").alias("text"),
        estimate_tokens("claim_text").alias("token_estimate"),
    )


def enriched(text, document, title, claim_number, independent, section, cpc) -> Column:
    """The text under a line that says where it is from: document and title, claim and its kind or section, first classification."""
    kind = F.when(F.coalesce(col(independent), F.lit(True)), "independent claim").otherwise("dependent claim")
    place = F.when(col(claim_number).isNotNull(), F.concat(F.lit("Claim "), col(claim_number).cast("string"), F.lit(" ("), kind, F.lit(")")))
    place = place.when(F.coalesce(col(section), F.lit("")) != "", F.concat(F.lit("Section: "), col(section)))
    first = F.get(col(cpc), F.lit(0))
    head = F.concat_ws(" | ", F.concat(F.lit("Patent "), col(document), F.lit(": "), F.coalesce(col(title), F.lit(""))), place, F.when(first.isNotNull(), F.concat(F.lit("CPC: "), first)))
    return F.concat(head, F.lit("\n"), col(text))


def recursive_split(text: str, size: int = 120, overlap: int = 20, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most `size` characters, cut at the coarsest separator that does; neighbours share up to `overlap` characters."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p for p in text.split(sep) if p]
    out: list[str] = []
    run: list[str] = []

    def length(x: list[str]) -> int:
        return sum(map(len, x)) + len(sep) * max(0, len(x) - 1)

    def close() -> None:
        if (s := sep.join(run).strip()):
            out.append(s)

    for p in parts:
        if len(p) > size and finer:
            close()
            run = []
            out += recursive_split(p, size, overlap, finer)
            continue
        if run and length([*run, p]) > size:
            close()
            while run and (length(run) > overlap or length([*run, p]) > size):
                run.pop(0)
        run.append(p)
    close()
    return out


def recursive_chunks(df: DataFrame, key: str, text: str, size: int = 120, overlap: int = 20) -> DataFrame:
    """Rows (key, seq, piece) of recursive_split()."""
    schema = T.StructType([df.schema[key], T.StructField("seq", T.IntegerType()), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, j, p) for i, t in enumerate(b.column(1).to_pylist()) if t for j, p in enumerate(recursive_split(t, size, overlap))]
            if rows:
                at, seq, piece = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(seq, pa.int32()), pa.array(piece)], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)
