"""Unicode normalisation with offsets that lead back to the original.

A text is cut into clusters (a starter and its combining marks); each is normalised by itself, and every character that comes out
knows the span of its cluster. Where normalisation composes across starters (Hangul jamo) the clusters are widened until it doesn't, so
the normalised text is always what the whole text normalises to. SQL has no normalisation, so this is an Arrow function; the spans are
arrays, on which the way back is a Column expression again.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfolio.functions.text import col

FORMS = ("NFC", "NFD", "NFKC", "NFKD")
MAP = "form string, original string, normalized string, orig_start array<int>, orig_end array<int>"


def clusters(text: str, form: str = "NFC") -> list[tuple[int, int]]:
    """Spans of the text that normalise independently of each other."""
    cuts = [i for i, c in enumerate(text) if i == 0 or not unicodedata.combining(c)]
    spans = list(zip(cuts, cuts[1:] + [len(text)]))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out:
            p, q = out[-1]
            two = unicodedata.normalize(form, text[p:b])
            if two != unicodedata.normalize(form, text[p:q]) + unicodedata.normalize(form, text[a:b]):
                out[-1] = (p, b)
                continue
        out.append((a, b))
    return out


def offset_map(text: str, form: str = "NFC") -> tuple[str, list[int], list[int]]:
    """(normalised text, start and end in the original of each of its characters)."""
    if text.isascii():
        return text, list(range(len(text))), list(range(1, len(text) + 1))
    out, starts, ends = [], [], []
    for a, b in clusters(text, form):
        n = unicodedata.normalize(form, text[a:b])
        out.append(n)
        starts += [a] * len(n)
        ends += [b] * len(n)
    return "".join(out), starts, ends


def normalize_text(text, form: str = "NFC") -> Column:
    if form not in FORMS:
        raise ValueError(form)

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return normal(col(text))


def build_offset_map(text, form: str = "NFC") -> Column:
    """Struct MAP of a text; null for null."""
    if form not in FORMS:
        raise ValueError(form)

    @F.pandas_udf(MAP)
    def build(s: pd.Series) -> pd.DataFrame:
        rows = [(None,) * 5 if t is None else (form, t, *offset_map(t, form)) for t in s]
        return pd.DataFrame(rows, columns=["form", "original", "normalized", "orig_start", "orig_end"])

    return F.when(col(text).isNotNull(), build(col(text)))


def original_span(offsets, start, end) -> Column:
    """(start, end) in the original of the normalised span [start, end); of an empty span, twice the place it stands at.

    A span that ends beyond the text gives null.
    """
    m, a, b = col(offsets), col(start), col(end)
    size = F.size(m["orig_start"])
    place = F.when(a < size, F.get(m["orig_start"], a)).otherwise(F.coalesce(F.try_element_at(m["orig_end"], F.lit(-1)), F.lit(0)))
    whole = F.struct(F.array_min(F.slice(m["orig_start"], a + 1, b - a)).alias("start"), F.array_max(F.slice(m["orig_end"], a + 1, b - a)).alias("end"))
    return F.when((a >= 0) & (a < b) & (b <= size), whole).when((a == b) & (a >= 0) & (a <= size), F.struct(place.alias("start"), place.alias("end")))


def recover_original(offsets, start, end) -> Column:
    """The original text of a normalised span."""
    s = original_span(offsets, start, end)
    return col(offsets)["original"].substr(s["start"] + 1, s["end"] - s["start"])
