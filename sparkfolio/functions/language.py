"""Language of a text by its function words, as an expression; a model can take its place."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfolio.functions.text import col, strip

# Frequent words by language.
MARKERS = {
    "en": ("the", "a", "of", "and", "each", "said", "one", "is", "for", "which", "when", "wherein", "in"),
    "de": ("die", "der", "das", "eine", "ein", "jede", "diese", "und", "mit", "durch", "gegen", "nahe", "ohne"),
    "fr": ("le", "la", "les", "un", "une", "ce", "chaque", "et", "avec", "dans", "vers", "près", "contre"),
    "es": ("el", "la", "los", "un", "una", "dicho", "cada", "y", "con", "mediante", "hacia", "según", "sobre"),
}


def detect_language(text, model: Callable[[str], str] | None = None) -> Column:
    """Language code; 'unknown' for texts under three characters or without a sign. A tie goes to the first of MARKERS."""
    if model is not None:

        @F.pandas_udf("string")
        def ask(s: pd.Series) -> pd.Series:
            return s.map(lambda t: "unknown" if t is None or len(t.strip()) < 3 else model(t))

        return ask(col(text))
    t = strip(F.coalesce(col(text), F.lit("")))
    words = F.split(F.lower(t), r"[^\p{L}]+")

    def count(marks: tuple[str, ...]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*marks)))

    counts = {lang: count(marks) for lang, marks in MARKERS.items()}
    kana = F.length(t) - F.length(F.regexp_replace(t, r"[ぁ-ゖ]", ""))
    best = F.greatest(*counts.values(), kana)
    out = F.when((F.length(t) < 3) | (best == 0), "unknown").when(kana == best, "ja")
    for lang, n in counts.items():
        out = out.when(n == best, lang)
    return out
