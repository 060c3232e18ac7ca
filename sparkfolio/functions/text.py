"""Text functions as Column expressions; all of them stay inside the JVM.

Arguments are Columns or column names. Where Python and SQL differ on white space, case or rounding, the docstring says
what holds here. A null text gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: letters and figures of ASCII, joined by points, slashes and hyphens.
TOKEN = r"[a-z0-9]+(?:[./-][a-z0-9]+)*"
#: A token for estimates of length: a run of letters, figures and underscores of any script, or one other visible character.
PIECE = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text) -> Column:
    """Lower-case tokens in order; identifiers such as g06f16/2457 stay whole. Accents split words."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0))


def estimate_tokens(text) -> Column:
    """Number of word pieces, the measure of chunk sizes and budgets."""
    return F.size(F.regexp_extract_all(col(text), F.lit(PIECE), F.lit(0)))


def strip(text) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(col(text), r"^\s+|\s+$", "")


def collapse(text) -> Column:
    """The text with every run of white space as one blank, and none at its ends."""
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def paragraphs(text) -> Column:
    """Paragraphs between blank lines, stripped; blank ones are left out."""
    return F.filter(F.transform(F.split(col(text), r"\n\s*\n"), strip), lambda p: p != "")


def sentences(text) -> Column:
    """Sentences: parts between white space that follows a full stop, exclamation or question mark."""
    return F.filter(F.transform(F.split(strip(text), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def word_count(text) -> Column:
    """Words between white space; 0 for an empty or blank text."""
    t = strip(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"\s+")))


def char_error_rate(reference, hypothesis) -> Column:
    """Edit distance over the length of the reference, white space collapsed; 0 for an empty reference. Can exceed 1."""
    a, b = collapse(reference), collapse(hypothesis)
    return F.when(F.length(a) == 0, 0.0).otherwise(F.levenshtein(a, b) / F.length(a))


def stable_chunk_id(document, section, start, text) -> Column:
    """Twelve hex digits named by content and place, so that a second ingestion gives the same. A null part reads 'None'."""
    parts = [F.coalesce(col(x).cast("string"), F.lit("None")) for x in (document, section, start, text)]
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 12)


def xml_escape(text) -> Column:
    """&, < and > as entities; quotes stay, as the result is meant for element content."""
    return F.replace(F.replace(F.replace(col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def iso_date(text) -> Column:
    """The date in the first ten characters, if they are a valid yyyy-mm-dd; else null."""
    head = F.substring(col(text), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(head, F.lit("yyyy-MM-dd")).cast("date"))


def jaccard(a, b) -> Column:
    """Shared over all distinct elements of two arrays; 0 if both are empty."""
    n = F.size(F.array_union(col(a), col(b)))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(col(a), col(b))) / n)


def token_overlap(a, b) -> Column:
    """Jaccard likeness of the lower-case words of two texts."""
    words = [F.filter(F.split(F.lower(col(x)), r"\s+"), lambda w: w != "") for x in (a, b)]
    return jaccard(*words)


def exact_match(a, b) -> Column:
    return F.lower(strip(a)) == F.lower(strip(b))


def contains_answer(answer, wanted) -> Column:
    return F.contains(F.lower(col(answer)), F.lower(col(wanted)))


def numbers(text) -> Column:
    """Numbers in a text as they stand."""
    return F.regexp_extract_all(col(text), F.lit(r"\d[\d.,]*"), F.lit(0))


def is_number(word) -> Column:
    """Whether a word is a number and nothing else."""
    return col(word).rlike(r"^\d[\d.,]*$")


def fixed_windows(tokens, size: int, overlap: int = 0) -> Column:
    """Windows of `size` tokens joined by blanks, each beginning size - overlap after the one before; [] for no tokens."""
    if size < 1:
        raise ValueError("size must be positive")
    step = max(1, size - overlap)
    t = col(tokens)
    starts = F.sequence(F.lit(0), F.size(t) - 1, F.lit(step))
    return F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(t, i + 1, F.lit(size)), " ")))


def html_title(html) -> Column:
    return collapse(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_text(html) -> Column:
    """Visible text of a page: scripts, styles, comments and tags taken out, the common entities read."""
    t = F.regexp_replace(col(html), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return collapse(t)


def html_meta(html, name: str) -> Column:
    """All contents of <meta name="..." content="...">, in order."""
    return F.regexp_extract_all(col(html), F.lit(rf'(?i)<meta[^>]*name="{name}"[^>]*content="([^"]*)"'), F.lit(1))


def url_host(url) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#:]+)", 1))
