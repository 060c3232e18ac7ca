"""Keyword-stuffed pages, link lists and product tags, by recurrence gaps and positional autocorrelation.

The corpus says which words carry grammar: those that take a good share of the words of a language's texts. Where none of
them is near, a text is held against itself at a range of lags, the gaps between recurrences are compared, and runs of distinct terms
in short items are told from sentences.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.llm.bpe import blocks
from sparkfolio.session import cut

# Words that carry grammar rather than a topic, by language, for collections too small to learn them from.
# "en" and "pas" are left out: they are as common in the phrases of shops as in sentences.
FUNCTION_WORDS = {
    "en": "a an the each every said one some any this that these those such its it is are was were be been being has have had may can "
    "must shall will would not no of in on at by for from with without within between beneath along across through toward against into "
    "onto over under after before until while when where whereas because so and or but if as than then to which who whose there their "
    "he she they we you i",
    "de": "der die das den dem des ein eine einen einem einer eines jede jeder jedes jeden diese dieser dieses diesen und oder aber nicht "
    "ist sind war wird werden hat haben kann in im an am auf aus bei mit nach seit von vom zu zum zur für über unter durch gegen ohne "
    "entlang nahe zwischen als wie wenn während weil dass sich es er sie wir",
    "fr": "le la les l un une des du de d ce cet cette ces chaque son sa ses et ou mais ne est sont a ont été être avec sans dans sur "
    "sous vers contre par pour entre grâce près après avant chez lorsque quand que qui se il elle ils nous",
    "es": "el la los las un una unos unas de del dicho dicha dichos dichas este esta estos cada su sus y o pero no es son ha han con sin "
    "sobre bajo hacia desde mediante según tras entre por para contra cuando que se lo le",
}
KNOWN = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())


def _marks() -> str:
    """Character class of all combining marks, which belong to the word they stand in."""
    points = [i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "M"]
    runs = []
    for i in points:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


_M = _marks()
#: Scripts that are written without blanks: each sign, or each two letters, is a term. Hiragana in Japanese mark grammar by themselves.
_SIGNS, _DENSE = "㐀-鿿豈-﫿\U00020000-\U0003ffff", "฀-໿က-႟ក-៿"
#: Words of a link or tag count as one term, as does the markup of a link; other markup is none. What parts items or sentences is a term of its own.
_LINKS = r"<a\s[^<>]*>|</?[a-z][^<>]*>|(?:https?://|www\.)[^\s|<>\"')\]]+|(?:[^\W_]+(?:-[^\W_]+)*\.)+[^\W\d_]{2,}(?:/[^\s|<>\"')\]]*)?|#[^\W_][\w-]*"
_MARKS = r"[\n,;|>/•·»«、，；।]|[.!?](?=\s|$)|[。！？؟]|\s[–—-]\s"
_SPACED = re.compile(rf"{_LINKS}|[^\W_]+(?:[-'’][^\W_]+)*|{_MARKS}")
_WORD = rf"(?:[^\W_ぁ-ゖ{_SIGNS}{_DENSE}]+[{_M}]*)+"
_TERM = re.compile(rf"{_LINKS}|[ぁ-ゖ]+|[{_SIGNS}]|(?:[{_DENSE}][{_M}]*){{1,2}}|{_WORD}(?:[-'’]{_WORD})*|{_MARKS}")
_LINK, _TAG, _FUNC, _KANA, _NUMBER, _PART, _STOP, _MARKUP, _UNSPACED = range(1, 10)

#: Terms on either side over which the share of function words is taken; share up to which a place is a list, not a sentence.
REACH, THIN = 7, 0.07
#: Items of up to so many terms are phrases of their own.
PHRASE = 3
#: Shifts at which a text is laid over itself.
LAGS = 24
#: Listed terms in a stretch over which they are counted as distinct.
STRETCH = 50
#: A word carries grammar if it takes this share of a language's words, each text counting the same, and is spread over this share of its texts;
#: and how many texts it takes to say so.
GRAMMAR, SPREAD, LEAST_TEXTS = 0.015, 0.3, 20
#: A task leaves out words below this share of its own words of a language: a share is short by no more than that.
SLACK = 0.001


def _kind(term: str, grammar: frozenset[str]) -> int:
    c = term[0]
    if c == "#":
        return _TAG
    if c == "<":
        return _LINK if term[:2] == "<a" else _MARKUP
    if c in ".!?。！？।؟":
        return _STOP
    if c in "\n,;|>/•·»«、，；" or not term.strip("–—- \t\n"):
        return _PART
    if "ぁ" <= c <= "ゖ":
        return _KANA
    if "." in term or "/" in term:
        return _LINK
    if term in grammar:
        return _FUNC
    if "\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff":
        return _UNSPACED
    return _NUMBER if c.isdigit() else 0


def _pattern(text: str) -> re.Pattern[str]:
    """The faster pattern where no letter can be of those that the other one is for."""
    return _SPACED if text.isascii() or not text or max(text) < "\u0300" else _TERM


class Terms:
    """Numbers the terms of texts; kinds[number] says what a term is. `grammar`: the words that carry grammar."""

    def __init__(self, grammar: Iterable[str] = KNOWN) -> None:
        self.grammar = frozenset(grammar)
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.kinds: list[int] = []

    def codes(self, text: str) -> list[int]:
        out = []
        code = self.code
        text = text.lower()
        for t in _pattern(text).findall(text):
            n = code.get(t)
            if n is None:
                n = code[t] = len(code)
                self.kinds.append(_kind(t, self.grammar))
            out.append(n)
        return out


def grammar_words(df: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """Rows (lang, word, share, spread) of the words that take at least GRAMMAR of the words of a language's texts and stand in SPREAD of the texts.

    Each text of eight words or more counts the same, however long. `lang`: a column with the language; without it, and for rows where it is
    null, the texts are one language of their own. A wrong label does little harm, as the share is taken over all texts of a label. Of each task
    only words that may reach the share leave it, some hundreds for each language, so the shuffle doesn't grow with the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(())
        held: dict[str | None, tuple[int, np.ndarray, np.ndarray]] = {}
        rows: list[tuple] = []

        def out() -> None:
            names = list(terms.code)
            for label, (n, w, d) in held.items():
                rows.append((label, None, float(n), n))
                rows.extend((label, names[i], w[i], int(d[i])) for i in np.flatnonzero(w >= SLACK * n).tolist())
            held.clear()
            terms.clear()

        for b in batches:
            for s in blocks(b.column(1)):
                labels = b.column(0)[s.start : s.stop].to_pylist()
                lists = [np.array(terms.codes(t) if t else [], np.int64) for t in b.column(1)[s.start : s.stop].to_pylist()]
                word = np.isin(np.array(terms.kinds, np.int8), (0, _KANA, _UNSPACED))
                for label in set(labels):
                    mine = [x[word[x]] for x, y in zip(lists, labels) if y == label and len(x)]
                    mine = [x for x in mine if len(x) >= LEAST_TERMS]
                    if not mine:
                        continue
                    size = np.fromiter(map(len, mine), np.int64, len(mine))
                    w = np.bincount(np.concatenate(mine), weights=np.repeat(1 / size, size), minlength=len(word))
                    d = np.bincount(np.concatenate([np.unique(x) for x in mine]), minlength=len(word))
                    n, before, texts = held.get(label, (0, np.zeros(0), np.zeros(0, np.int64)))
                    w[: len(before)] += before
                    d[: len(texts)] += texts
                    held[label] = n + len(mine), w, d
                if len(terms.code) > 500_000:
                    out()
        out()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.float64(), pa.int64()))], names=["lang", "word", "w", "d"])

    label = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    seen = df.select(label.alias("lang"), F.col(text).cast("string").alias("__text")).mapInArrow(run, "lang string, word string, w double, d bigint")
    seen = cut(seen.groupBy("lang", "word").agg(F.sum("w").alias("w"), F.sum("d").alias("d")))
    texts = seen.where("word is null").select(F.col("lang").alias("__l"), F.col("w").alias("n")).where(F.col("n") >= LEAST_TEXTS)
    share = seen.where("word is not null").join(texts, F.col("lang").eqNullSafe(F.col("__l")))
    share = share.select("lang", "word", (F.col("w") / F.col("n")).alias("share"), (F.col("d") / F.col("n")).alias("spread"))
    return share.where((F.col("share") >= GRAMMAR) & (F.col("spread") >= SPREAD))


FEATURES = ("n_terms", "listed", "links", "autocorrelation", "gap_regularity", "recurring", "distinct_share", "item_length", "sentences", "unspaced")


def features(texts: list[str | None], terms: Terms) -> dict[str, np.ndarray]:
    """Measures of each text.

    listed: share of its terms amid which there are next to no words that carry grammar; links: share of links and tags among the
    terms in such places; autocorrelation: mean over the lags of the share of places with the same term as `lag` places
    before, among listed terms; recurring: share of listed terms that stood in the list before; gap_regularity: share of these recurrences
    whose gap is within a quarter of the text's median gap; distinct_share: distinct terms among the listed ones, by stretches of STRETCH of
    them; item_length: mean number of terms between two marks that part items, where some are listed; sentences: share of listed terms in runs of LONG
    to ENDLESS terms that end as a sentence does. All are 0 where there are no terms.
    """
    lists = [terms.codes(t) if t else [] for t in texts]
    code = np.fromiter((c for x in lists for c in x), np.int64, sum(map(len, lists)))
    doc = np.repeat(np.arange(len(lists)), np.fromiter(map(len, lists), np.int64, len(lists)))
    kind = np.array(terms.kinds, np.int8)[code] if len(code) else np.empty(0, np.int8)
    # marks part runs of terms and are no terms themselves
    mark = (kind == _PART) | (kind == _STOP)
    stop = kind == _STOP
    item = np.cumsum(mark)  # number of the item, within all texts
    ends = np.zeros(int(item[-1]) + 2 if len(item) else 1, bool)
    ends[item[stop] - 1] = True
    word = ~mark & (kind != _MARKUP)
    code, doc, kind, item = code[word], doc[word], kind[word], item[word]
    n = np.bincount(doc, minlength=len(lists))
    total = len(code)
    start = np.cumsum(n) - n
    place = np.arange(total) - start[doc]

    # an item is a run of terms of one text between two marks
    first = np.ones(total, bool)
    first[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])
    number = np.cumsum(first) - 1
    length = np.bincount(number, minlength=1)
    # in the shortest items a word of grammar belongs to a phrase ("in stock")
    clause = length[number] > PHRASE
    grammar = np.concatenate([[0], np.cumsum(((kind == _FUNC) | (kind == _KANA)) & clause)])
    lo = np.maximum(place - REACH, 0) + start[doc]
    hi = np.minimum(place + REACH + 1, n[doc]) + start[doc]
    thin = (grammar[hi] - grammar[lo]) <= THIN * (hi - lo)

    def per_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=x, minlength=len(lists))

    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.divide(a, b, out=np.zeros(len(lists)), where=b > 0)

    n_thin = per_doc(thin)
    same, pairs = np.zeros(len(lists)), np.zeros(len(lists))
    for lag in range(1, LAGS + 1):
        if total <= lag:
            break
        both = (doc[lag:] == doc[:-lag]) & thin[lag:] & thin[:-lag]
        hit = both & (code[lag:] == code[:-lag])
        same += np.bincount(doc[lag:][hit], minlength=len(lists))
        pairs += np.bincount(doc[lag:][both], minlength=len(lists))

    t = np.flatnonzero(thin)
    order = t[np.lexsort((t, code[t], doc[t]))]
    again = (doc[order][1:] == doc[order][:-1]) & (code[order][1:] == code[order][:-1]) if len(order) > 1 else np.empty(0, bool)
    gap = (order[1:] - order[:-1])[again] if len(order) > 1 else np.empty(0, np.int64)
    gap_doc = doc[order][1:][again] if len(order) > 1 else np.empty(0, np.int64)
    n_gap = np.bincount(gap_doc, minlength=len(lists)) if len(gap_doc) else np.zeros(len(lists), np.int64)
    by = np.lexsort((gap, gap_doc))
    middle = np.zeros(len(lists))
    has = n_gap > 0
    middle[has] = gap[by][(np.cumsum(n_gap) - n_gap)[has] + n_gap[has] // 2]
    regular = np.bincount(gap_doc, weights=np.abs(gap - middle[gap_doc]) <= 0.25 * middle[gap_doc], minlength=len(lists)) if len(gap_doc) else np.zeros(len(lists))
    # distinct terms by stretches of the list, else a long list would look repetitive by its length alone
    nth = np.concatenate([[0], np.cumsum(thin)])
    stretch = (nth[t] - nth[start[doc[t]]]) // STRETCH
    seen = np.lexsort((code[t], stretch, doc[t]))
    a, b, c = doc[t][seen], stretch[seen], code[t][seen]
    new = np.ones(len(seen), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    distinct = np.bincount(a[new], minlength=len(lists)).astype(float)
    bare = np.bincount(number, weights=thin, minlength=1) if total else np.zeros(1)
    of = doc[first]
    long = ends[item[first]] & (length[: len(of)] >= LONG) & (length[: len(of)] <= ENDLESS) if total else np.empty(0, bool)
    listed_items = np.bincount(of, weights=bare[: len(of)] > 0, minlength=len(lists)) if total else np.zeros(len(lists))
    item_terms = np.bincount(of, weights=length[: len(of)] * (bare[: len(of)] > 0), minlength=len(lists)) if total else np.zeros(len(lists))
    in_long = np.bincount(of, weights=bare[: len(of)] * long, minlength=len(lists)) if total else np.zeros(len(lists))
    return {
        "n_terms": n,
        "listed": ratio(n_thin, n),
        "links": ratio(per_doc(thin & ((kind == _LINK) | (kind == _TAG))), n_thin),
        "autocorrelation": ratio(same, pairs),
        "gap_regularity": ratio(regular, n_gap.astype(float)),
        "recurring": ratio(n_gap.astype(float), n_thin),
        "distinct_share": ratio(distinct, n_thin),
        "item_length": ratio(item_terms, listed_items),
        "sentences": ratio(in_long, n_thin),
        "unspaced": ratio(per_doc(thin & (kind == _UNSPACED)), n_thin),
    }


#: A page is spam if at least LISTED of its terms stand in lists, it has LEAST_TERMS of them, and the lists are links (LINKED), or recur
#: unnaturally (RECURRING by the lags; or RETURNING of the terms come back, REGULAR of them at like gaps), or run on without repeating in short
#: items (RUN_ON, SHORT) or without any end (RUSH, ENDLESS). Runs of terms that end as sentences do (WRITTEN) may be writing in a language of which
#: no grammar is known; there the lags count only if few terms are new (STALE).
LISTED, LEAST_TERMS, LONG, ENDLESS, SHORT = 0.5, 8, 10, 40, 4.0
LINKED, RECURRING, RETURNING, REGULAR, RUN_ON, RUSH, WRITTEN, STALE = 0.25, 0.03, 0.3, 0.3, 0.4, 0.75, 0.5, 0.6


def is_spam(f: dict[str, np.ndarray]) -> np.ndarray:
    regular = (f["recurring"] >= RETURNING) & (f["gap_regularity"] >= REGULAR)
    written = f["sentences"] >= WRITTEN
    stuffed = ((f["autocorrelation"] >= RECURRING) & (~written | (f["distinct_share"] <= STALE))) | (regular & ~written)
    nouns = ((f["distinct_share"] >= RUN_ON) & (f["item_length"] <= SHORT)) | ((f["distinct_share"] >= RUSH) & (f["item_length"] > ENDLESS) & (f["unspaced"] < 0.5))
    return (f["n_terms"] >= LEAST_TERMS) & (f["listed"] >= LISTED) & ((f["links"] >= LINKED) | stuffed | nouns)


def spam_features(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = None, known: Iterable[str] = KNOWN) -> DataFrame:
    """Rows (key, the FEATURES, is_spam), one per row of `df`.

    The words that carry grammar are those of grammar_words() over `df` and `known`. Null, empty and blank texts have no terms and are no spam; a
    null key stays null, repeated rows stay repeated. Other columns are not read. Texts are measured whole, by batches of columns in
    numpy; only the words that carry grammar, 66 at most for each language, go through the driver.
    """
    grammar = frozenset(known) | {r.word for r in grammar_words(df, text, lang).select("word").distinct().collect()}
    schema = T.StructType(
        [T.StructField(key, df.schema[key].dataType), T.StructField("n_terms", T.LongType())]
        + [T.StructField(n, T.DoubleType()) for n in FEATURES[1:]]
        + [T.StructField("is_spam", T.BooleanType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(grammar)
        for b in batches:
            for s in blocks(b.column(1)):
                if len(terms.code) > 500_000:
                    terms.clear()
                f = features(b.column(1)[s.start : s.stop].to_pylist(), terms)
                cols = [b.column(0)[s.start : s.stop], pa.array(f["n_terms"], pa.int64())]
                cols += [pa.array(f[n], pa.float64()) for n in FEATURES[1:]]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(is_spam(f))], names=schema.names)

    return df.select(F.col(key), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def find_spam(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = None, known: Iterable[str] = KNOWN) -> DataFrame:
    """Distinct keys of the spam pages; see spam_features()."""
    return spam_features(df, key, text, lang, known).where("is_spam").select(key).distinct()
