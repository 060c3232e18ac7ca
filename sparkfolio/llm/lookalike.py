"""One consistent form for text that looks right but is made of other characters.

Width, ligatures, composition, invisible characters and blanks are repaired by rule. Look-alike letters are repaired
script by script: a token's own script is that of its letters that have no look-alike; letters of the other script are
replaced only in tokens that mix scripts, and only if the corpus knows the word that results. A token all of look-alikes has the
script of the words around it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.session import cut

# Letters of other scripts that look like Latin ones.
CYRILLIC = dict(zip("аеорсхуіѕјһԁԛԝӏАВЕНІЈКМОРЅСТХУ", "aeopcxyisjhdqwlABEHIJKMOPSCTXY"))
GREEK = dict(zip("αικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aikvoptuxABEZHIKMNOPTYX"))
TO_LATIN = {**CYRILLIC, **GREEK}
TO_CYRILLIC = {v: k for k, v in CYRILLIC.items()}
TO_GREEK = {v: k for k, v in GREEK.items()} | {c: {v: k for k, v in GREEK.items()}[x] for c, x in CYRILLIC.items() if x in GREEK.values()}
INTO = {"L": TO_LATIN, "C": TO_CYRILLIC | {g: TO_CYRILLIC[x] for g, x in GREEK.items() if x in TO_CYRILLIC}, "G": TO_GREEK}

# Characters without width. The joiners have a meaning between letters of the scripts of JOINED.
INVISIBLE = "­͏᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿"
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_JOINED = re.compile("[؀-෿က-႟ក-៿\U0001f300-\U0001faff]")
# Forms of other width, letters joined into one character, letters of mathematical alphabets, in circles and squares, and Roman figures.
_FORMS = re.compile("[！-￮ﬀ-ﬆĲĳǄ-ǌǱ-ǳ\U0001d400-\U0001d6a5\U0001d7ce-\U0001d7ff\u24b6-\u24e9\U0001f130-\U0001f149\u2160-\u217f]")
_SPACE = "\t-\r\x1c-\x20\x85\xa0  -     　"
_BREAK = re.compile(f"[{_SPACE}]+")
_SPLIT = re.compile(f"([{_SPACE}]+)")
OUTER = ".,;:()"


def base_form(word: str) -> str:
    """The word composed, of ordinary width, in single letters and without invisible characters."""
    if word.isascii():
        return word
    if _INVISIBLE.search(word):
        if _JOINED.search(word):
            word = re.sub(f"[{INVISIBLE.replace(chr(0x200C), '').replace(chr(0x200D), '')}]", "", word)
        else:
            word = _INVISIBLE.sub("", word)
    word = _FORMS.sub(lambda m: unicodedata.normalize("NFKC", m[0]), word)
    return unicodedata.normalize("NFC", word)


def script(word: str) -> str:
    """The script of the word's letters: L, C, G, 'X' if it mixes them, '' if it has none of these."""
    found = set()
    for c in word:
        o = ord(c)
        if o < 0x80:
            if c.isalpha():
                found.add("L")
        elif 0xC0 <= o < 0x250 or 0x1E00 <= o < 0x1F00:
            found.add("L")
        elif 0x400 <= o < 0x530:
            found.add("C")
        elif (0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000) and c.isalpha():
            found.add("G")
    return found.pop() if len(found) == 1 else "X" if found else ""


def repaired(word: str, before: str, after: str) -> str | None:
    """`word` (in base form) with its look-alikes in its own script; None if there is nothing to replace or no way to.

    `before` and `after` are the scripts of the neighbours.
    """
    if word.isascii():
        return None
    kind = script(word)
    if kind in ("", "L"):
        return None
    if kind != "X":
        around = {before, after} - {""}
        if not (around == {"L"} and sum(map(str.isalpha, word)) > 1 and all(c in TO_LATIN for c in word if c.isalpha())):
            return None
        own = "L"
    else:
        own = _own(word) or (before if before == after and before else "L")
    out = "".join(INTO[own].get(c, c) if script(c) != own else c for c in word)
    return out if out != word and script(out) == own else None


def _own(word: str) -> str:
    """The script of most of a word's letters that have no look-alike, '' if two have as many. One Greek letter is a symbol (MΩ), not a Greek word."""
    firm = [script(c) for c in word if c not in TO_LATIN and c not in TO_CYRILLIC]
    most = sorted(((firm.count(k), k) for k in "LCG"), reverse=True)
    return most[0][1] if most[0][0] > most[1][0] and most[0] != (1, "G") else ""


def main_script(word: str) -> str:
    """The script of a word, or of most of its letters that have no look-alike."""
    kind = script(word)
    return kind if kind != "X" else _own(word) or "L"


def _clean(raw: str) -> str:
    return base_form(raw.strip(OUTER)).strip(OUTER)


def oddities(text: str) -> Iterator[tuple[bool, str, str | None, str | None, str | None]]:
    """What in `text` may differ from its consistent form: (surely, word, its repair, second word, its repair).

    A second word is there if the two are separated by anything but an ordinary blank. Not `surely`: it differs only if
    the corpus knows the repair.
    """
    if text.isascii() and not re.search("[\t-\r\x1c-\x1f]|  ", text):
        return
    parts = _SPLIT.split(text)
    raw = parts[::2]
    bare = [w.strip(OUTER) for w in raw]
    forms = [_clean(w) for w in raw]
    fixes: list[str | None] = [None] * len(raw)
    for i, f in enumerate(forms):
        if not f.isascii():
            fixes[i] = repaired(f, main_script(forms[i - 1]) if i else "", main_script(forms[i + 1]) if i + 1 < len(forms) else "")
    for i, (w, f, x) in enumerate(zip(bare, forms, fixes)):
        if f and (w != f or x):
            yield w != f, f, x, None, None
        gap = parts[2 * i + 1] if 2 * i + 1 < len(parts) else " "
        if gap != " " and f and forms[i + 1]:
            yield True, f, x, forms[i + 1], fixes[i + 1]


_ROWS = "surely boolean, w1 string, x1 string, w2 string, x2 string"


def _odd_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows (keys, surely, w1, x1, w2, x2) of oddities()."""
    schema = T.StructType([df.schema[k] for k in keys] + list(T.StructType.fromDDL(_ROWS)))
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, s in enumerate(b.column(n)):
                s = s.as_py()
                if s:
                    for r in dict.fromkeys(oddities(s)):
                        at.append(i)
                        rows.append(r)
            if rows:
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.bool_(), *[pa.string()] * 4))]
                yield pa.RecordBatch.from_arrays([*(b.column(j).take(pa.array(at)) for j in range(n)), *cols], names=schema.names)

    return df.select(*keys, F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def _known(df: DataFrame, text: str, odd: DataFrame) -> DataFrame:
    """Column `word`: the repairs in `odd` that the corpus has as words, whatever their case."""
    tried = odd.select(F.explode(F.array("x1", "x2")).alias("word")).where("word is not null").select(F.lower("word").alias("word")).distinct()
    words = df.select(F.explode(F.split(F.lower(text), f"[{_SPACE}]+")).alias("word"))
    words = words.select(F.regexp_replace("word", r"^[.,;:()]+|[.,;:()]+$", "").alias("word")).distinct()
    return tried.join(words, "word", "left_semi")


def _resolved(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    odd = cut(_odd_rows(df, keys, text))
    known = cut(_known(df, text, odd))
    for x, k in (("x1", "k1"), ("x2", "k2")):
        odd = odd.withColumn("__l", F.lower(x)).join(known.select(F.col("word").alias("__l"), F.lit(True).alias(k)), "__l", "left").drop("__l")
    first = F.when(F.col("k1"), F.col("x1")).otherwise(F.col("w1"))
    second = F.when(F.col("k2"), F.col("x2")).otherwise(F.col("w2"))
    return odd.where("surely or k1").select(*keys, F.concat_ws(" ", first, second).alias("item"), "w1", "x1", F.coalesce("k1", F.lit(False)).alias("fixed"), F.col("w2").isNotNull().alias("pair"))


def find_oddities(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Distinct rows (keys, item) of the words of `text` that differ from their consistent form, which is the item.

    Null, empty and blank texts give no rows; null keys are kept; repeated rows count once. Columns other than the keys and the text are
    not read. Two words that anything but one ordinary blank separates are an item together. The corpus whose words
    decide on look-alikes is `df` itself, all of it.
    """
    return _resolved(df, keys, text).select(*keys, "item").distinct()


def consistent_text(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows (keys, text) of `df` with every text in its consistent form; blanks of any kind become ordinary ones.

    A null text stays null. Repairs belong to a text, so rows with null or equal keys keep their own, and copies of a text share theirs.
    """
    value = F.col(text).cast("string")
    base = df.select(*keys, value.alias("text"), F.xxhash64(value).alias("__a"), F.xxhash64(F.lit("second"), value).alias("__b"))
    here = ["__a", "__b"]
    fixes = _resolved(base.where("text is not null"), here, "text").where("fixed").select(*here, "w1", "x1").distinct()
    fixes = fixes.groupBy(*here).agg(F.collect_list(F.struct("w1", "x1")).alias("fixes"))  # words of a text
    both = base.join(fixes, here, "left")
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("text", T.StringType())])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s, f in zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist()):
                if s is None or (s.isascii() and not re.search("[\t-\r\x1c-\x1f]|  ", s)):
                    out.append(s)
                    continue
                to = {x["w1"]: x["x1"] for x in f or ()}
                words = []
                for w in _BREAK.split(s):
                    form = base_form(w)
                    core = form.strip(OUTER)
                    words.append(form.replace(core, to[core]) if core in to else form)
                out.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(out, pa.string())], names=schema.names)

    return both.select(*keys, "text", "fixes").mapInArrow(run, schema)
