"""Text from scanned pages to continuous, readable paragraphs.

Four faults are repaired: words divided at line ends, misread letters, running headers and page numbers. The corpus itself says
what a word is: skip-gram vectors are learned from all of it, rare words are linked to far more frequent ones with like vectors from which
plausible confusions of glyphs lead to them, and at each place the word competes with its corrections by its context. Then the furniture of the pages is taken out and the lines
flow together.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.llm.bpe import blocks
from sparkfolio.session import cut

# Glyphs that are taken for one another, (as it should read, as it is read).
GLYPHS = [
    ("o", "0"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("s", "5"), ("b", "6"), ("g", "9"), ("z", "2"), ("b", "8"), ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"),
    ("u", "n"), ("n", "u"), ("g", "q"), ("q", "g"), ("h", "b"), ("b", "h"), ("d", "cl"), ("cl", "d"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("ri", "n"), ("li", "h"), ("é", "e"), ("è", "e"),
    ("a", "o"), ("m", "in"), ("m", "ni"), ("nn", "m"), ("ä", "a"), ("ö", "o"), ("ü", "u"), ("ñ", "n"), ("ó", "o"), ("á", "a"), ("í", "i"), ("ú", "u"), ("ß", "b"),
]
#: Accents that a scan loses count as glyphs too; but a word must be this much rarer than its correction, with a figure among its
#: letters or without.
RARER, RARER_WITH_FIGURE = 12, 2
#: A place is left as it is if its context speaks this much more for the word than for the correction (mean logits of the context under both).
AGAINST = -2.5
#: A word seen m times is linked to a correction if their vectors' cosine is at least 1 - UNLIKE / (1 + SURER (m - 1)), but no more than ALIKE: the more
#: often a word is seen, the more alike the vectors of a misreading and of its correction are; but a word has several uses, of which a misreading may have one.
UNLIKE, SURER, ALIKE = 0.7, 0.09, 0.58
#: Every word is given so many contexts of the usual kind besides its own, so that a word seen once doesn't speak for itself by that one place.
USUAL = 8
#: Context words fall into so many buckets; vectors have so many dimensions; negative samples for each context.
BUCKETS, DIMENSIONS, NEGATIVES, DECAY = 512, 32, 5, 0.01
#: Bits of the filter that says which words may be doubted ones. Its size doesn't grow with them; a word that it takes wrongly ends in a join.
FILTER_BITS = 1 << 26

HYPHENS = "-­‐¬"
_JOINT = re.compile(rf"\S*[^\W\d_][{HYPHENS}][ \t]*\n[\s\x0c]*\S+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: str) -> str:
    """The word in lower case without outer punctuation."""
    w = word.lower()
    return w if w.isalnum() else _EDGE.sub("", w)


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def context_vectors(counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of the context buckets, their share of all contexts), learned by skip-gram with negative sampling from how often each bucket's
    words stand beside each other's.

    Both sides are learned: words and contexts, each taken together by buckets, by gradient steps over the expected loss of all counts. A step is
    bounded by the curvature of the loss, so it never overshoots.
    """
    rng = np.random.default_rng(20240229)
    u, v = (rng.standard_normal((len(counts), DIMENSIONS)) / DIMENSIONS**0.5 for _ in "uv")
    n = counts.sum(axis=1)
    share = (n + 1) / (n + 1).sum()
    # smoothed as if every bucket had been seen USUAL times in the usual company
    seen = (counts + USUAL * share) / (n + USUAL)[:, None]
    back = (counts.T + USUAL * share) / (n + USUAL)[:, None]
    for _ in range(rounds):
        p = _sigmoid(u @ v.T)
        u = u + _pace(v, share) * ((seen * (1 - p)) @ v - NEGATIVES * (p * share) @ v - DECAY * u)
        p = _sigmoid(u @ v.T)
        v = v + _pace(u, share) * ((back * (1 - p.T)) @ u - NEGATIVES * (p.T * share) @ u - DECAY * v)
    return v, share


def _pace(other: np.ndarray, share: np.ndarray) -> float:
    """A step that the curvature of the loss allows, the vectors of the other side being what they are."""
    return 1.0 / ((1 + NEGATIVES) / 4 * max(1.0, float((other**2).sum(axis=1).max())) + DECAY)


# ------------------------------------------------------------------ corpus statistics


def corpus_words(texts: DataFrame) -> DataFrame:
    """Rows (word, n, buckets, counts), several per word: occurrences, and how often which context bucket stands next to it.

    `texts` has the column text. Each task counts its rows as a whole; words divided at line ends are left out.
    """
    schema = "word string, n bigint, buckets array<int>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[str, int] = {}
        bucket: list[int] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> None:
            keys = np.concatenate([k for k, _ in held])
            n = np.concatenate([c for _, c in held])
            u, inv = np.unique(keys, return_inverse=True)
            held[:] = [(u, np.bincount(inv, weights=n).astype(np.int64))]

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            fold()
            keys, n = held[0]
            word, b = keys // (BUCKETS + 1), keys % (BUCKETS + 1)
            names = list(code)
            for lo in range(0, len(names), 20_000):
                i, j = np.searchsorted(word, [lo, lo + 20_000])
                w, bb, nn = word[i:j], b[i:j], n[i:j]
                own = bb == BUCKETS
                total = np.bincount(w[own] - lo, weights=nn[own], minlength=min(20_000, len(names) - lo)).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(w[~own] - lo, minlength=len(total)))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[~own].astype(np.int32))) for x in (bb, nn)]
                yield pa.RecordBatch.from_arrays([pa.array(names[lo : lo + 20_000]), pa.array(total), *lists], names=["word", "n", "buckets", "counts"])
            code.clear()
            bucket.clear()
            held.clear()

        seen: dict[str, int] = {}  # a token as it stands to the code of its word, -1 if it is none
        for batch in batches:
            for s in blocks(batch.column(0), 3_000_000):
                codes: list[int] = []
                for t in batch.column(0)[s.start : s.stop].to_pylist():
                    if not t:
                        continue
                    if "\n" in t:
                        t = _JOINT.sub(" \x00 ", t)
                    for tok in t.split():
                        c = seen.get(tok)
                        if c is None:
                            w = bare(tok)
                            if any(map(str.isalpha, w)):
                                c = code.get(w)
                                if c is None:
                                    c = code[w] = len(code)
                                    bucket.append(_bucket(w))
                            else:
                                c = -1
                            seen[tok] = c
                        codes.append(c)
                    codes.append(-1)
                x = np.array(codes, np.int64)
                if not len(x):
                    continue
                b = np.array(bucket, np.int64)
                both = (x[1:] >= 0) & (x[:-1] >= 0)
                left, right = x[:-1][both], x[1:][both]
                keys = np.concatenate([x[x >= 0] * (BUCKETS + 1) + BUCKETS, right * (BUCKETS + 1) + b[left], left * (BUCKETS + 1) + b[right]])
                u, n = np.unique(keys, return_counts=True)
                held.append((u, n))
                if len(held) > 8:
                    fold()
                if len(code) > 300_000 or len(seen) > 1_000_000:
                    yield from out()
                    seen.clear()
        yield from out()

    return texts.select("text").mapInArrow(run, schema)


def _unread(word: str, glyphs: list[tuple[str, str]]) -> Iterator[str]:
    """The word with one of the glyphs put right, at each place in turn."""
    for true, read in glyphs:
        at = word.find(read)
        while at >= 0:
            yield word[:at] + true + word[at + len(read) :]
            at = word.find(read, at + 1)


def readings(word: str) -> Iterator[str]:
    """The words from which one confusion of glyphs leads to `word`, or two if it has a figure; then one of them is among the first ten. Some come twice."""
    for w in _unread(word, GLYPHS):
        yield w
        if any(map(str.isdigit, w)):
            yield from (x for x in _unread(w, GLYPHS[:10]) if x != word)


def suspects(vocabulary: DataFrame) -> DataFrame:
    """Rows (word, fix, n, m): rare words, seen m times, and the far more frequent words that they may be misreadings of. `vocabulary`: word, n."""

    def out(rows: dict[tuple, None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=["word", "m", "fix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, letters = {}, 0  # a dictionary for its order: readings that come twice are one
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in readings(w):
                    rows[w, n, r] = None
                    letters += len(r)
                    if len(rows) >= 50_000 or letters > 5_000_000:  # a long word has many readings
                        yield out(rows)
                        rows, letters = {}, 0
            if rows:
                yield out(rows)

    tried = vocabulary.select("word", "n").mapInArrow(run, "word string, m bigint, fix string")
    figure = F.col("word").rlike("[0-9]") & ~F.col("fix").rlike("[0-9]")
    enough = F.col("n") >= F.col("m") * F.when(figure, RARER_WITH_FIGURE).otherwise(RARER)
    return tried.join(vocabulary.select(F.col("word").alias("fix"), "n"), "fix").where(enough).select("word", "fix", "n", "m").distinct()


def learned_contexts(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """context_vectors() of a corpus, from its corpus_words(). BUCKETS x BUCKETS counts at most go to the driver."""
    own = F.pmod(F.crc32(F.encode("word", "utf-8")), F.lit(BUCKETS)).alias("own")
    pairs = stats.select(own, F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("own", F.col("x.buckets").alias("near")).agg(F.sum("x.counts").alias("n"))
    counts = np.zeros((BUCKETS, BUCKETS))
    for r in pairs.collect():
        counts[r.own, r.near] = r.n
    return context_vectors(counts)


def linked(doubted: DataFrame, stats: DataFrame, learned: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (word, fix, n, vector) of the suspects that are neighbours of their correction in the space of the vectors; vector: the correction's less
    the word's.

    Vectors are learned for both. A word that stands beside no other word anywhere has none; nothing speaks against its link, and vector is null.
    """
    words = doubted.select("word").union(doubted.select("fix")).distinct()
    counts = stats.join(words, "word", "left_semi").select("word", F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    counts = cut(counts.groupBy("word", F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n")))
    usual = np.zeros(BUCKETS)
    for x in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS at most
        usual[x.bucket] = x.n
    vectors = cut(skip_gram_vectors(counts, learned, usual=usual * USUAL / max(1, usual.sum())))

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    both = doubted.join(vectors.select("word", F.col("vector").alias("own")), "word", "left").join(vectors.select(F.col("word").alias("fix"), "vector"), "fix", "left")
    size = F.sqrt(dot("own", "own") * dot("vector", "vector"))
    like = F.when(size > 0, dot("own", "vector") / size).otherwise(0.0)
    near = F.when(F.col("own").isNull() | F.col("vector").isNull(), True).otherwise(like >= F.least(F.lit(ALIKE), 1 - UNLIKE / (1 + SURER * (F.col("m") - 1))))
    both = cut(both.where(near))
    # a misreading is no correction
    return both.join(both.select(F.col("word").alias("fix")).distinct(), "fix", "left_anti").select("word", "fix", "n", F.zip_with("vector", "own", lambda x, y: x - y).alias("vector"))


def skip_gram_vectors(contexts: DataFrame, learned: tuple[np.ndarray, np.ndarray], steps: int = 100, usual: np.ndarray | float = 0.0) -> DataFrame:
    """Rows (word, vector) of skip-gram with negative sampling, from rows (word, bucket, n) of counts; `usual` is added to each word's counts.

    `learned`: see context_vectors(). The loss of a word then depends on its own vector only and is convex: the words
    are learned side by side, each from its counts over the whole corpus, by gradient steps over the expected loss.
    """
    per_word = contexts.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("c"))  # BUCKETS at most
    per_word = per_word.select("word", F.col("c.bucket").alias("buckets"), F.col("c.n").alias("counts"))
    r, share = learned
    pace = _pace(r, share) * 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2_000):
                b = batch.iloc[lo : lo + 2_000]
                x = np.zeros((len(b), BUCKETS))
                for i, (bs, ns) in enumerate(zip(b["buckets"], b["counts"])):
                    x[i, np.asarray(bs, int)] = ns
                x += usual
                x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
                u = np.zeros((len(b), DIMENSIONS))
                for _ in range(steps):
                    p = _sigmoid(u @ r.T)
                    u += pace * ((x * (1 - p)) @ r - NEGATIVES * (p * share) @ r - DECAY * u)
                yield pd.DataFrame({"word": b["word"].to_numpy(), "vector": list(u)})

    return per_word.mapInPandas(run, "word string, vector array<double>")


def word_filter(words: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of `size` bits over the column word, as 64-bit numbers; in_filter() reads it."""
    h = F.xxhash64("word")
    at = words.select(F.explode(F.array(F.pmod(h, F.lit(size)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(size)))).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at & 63 AS INT))")
    rows = at.groupBy(F.shiftright("at", 6).alias("i")).agg(F.bit_or(bit).alias("bits")).collect()  # size / 64 at most
    out = np.zeros(size >> 6, np.uint64)
    if rows:
        out[[r.i for r in rows]] = np.array([r.bits for r in rows], np.int64).view(np.uint64)
    return out


def in_filter(bits: np.ndarray, word: str) -> bool:
    h, size = xxhash.xxh64_intdigest(word.encode(), seed=42), len(bits) << 6
    a, b = (h if h < 1 << 63 else h - (1 << 64)) % size, (h >> 32) % size
    return bool((int(bits[a >> 6]) >> (a & 63)) & (int(bits[b >> 6]) >> (b & 63)) & 1)


# ------------------------------------------------------------------ pages

_NUMBER = re.compile(r"^(?:[-–—] ?(?:\d{1,4}|[ivxl]+) ?[-–—]|(?-i:(?=[ivxl]{2,}$)(?:xl|l?x{0,3})(?:ix|iv|v?i{0,3}))|(?:p|pp|pg|page|seite|página|s)(?:\. ?| )[ivxl]+|(?:p|pp|pg|page|seite|página|s)\.? ?\d{1,4}|\d{1,4} ?(?:/|of|von|de|sur) ?\d{1,4}|\d{1,4})$", re.I)
_TRAIL = re.compile(r"\s{2,}\d{1,4}$|^\d{1,4}\s{2,}")
_HEADS = [
    re.compile(r"^[A-Z0-9]{2} ?\d{1,3}(?:[,.]\d{3})+ ?[A-Z]\d?$"),
    re.compile(r"^[A-Z0-9]{2} ?\d{5,12} ?[A-Z]\d?$"),
    re.compile(r"^App[il1]\. ?N[o0]\. ?[\dOol/,. -]+$"),
    re.compile(r"^[^\W\d_][\w'’-]*(?: [^\W\d_][\w'’-]*)? et a[il1]\.?$"),
    re.compile(r"^(?:U\.?S\.? )?Pat[ec]nt (?:App[il1][il1]cat[il1][o0]n (?:Pub[il1][il1]cat[il1][o0]n|No\.)|No\.)(?: +(?-i:[A-Z0-9])[\w.,/-]*)*$", re.I),
]
#: Letters of a title's beginning that make a header.
TITLE_BEGUN = 18
_SKELETON = str.maketrans({"0": "o", "1": "l", "i": "l", "5": "s", "6": "b", "8": "b", "h": "b", "e": "c", "f": "t", "u": "n", "q": "g", "9": "g", "2": "z"})


def skeleton(text: str) -> str:
    """Letters and figures of a text, glyphs that are taken for one another made equal."""
    t = "".join(c for c in text.lower() if c.isalnum()).translate(_SKELETON)
    return t.replace("rn", "m").replace("vv", "w").replace("cl", "d").replace("rl", "n")


def furniture(line: str, title: str) -> str | None:
    """'page_number', 'running_header' or None for a trimmed line; `title` is the skeleton of the document's title."""
    if _NUMBER.match(line):
        return "page_number"
    core = _TRAIL.sub("", line) if line[-1].isdigit() or line[0].isdigit() else line
    if any(p.match(core) for p in _HEADS):
        return "running_header"
    if title and len(core) < 2 * len(title) + 20:  # headers may hold the beginning of a long title only
        s = skeleton(core)
        if s == title or (len(s) >= TITLE_BEGUN and title.startswith(s[:-1])):
            return "running_header"
    return None


def letters(line: str) -> str:
    """A line's letters, by which the same line of another page is known; its page number may differ."""
    return "".join(c for c in skeleton(re.sub(r"\d+", "", line)) if c.isalpha())


def interruptions(lines: list[str], kinds: list[str | None]) -> list[tuple[str, int, int]]:
    """(letters, number of what stands around it, words) of the lines that a sentence seems to flow across. Those that do so on page after page belong to the pages."""
    rest = [i for i, x in enumerate(lines) if x and not kinds[i]]
    out = []
    for a, i, b in zip(rest, rest[1:], rest[2:]):
        before, x, after = lines[a], lines[i], lines[b]
        if x[0].islower() or x[-1] in HYPHENS or x.endswith((".", "!", "?", ":", ";", ",", "。")) or not after[0].islower() or not _flows(before, after) or before.endswith((".", "!", "?", ":", "。")):
            continue
        key = letters(x)
        if key:
            out.append((key, zlib.crc32(f"{before}\n{after}".encode()) & 0x7FFFFFFF, len(x.split())))
    return out


_LINES = re.compile(r"[\n\x0b\x0c\x1c-\x1e\x85  ]|\r\n?")


def read_pages(text: str, title: str | None, headers: Collection[str] = ()) -> tuple[list[tuple[str, str]], list[str], list[tuple[str, int, int]]]:
    """(furniture as (kind, line), body, interruptions()) of a text; the body is its lines, '' where a paragraph may end. `headers`: letters() of lines
    that are known as headers.

    Lines of furniture count only in a text of several lines. Where they stood, the page changed: blank lines next to them
    belong to the page, and the lines before and after flow together if the sentence does.
    """
    raw = _LINES.split(text)
    lines = [x.strip() for x in raw]
    if sum(map(bool, lines)) < 2:
        return [], lines, []
    t = skeleton(title) if title else ""
    kinds = [furniture(x, t) if x else None for x in lines]
    if headers:
        kinds = [k or ("running_header" if x and letters(x) in headers else None) for k, x in zip(kinds, lines)]
    found = [(k, x) for k, x in zip(kinds, lines) if k]
    return found, without(lines, kinds) if found else lines, interruptions(lines, kinds)


def without(lines: list[str], kinds: list) -> list[str]:
    """The body of a text's lines, those of a kind left out: '' where a paragraph may end."""
    body: list[str] = []
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and (kinds[j] or not lines[j]):
            j += 1
        if j > i:
            page = any(kinds[i:j])
            if not page:
                body.append("")
            elif body and body[-1] and j < len(lines) and not _flows(body[-1], lines[j]):
                body.append("")
            i = j
            continue
        body.append(lines[i])
        i += 1
    return body


def _flows(before: str, after: str) -> bool:
    """Whether a sentence goes on from one line to the next."""
    return before[-1] in HYPHENS or not before.endswith((".", "!", "?", ":", "。")) or after[:1].islower()


def divided(before: str, after: str) -> tuple[str, str] | None:
    """(left, right) of a word that is divided between two lines."""
    if not before or not after or before[-1] not in HYPHENS or len(before) < 2 or not before[-2].isalpha():
        return None
    left, right = before.split()[-1], after.split()[0]
    return (left[:-1], right) if right[0].isalpha() and (right[0].islower() or left[:-1].isupper()) else None


_FOUND = "kind string, item string, other string, near array<int>"


def page_faults(texts: DataFrame, keys: list[str], known: np.ndarray) -> DataFrame:
    """Rows (keys, kind, item, other, near) of `texts` (keys, text, title, doc, headers).

    kind: running_header and page_number with the line as item; joint with the word in one piece, and with a hyphen as other; word with a
    body word that may be in the filter `known` and the buckets of its neighbours; odd with the letters of a line that interrupts a sentence, the
    document as other, and the number of what stands around it and of its words.
    """
    schema = T.StructType([texts.schema[k] for k in keys] + list(T.StructType.fromDDL(_FOUND)))
    n = len(keys)
    send = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = send.value
        cache: dict[str, str] = {}
        for b in batches:
            at: list[int] = []
            rows: list[tuple] = []
            for i, (text, title, doc, headers) in enumerate(zip(*(b.column(n + j).to_pylist() for j in range(4)))):
                if not text:
                    continue
                found, body, odd = read_pages(text, title, frozenset(headers or ()))
                mine = [(k, x, None, None) for k, x in dict.fromkeys(found)]
                mine += [("odd", key, doc, [around, many]) for key, around, many in odd]
                words: list[str] = []
                skip = False
                for j, line in enumerate(body):
                    toks = line.split()
                    if skip and toks:
                        toks[0] = ""
                    skip = False
                    k = j + 1
                    cutted = divided(line, body[k]) if k < len(body) else None
                    if cutted:
                        left, right = cutted
                        mine.append(("joint", bare(left + right), bare(f"{left}-{right}"), None))
                        if toks:
                            toks[-1] = ""
                        skip = True
                    words += toks
                hits = []
                for j, tok in enumerate(words):
                    w = cache.get(tok)
                    if w is None:
                        if len(cache) > 1_000_000:
                            cache.clear()
                        w = bare(tok)
                        w = cache[tok] = w if in_filter(bits, w) else ""
                    if w:
                        hits.append((j, w))
                for j, w in hits:
                    near = [_bucket(bare(words[q])) for q in (j - 1, j + 1) if 0 <= q < len(words) and words[q]]
                    mine.append(("word", w, None, near))
                at += [i] * len(mine)
                rows += mine
            if rows:
                kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                where = pa.array(at)
                yield pa.RecordBatch.from_arrays([*(b.column(j).take(where) for j in range(n)), *cols], names=schema.names)

    return texts.select(*keys, "text", "title", "doc", "headers").mapInArrow(run, schema)


#: A line that interrupts sentences in so many different places of a document belongs to its pages; more are asked of lines of one or two words.
RECURS, SHORT_RECURS = 3, 5


def recurring_headers(odd: DataFrame) -> DataFrame:
    """Rows (__id, headers) of the texts that have lines which interrupt sentences again and again in their document; `odd`: rows (__id, item, doc, near)."""
    doc = F.coalesce(F.col("doc"), F.col("__id").cast("string"))
    odd = odd.select("__id", "item", doc.alias("doc"), F.col("near")[0].alias("around"), F.col("near")[1].alias("many"))
    # copies of a text have the same around a line, and count once
    times = odd.select("doc", "item", "around", "many").distinct().groupBy("doc", "item").agg(F.count("*").alias("c"), F.max("many").alias("many"))
    times = times.where(F.col("c") >= F.when(F.col("many") < 3, SHORT_RECURS).otherwise(RECURS))
    return odd.join(times.select("doc", "item"), ["doc", "item"]).groupBy("__id").agg(F.collect_set("item").alias("headers"))  # lines of a text


def scan_faults(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows (keys, defect, item, seen) of the faults in `texts` (keys, text, title, and doc if there is one).

    defect hyphenation: item is the whole word, with a hyphen if the corpus knows it so more often; misread: item is the word as it should
    read, seen the word as it is read; running_header, page_number: item is the line. Words are in lower case without outer punctuation.
    Headers are lines of a known form, titles, and lines that interrupt the sentences of a document (doc; without it of a text) on page after page.

    Null, empty and blank texts give no rows; null keys are kept; repeated rows count once. A null title is no header. Further columns are not
    read. All counts are over all rows of `texts`.
    """
    stats = cut(corpus_words(texts))
    vocabulary = cut(stats.groupBy("word").agg(F.sum("n").alias("n")))
    learned = learned_contexts(stats)
    doubted = cut(linked(cut(suspects(vocabulary)), stats, learned))
    known = word_filter(doubted, FILTER_BITS)
    doc = F.col("doc").cast("string") if "doc" in texts.columns else F.lit(None).cast("string")
    ids = [*keys, "__id"]
    pages = texts.select(*keys, "text", "title", doc.alias("doc"), F.xxhash64("text").alias("__id"), F.lit(None).cast("array<string>").alias("headers"))
    faults = cut(page_faults(pages, ids, known))
    headed = cut(recurring_headers(faults.where("kind = 'odd'").select("__id", "item", F.col("other").alias("doc"), "near")))
    if not headed.isEmpty():  # these texts are read again without the headers
        again = page_faults(pages.drop("headers").join(headed, "__id"), ids, known)
        faults = cut(faults.join(headed.select("__id"), "__id", "left_anti").select(again.columns).unionByName(again))

    lines = faults.where("kind in ('running_header', 'page_number')").select(*keys, F.col("kind").alias("defect"), "item", F.lit(None).cast("string").alias("seen"))
    joints = faults.where("kind = 'joint'").select(*keys, "item", "other").distinct()
    for c in ("item", "other"):
        joints = joints.join(vocabulary.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")), c, "left")
    whole = F.when(F.coalesce("n_other", F.lit(0)) > F.coalesce("n_item", F.lit(0)), F.col("other")).otherwise(F.col("item"))
    joints = joints.select(*keys, F.lit("hyphenation").alias("defect"), whole.alias("item"), F.lit(None).cast("string").alias("seen"))
    words = corrected(faults.where("kind = 'word'").select(*keys, F.col("item").alias("word"), "near"), keys, doubted, learned)
    return lines.unionByName(joints).unionByName(words).distinct()


def corrected(places: DataFrame, keys: list[str], doubted: DataFrame, learned: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (keys, defect, item, seen): for each place of a doubted word the correction that its context speaks for most, if one beats the word.

    The support of a correction is the mean logit of the context under its vector, less that under the word's own; the word stands where
    it is AGAINST or less. Among the others the logarithm of the count is added, so that a frequent word needs less support.
    """
    r, _ = learned
    shape = T.StructType([places.schema[k] for k in keys] + list(T.StructType.fromDDL("word string, near array<int>, fix string, score double, support double")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            u = np.array([np.zeros(DIMENSIONS) if v is None else v for v in b["vector"]]).reshape(len(b), DIMENSIONS)
            c = np.array([r[np.asarray(x, int)].mean(axis=0) if x is not None and len(x) else np.zeros(DIMENSIONS) for x in b["near"]]).reshape(len(b), DIMENSIONS)
            b["support"] = (u * c).sum(axis=1)
            b["score"] = b["support"] + np.log(b["n"].astype(float))
            yield b[shape.names]

    scored = places.join(doubted, "word").select(*keys, "word", "near", "fix", "n", "vector").mapInPandas(run, shape)
    best = scored.where(F.col("support") > AGAINST).groupBy(*keys, "word", "near").agg(F.max_by("fix", F.struct("score", "fix")).alias("fix"))
    return best.select(*keys, F.lit("misread").alias("defect"), F.col("fix").alias("item"), F.col("word").alias("seen"))


def reflowed(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows (keys, text) of `texts` (keys, text, title, and doc if there is one) with all faults repaired and each paragraph in one line,
    '\\n\\n' between them.

    A null text stays null. Corrections belong to a text and its title, so rows with null or equal keys keep their own. Extra columns are not read.
    """
    here = ["__a", "__b"]
    named = texts.withColumns({"__a": F.xxhash64("text", "title"), "__b": F.xxhash64(F.lit("second"), "text", "title")})
    faults = scan_faults(named, here)
    fixes = faults.groupBy(*here).agg(F.collect_list(F.struct("defect", "seen", "item")).alias("fixes"))  # bounded by the words of a text
    both = named.select(*keys, "text", *here).join(fixes, here, "left").dropDuplicates([*here, *keys])
    schema = T.StructType([texts.schema[k] for k in keys] + [T.StructField("text", T.StringType())])
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [t if t is None else flow(t, fixes or []) for t, fixes in zip(*(b.column(n + j).to_pylist() for j in range(2)))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n)), pa.array(out, pa.string())], names=schema.names)

    return both.select(*keys, "text", "fixes").mapInArrow(run, schema)


def flow(text: str, fixes: list[dict]) -> str:
    """One text with the given faults repaired."""
    read = {f["seen"]: f["item"] for f in fixes if f["defect"] == "misread"}
    whole = {f["item"] for f in fixes if f["defect"] == "hyphenation"}
    away = {f["item"] for f in fixes if f["defect"] in ("running_header", "page_number")}
    body = [x.strip() for x in _LINES.split(text)]
    if away and sum(map(bool, body)) > 1:
        body = without(body, [x in away for x in body])
    out: list[str] = []
    para: list[str] = []
    for j, line in enumerate(body):
        words = line.split()
        if not words:
            if para:
                out.append(" ".join(para))
            para = []
            continue
        before = body[j - 1] if j else ""
        parts = divided(before, line) if para else None
        if parts:
            left, right = parts
            para[-1] = left + ("-" if bare(f"{left}-{right}") in whole else "") + words.pop(0)
        if not read:
            para += words
            continue
        for w in words:
            fix = read.get(bare(w))
            if fix:
                core = _EDGE.sub("", w)
                w = w.replace(core, fix.upper() if core.isupper() and len(core) > 1 else fix.capitalize() if core[0].isupper() or text_starts(para) else fix)
            para.append(w)
    if para:
        out.append(" ".join(para))
    return "\n\n".join(out)


def text_starts(para: list[str]) -> bool:
    """Whether the next word begins a sentence."""
    return not para or para[-1].endswith((".", "!", "?"))
