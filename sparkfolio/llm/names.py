"""Variant spellings of people and organisations.

Each distinct name is read into words in one order (a person's surname and given name; an organisation's words, abbreviations written out). Names
within k edits are found by a pigeonhole segment join: a name is cut into k + 1 segments, a name within k edits must contain one of them,
moved by no more than the edits allow; segments are looked up in an inverted index and every hit is verified with a banded edit
distance. A rare name then stands for the frequent one that it is a slip of, and names that agree after that are one party.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.session import cut

# Titles, legal forms and short given names.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "dipl", "ing", "phd", "jr", "sr"}
LEGAL = {
    "ltd": ["limited", "ltd"],
    "inc": ["incorporated", "inc"],
    "corp": ["corporation", "corp"],
    "llc": ["limited liability company", "llc", "l l c"],
    "gmbh": ["gesellschaft mit beschrankter haftung", "gmbh", "g m b h"],
    "ag": ["aktiengesellschaft", "ag", "a g"],
    "sa": ["societe anonyme", "sociedad anonima", "sa", "s a"],
    "plc": ["public limited company", "plc"],
    "co": ["company", "co"],
    "kg": ["kommanditgesellschaft", "kg"],
    "nv": ["naamloze vennootschap", "nv", "n v"],
    "bv": ["besloten vennootschap", "bv", "b v"],
    "kk": ["kabushiki kaisha", "kk", "k k"],
    "spa": ["societa per azioni", "spa", "s p a"],
    "srl": ["srl", "s r l"],
}
SHORT_NAMES = {
    "alex": "alexander alexandra", "andy": "andrew andreas", "ben": "benjamin", "bill": "william", "bob": "robert", "chris": "christina christopher christian",
    "dan": "daniel", "dave": "david", "ed": "edward edith", "elli": "elisabeth", "liz": "elisabeth elizabeth", "lisa": "elisabeth", "franzi": "franziska",
    "fritz": "friedrich", "gabi": "gabriella gabriele", "hans": "johannes", "jim": "james", "joe": "joseph", "kathi": "katharina", "kate": "katharina katherine",
    "leo": "leonard leonhard", "liam": "william", "maggie": "margarethe margaret", "marga": "margarethe", "greta": "margarethe", "matt": "matthew",
    "max": "maximilian", "meg": "margarethe margaret", "mike": "michael", "nick": "nicholas", "pat": "patricia patrick", "pepe": "jose", "rob": "robert",
    "ron": "ronald", "sam": "samuel samantha", "sepp": "josef", "steve": "stephen", "sue": "susanne susan", "susi": "susanne", "ted": "edward theodore",
    "tess": "theresa", "tessa": "theresa", "resi": "theresa", "tim": "timothy", "tom": "thomas", "tony": "anthony", "uli": "ulrich", "vero": "veronika",
    "vroni": "veronika", "vik": "viktor", "walt": "walter", "will": "william", "wolf": "wolfgang",
}

_PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ı": "i", "’": "'"})


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().translate(_PLAIN)) if not unicodedata.combining(c)).translate(_PLAIN)


def read_person(name: str) -> tuple[str, str, str, bool] | None:
    """(given or initial, surname, middle initial, whether the order is certain) of a typed name; None if it has no surname."""
    parts = [re.findall(r"[^\W\d_]+(?:['-][^\W\d_]+)*", p) for p in fold(name).split(",", 1)]
    parts = [[w for w in p if w not in TITLES] for p in parts]
    if len(parts) == 2 and parts[0] and parts[1]:
        last, first, sure = " ".join(parts[0]), parts[1], True
    else:
        words = parts[0] or parts[-1]
        if len(words) < 2:
            return (("", words[0], "", False) if words else None)
        last, first = words[-1], words[:-1]
        sure = len(last) > 1 and (len(first) > 1 or len(first[0]) == 1)
        if len(last) == 1:  # "Surname G."
            last, first, sure = words[0], words[1:], True
    middle = next((w[0] for w in first[1:]), "")
    return first[0], last, middle, sure


_LEGAL = sorted(((form.split(), code) for code, forms in LEGAL.items() for form in forms), key=lambda x: -len(x[0]))


def read_organisation(name: str) -> tuple[list[str], str, list[bool]]:
    """(words, code of the legal form or '', whether each word was typed as an abbreviation)."""
    typed = re.findall(r"[^\W_]+(?:\.[^\W_]+)*\.?", fold(name).replace("&", " and "))
    words, dots = [], []
    for t in typed:
        inner = t.rstrip(".")
        parts = inner.split(".")
        got = ["".join(parts)] if all(len(x) == 1 for x in parts) else [x for x in parts if x]  # g.m.b.h.
        words += got
        dots += [*[True] * (len(got) - 1), t.endswith(".")]
    code = ""
    for form, c in _LEGAL:
        n = len(form)
        if len(words) > n and words[-n:] == form:
            words, dots, code = words[:-n], dots[:-n], c
            break
    keep = [i for i, w in enumerate(words) if w not in ("the", "and", "of", "for", "de", "fur", "und", "et")]
    return [words[i] for i in keep], code, [dots[i] for i in keep]


def edits(letters: int) -> int:
    """Edits up to which names of so many letters may be slips of one another."""
    return 1 if letters < 6 else 2 if letters <= 20 else 3


def word_edits(letters: int) -> int:
    """Edits that a single word of so many letters, the longer of two, may bear."""
    return 0 if letters < 3 else 1 if letters < 6 else 2 if letters <= 12 else 3


def distance(a: str, b: str, most: int) -> int:
    """The edit distance (insertions, deletions, substitutions) of a and b, most + 1 if it is more; only a band of cells is looked at."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    row = [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        diagonal, row[0] = row[lo - 1], i if i <= most else far
        if lo > 1:
            row[lo - 1] = far
        least = row[0]
        for j in range(lo, hi + 1):
            above = row[j] if j < i + most else far
            row[j], diagonal = min(diagonal + (x != b[j - 1]), above + 1, row[j - 1] + 1, far), above
            least = min(least, row[j])
        if least > most:
            return far
    return row[len(b)]


def exchanged(a: str, b: str) -> bool:
    """Whether b is a with two neighbours exchanged."""
    if len(a) != len(b):
        return False
    d = [i for i in range(len(a)) if a[i] != b[i]]
    return len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]


def slips(a: str, b: str) -> list[tuple[str, str, bool]] | None:
    """The words in which two names differ as (word of a, word of b, whether the slip is slight), None if they are no slips of one another.

    A slip is slight if it is one edit, or an exchange of neighbours, in a first word of five letters or more; given names are words of their
    own that often differ by a letter.
    """
    x, y = a.split(" "), b.split(" ")
    if len(x) != len(y):
        return None
    out = []
    for i, (v, w) in enumerate(zip(x, y)):
        if v != w:
            n = max(len(v), len(w))
            swap = exchanged(v, w)
            d = distance(v, w, max(word_edits(n), 1))
            if n < 3 or not (swap or d <= word_edits(n)):
                return None
            out.append((v, w, i == 0 and n >= 5 and (swap or d == 1)))
    return out


def segments(head: int, letters: int, k: int) -> list[tuple[int, int]]:
    """k + 1 segments, as (begin, end), of a name of so many letters: the first word of `head` letters is cut, and what follows goes with its last
    segment; so each segment has a part of the word that tells most. If that is too short the whole name is cut."""
    n = head if head >= 2 * (k + 1) else letters
    at = [n * i // (k + 1) for i in range(k + 1)]
    return list(zip(at, [*at[1:], letters]))


def pieces(name: str, head: int) -> list[str]:
    """Keys under which the index holds a name: its segments by number, with the lengths of the name and its first word."""
    n = len(name)
    return [f"{k}:{head}:{n}:{i}:{name[a:b]}" for k in sorted({edits(n + j) for j in range(4)}) for i, (a, b) in enumerate(segments(head, n, k))]


def probes(name: str, head: int) -> list[str]:
    """Keys under which the index holds one or more of the segments of every name of no more letters within edits(letters) of `name`."""
    n, k = len(name), edits(len(name))
    out = {}
    for more in range(-k, k + 1):  # letters that the other first word has more, and the other rest
        for rest in range(-k, k + 1):
            h, m = head + more, n + more + rest
            if abs(more) + abs(rest) > k or more + rest > 0 or h < 1 or m - h < 0 or (m == h) != (n == head):
                continue
            for i, (a, b) in enumerate(segments(h, m, k)):
                for by in range(-k, k + 1):
                    if abs(by) + abs(n - m - by) <= k and a + by >= 0 and b + by <= n:
                        out[f"{k}:{h}:{m}:{i}:{name[a + by : b + by]}"] = None
    return list(out)


def segment_join(names: DataFrame) -> DataFrame:
    """Rows (a, b, words) of different names, the longer first, within the edits that edits() allows the longer one; both orders if they are as long.

    `names` has distinct rows (name, head), head being the letters of the first word. words: see slips(), null if the words don't correspond.
    """

    def keyed(of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1_000):
                    b = batch.slice(lo, 1_000)
                    rows = [(x, p) for x, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for p in of(x, h)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["name", "piece"])

        return run

    index = names.select("name", "head").mapInArrow(keyed(pieces), "name string, piece string").withColumnRenamed("name", "b")
    looked = names.select("name", "head").mapInArrow(keyed(probes), "name string, piece string").withColumnRenamed("name", "a")
    # every hit is verified where it is found, so that only names within reach of one another are shuffled; 3 is the most that edits() allows
    reach = F.when(F.length("a") < 6, 1).when(F.length("a") <= 20, 2).otherwise(3)
    hits = looked.join(index, "piece").where("a <> b").withColumn("d", F.levenshtein("a", "b", 3)).where((F.col("d") >= 0) & (F.col("d") <= reach)).select("a", "b").distinct()
    kind = pa.list_(pa.struct([("wrong", pa.string()), ("right", pa.string()), ("slight", pa.bool_())]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = slips(x, y)
                rows.append((x, y, w and [dict(zip(("wrong", "right", "slight"), d)) for d in w]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), kind))], names=["a", "b", "words"])

    return hits.mapInArrow(compare, "a string, b string, words array<struct<wrong:string,right:string,slight:boolean>>")


#: A slip that isn't slight is taken for one only if the right name is so many times more frequent, and the wrong word is in one company at most.
CLEARLY = 4


def standing_for(forms: DataFrame) -> DataFrame:
    """Rows (name, own): the name that each one stands for, itself where it is no slip. `forms`: rows (name, head, n), head as in
    segment_join(), n the mentions.

    A name stands for the most mentioned one that it is a slip of. A slight slip needs a name with more mentions (at a tie the smaller by code
    points counts as more); another one needs CLEARLY as many, and a wrong word that isn't seen with different words beside it. Slips of slips are
    followed to their end.
    """
    forms = cut(forms.groupBy("name", "head").agg(F.sum("n").alias("n")))
    pairs = segment_join(forms.select("name", "head"))
    pairs = cut(pairs.where("words is not null"))
    turned = F.transform("words", lambda w: F.struct(w["right"].alias("wrong"), w["wrong"].alias("right"), w["slight"].alias("slight")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), turned.alias("words"))).dropDuplicates(["a", "b"])
    mentions = forms.groupBy("name").agg(F.max("n").alias("n"))
    both = both.join(mentions.select(F.col("name").alias("a"), F.col("n").alias("na")), "a").join(mentions.select(F.col("name").alias("b"), F.col("n").alias("nb")), "b")
    clear = F.col("nb") >= CLEARLY * F.col("na")
    slight = F.forall("words", lambda w: w["slight"])
    more = (F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))
    # a word in the company of different words is a word: it is looked up only for the slips that aren't slight
    words = forms.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("w")).where("length(w) > 2")
    beside = words.select("w", F.expr("array_join(array_sort(array_remove(split(name, ' '), w)), ' ')").alias("rest")).where("length(rest) > 1").distinct().groupBy("w").agg(F.count("*").alias("c"))
    doubted = both.where(~slight & clear)
    known = doubted.select("a", "b", "nb", F.explode("words").alias("x")).where("not x.slight").join(beside, F.col("x.wrong") == F.col("w"), "left")
    known = known.groupBy("a", "b", "nb").agg(F.max(F.coalesce("c", F.lit(0))).alias("c")).where("c < 2")
    kept = both.where(slight & more).select("a", "b", "nb").unionByName(known.select("a", "b", "nb"))
    best = kept.groupBy("a").agg(F.max_by("b", F.struct("nb", "b")).alias("own"))
    up = cut(best)
    while True:
        nxt = up.select(F.col("a").alias("own"), F.col("own").alias("further"))
        up = cut(up.join(nxt, "own", "left").select("a", F.coalesce("further", "own").alias("own"), F.col("further").isNotNull().alias("moved")))
        if up.where("moved").isEmpty():
            break
        up = up.drop("moved")
    return mentions.join(up.select(F.col("a").alias("name"), "own"), "name", "left").select("name", F.coalesce("own", "name").alias("own"))


def distinct_names(df: DataFrame, names: str) -> DataFrame:
    """Rows (name, n): every distinct non-blank name of an array column with its mentions."""
    return df.select(F.explode(names).alias("name")).where("trim(name) <> ''").groupBy("name").agg(F.count("*").alias("n"))


def link_people(names: DataFrame) -> DataFrame:
    """Rows (name, party) of distinct people's names (name, n).

    One person: the surnames are one or a slip of one another, and the given names are equal, one a short form of the other, or
    an initial that fits only one given name of that surname (at several, the one with the same middle initial, if one).
    """
    shape = "name string, n bigint, a string, b string, middle string, sure boolean"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(x, n, *r) for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (r := read_person(x))]
            if got:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=["name", "n", "a", "b", "middle", "sure"])

    typed = cut(names.select("name", "n").mapInArrow(read, shape))
    # is a word a given name or a surname? all mentions vote, certain ones twice
    vote = F.col("n") * F.when(F.col("sure"), 2).otherwise(1)
    votes = typed.where("a <> ''").select(F.explode(F.array(F.struct(F.col("a").alias("w"), vote.alias("v")), F.struct(F.col("b").alias("w"), (-vote).alias("v")))).alias("x"))
    votes = votes.groupBy(F.col("x.w").alias("w")).agg(F.sum("x.v").alias("v"))
    for side in ("a", "b"):
        typed = typed.join(votes.select(F.col("w").alias(side), F.col("v").alias(f"v_{side}")), side, "left")
    turned = ~F.col("sure") & (F.col("v_a") < 0) & (F.col("v_b") > 0)
    people = typed.select(
        "name", "n", "middle", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("given"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("core")
    ).withColumn("block", F.substring("given", 1, 1))
    spark = names.sparkSession
    short = spark.createDataFrame([(s, f) for s, fs in SHORT_NAMES.items() for f in fs.split()], "given string, full string")
    listed = short.groupBy("given").agg(F.array_sort(F.collect_set(F.substring("full", 1, 1))).alias("initials"))
    people = cut(people.join(F.broadcast(listed), "given", "left"))
    # a name is looked up as it is, by its initial, and as a short form by the initials of the full ones (bill): a slip in it may be known from any
    rests = F.array_distinct(F.concat(F.array(F.col("given"), F.col("block")), F.coalesce("initials", F.array().cast("array<string>"))))
    forms = people.select("name", "n", "core", "given", F.posexplode(rests).alias("rank", "rest"))
    forms = cut(forms.withColumn("form", F.trim(F.concat_ws(" ", F.regexp_replace("core", " ", "-"), "rest"))).withColumn("head", F.length("core")))
    own = standing_for(forms.select(F.col("form").alias("name"), "head", "n"))
    found = forms.join(own.withColumnRenamed("name", "form"), "form")
    right = F.when(F.instr("own", " ") > 0, F.substring_index("own", " ", -1)).otherwise("")
    read_as = F.struct(F.regexp_replace(F.substring_index("own", " ", 1), "-", " ").alias("own"), F.when((F.col("rank") == 0) & (F.length("given") > 1), right).otherwise(F.col("given")).alias("given"))
    found = found.groupBy("name").agg(F.min_by(read_as, F.struct((F.col("own") == F.col("form")).alias("same"), "rank")).alias("r"))
    people = people.select("name", "n", "middle").join(found, "name").select("name", "n", "middle", F.col("r.own").alias("own"), F.col("r.given").alias("given"))
    people = cut(people.withColumn("block", F.substring("given", 1, 1)))
    full = people.where("length(given) > 1").groupBy("own", "block", "given").agg(F.sum("n").alias("n"))
    # a short form stands for the only full name that its surname has for it: listed, or of which it is the beginning
    listed = full.join(F.broadcast(short), "given").join(full.select("own", F.col("given").alias("full")), ["own", "full"])
    begun = full.select("own", "given", F.explode(F.sequence(F.lit(3), F.greatest(F.length("given") - 1, F.lit(3)))).alias("k")).where("k < length(given)")
    begun = begun.select("own", F.col("given").alias("full"), F.expr("substring(given, 1, k)").alias("stem"))
    stems = full.select("own", "given", F.explode(F.array_distinct(F.array("given", F.regexp_replace("given", "[aeiouy]+$", "")))).alias("stem")).where("length(stem) > 2")
    prefixed = stems.join(begun, ["own", "stem"]).where("given <> full")
    longer = listed.select("own", "given", "full").unionByName(prefixed.select("own", "given", "full")).where("given <> full").distinct()
    longer = longer.groupBy("own", "given").agg(F.count("*").alias("c"), F.min("full").alias("full")).where("c = 1").drop("c")
    people = cut(people.join(longer, ["own", "given"], "left").withColumn("who", F.coalesce("full", "given")).drop("full"))
    whole = people.where("length(given) > 1").select("own", F.substring("who", 1, 1).alias("block"), "who", "middle")
    one = whole.groupBy("own", "block").agg(F.count_distinct("who").alias("c"), F.min("who").alias("w1")).where("c = 1").drop("c")
    mid = whole.where("middle <> ''").groupBy("own", "block", "middle").agg(F.count_distinct("who").alias("c"), F.min("who").alias("w2")).where("c = 1").drop("c")
    people = people.join(one, ["own", "block"], "left").join(mid, ["own", "block", "middle"], "left")
    who = F.when(F.length("given") == 1, F.coalesce("w1", "w2", "given")).otherwise(F.col("who"))
    return people.select("name", F.concat_ws("|", "own", who).alias("party"))


def link_organisations(names: DataFrame) -> DataFrame:
    """Rows (name, party) of distinct organisations' names (name, n).

    One organisation: the own words are one or a slip of one another, the other words are the same in any order once abbreviations are
    written out, and the legal forms are the same, or one is left out where only one is known.
    """
    shape = "name string, n bigint, legal string, words array<string>, dots array<boolean>"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, code, dots = read_organisation(x)
                if words:
                    got.append((x, n, code, words, dots))
            if got:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=["name", "n", "legal", "words", "dots"])

    typed = cut(names.select("name", "n").mapInArrow(read, shape))
    word = typed.select("name", "n", F.explode(F.arrays_zip("words", "dots")).alias("x")).select("name", "n", F.col("x.words").alias("w"), F.col("x.dots").alias("dot"))
    seen = cut(word.groupBy("w").agg(F.sum(F.when(F.col("dot"), F.lit(0)).otherwise(F.col("n"))).alias("n"), F.max("dot").alias("dot")))
    # an abbreviation has its letters in order in a more frequent, longer word; without a point it is short or that word's beginning
    brief = seen.where("length(w) > 1").select(F.col("w").alias("s"), F.col("n").alias("sn"), "dot")
    long = seen.where("n > 0 and length(w) > 4").select(F.col("w").alias("l"), F.col("n").alias("ln"))
    # both are looked up, not compared: a word under each of its beginnings, and under its first, last and each other letter, as the
    # letters that an abbreviation keeps besides its first are one within and the last
    begun = long.select("l", "ln", F.explode(F.sequence(F.lit(2), F.length("l") - 1)).alias("k")).select("l", "ln", F.expr("substring(l, 1, k)").alias("s"))
    begun = brief.join(begun, "s").select("s", "sn", "l", "ln")
    inner = F.explode(F.array_distinct(F.split(F.expr("substring(l, 2, length(l) - 2)"), "")))
    frame = long.select("l", "ln", inner.alias("i")).select("l", "ln", F.concat(F.substring("l", 1, 1), F.col("i"), F.substring("l", -1, 1)).alias("frame"))
    kept = brief.where("length(s) > 2 and (dot or length(s) <= 4)").withColumn("frame", F.concat(F.substring("s", 1, 2), F.substring("s", -1, 1)))
    like = F.concat(F.lit("^"), F.regexp_replace("s", "(.)", "$1.*"))
    fit = begun.unionByName(kept.join(frame, "frame").where(F.rlike("l", like)).select("s", "sn", "l", "ln"))
    fit = fit.where(F.length("l") > F.length("s") + 1).where(F.col("ln") > F.col("sn"))
    fit = fit.groupBy("s").agg(F.max_by("l", F.struct(F.expr("startswith(l, s)"), "ln", "l")).alias("l"))
    word = word.join(fit.withColumnRenamed("s", "w"), "w", "left").withColumn("w", F.coalesce("l", "w")).drop("l")
    word = cut(word)
    # any word may hold the slip: a name is looked up with each of its words in front, the others in order
    name = word.groupBy("name", "n").agg(F.array_sort(F.collect_set("w")).alias("all")).join(typed.select("name", "legal"), "name")
    name = name.withColumn("whole", F.array_join("all", " "))
    turned = name.groupBy("whole", "all").agg(F.sum("n").alias("n")).select("whole", "n", F.explode("all").alias("w"), "all")
    turned = turned.select("whole", "n", F.length("w").alias("head"), F.concat_ws(" ", F.col("w"), F.expr("array_join(array_remove(all, w), ' ')")).alias("form"))
    turned = cut(turned.withColumn("form", F.trim("form")))
    stands = standing_for(turned.select(F.col("form").alias("name"), "head", "n"))
    sorted_ = F.array_join(F.array_sort(F.split("own", " ")), " ")
    moved = turned.join(stands.where("name <> own").withColumnRenamed("name", "form"), "form").groupBy("whole").agg(F.max_by(sorted_, F.struct("n", sorted_)).alias("own"))
    own = cut(name.join(moved, "whole", "left").select("name", "legal", F.coalesce("own", "whole").alias("own")))
    known = own.where("legal <> ''").groupBy("own").agg(F.count_distinct("legal").alias("c"), F.min("legal").alias("only")).where("c = 1").drop("c")
    own = own.join(known, "own", "left")
    form = F.when(F.col("legal") == "", F.coalesce("only", F.lit(""))).otherwise(F.col("legal"))
    return own.select("name", F.concat_ws("|", "own", form).alias("party"))


def same_party_pairs(linked: DataFrame, role: str) -> DataFrame:
    """Rows (party_role, name_a, name_b): all pairs of different names of a party, the smaller by code points first."""
    a, b = linked.select(F.col("name").alias("name_a"), "party"), linked.select(F.col("name").alias("name_b"), "party")
    return a.join(b, "party").where("name_a < name_b").select(F.lit(role).alias("party_role"), "name_a", "name_b")


def variant_spellings(df: DataFrame, people: str = "inventors", organisations: str = "assignees") -> DataFrame:
    """Rows (party_role, name_a, name_b) of all variants in two array columns.

    Null arrays, null and blank names, and names without a letter are left out; the same string counts once. Other columns
    are not read. Everything after the first aggregation works on distinct strings, so parties with most mentions weigh no more than
    others.
    """
    p = cut(link_people(distinct_names(df, people)))
    o = cut(link_organisations(distinct_names(df, organisations)))
    return same_party_pairs(p, "inventor").unionByName(same_party_pairs(o, "assignee"))
