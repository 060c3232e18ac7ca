"""Near-duplicate texts by BagMinHash signatures, banding and verification.

A text is the bag of its runs of consecutive words. BagMinHash draws, for each run, Poisson processes over the discretised
levels of its weight; points of a level belong to every bag whose weight reaches it, so two bags share the points of the smaller
weight. The earliest point in each register is a signature whose registers agree with the probability of the weighted Jaccard
likeness. Bands of registers bring texts together, sketches of a bit and of two bits per register drop chance meetings,
and what is left is verified exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkfolio.llm.bpe import blocks
from sparkfolio.llm.classes import components
from sparkfolio.session import cut

_WORD = re.compile(r"[^\W_]+")
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)

#: Likeness of texts that have nothing to do with each other, as measured on patent texts; chance meetings per text and band that are
#: borne; and the share of pairs at the threshold that may meet in no band.
CHANCE, MEETINGS, MISSED = 0.01, 4, 0.00165
#: The sketches take bits of each of the first SKETCH registers; so many are drawn at least.
SKETCH = 128
#: A task remembers up to so many texts that it has signed, so that it signs copies once.
SIGNED = 1_000_000
#: Texts under one key that are compared with one another in one place; more of them are split into blocks, and each pair of blocks is a place.
BLOCK = 2_000


def band_plan(texts: int, least: float) -> tuple[int, int]:
    """(bands, registers per band) for a number of texts and a threshold.

    A band takes so many registers that a text meets few others by chance, however many texts there are, and there are so many bands
    that a pair at the threshold meets in one of them with probability 1 - MISSED. Both hold at every size: up to four million
    texts a threshold of 0.5 takes 48 bands of 3, up to four hundred million 100 bands of 4.
    """
    rows = next(r for r in range(3, 20) if texts * CHANCE**r <= MEETINGS)
    return max(1, int(np.ceil(np.log(MISSED) / np.log1p(-(min(least, 0.99) ** rows))))), rows


#: Texts to be verified whose names are sent to all tasks; more of them are joined by a shuffle of the texts.
BROADCAST_ROWS = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A good 64-bit mixture of each number."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class Shingler:
    """Turns texts into hashed runs of `size` words; remembers the hashes of words."""

    def __init__(self, size: int):
        self.size = size
        self.words: dict[str, int] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, hash) of every run of every text, repeated runs included."""
        if len(self.words) > 500_000:
            self.words.clear()
        known = self.words
        split = [_WORD.findall(t.lower()) if t else [] for t in texts]
        for w in set().union(*split) - known.keys():
            known[w] = xxhash.xxh3_64_intdigest(w)
        n = np.fromiter(map(len, split), np.int64, len(split))
        h = np.fromiter((known[w] for s in split for w in s), np.uint64, int(n.sum()))
        doc = np.repeat(np.arange(len(split)), n)
        k = self.size
        if len(h) < k:
            return doc[:0], h[:0]
        run = h[: len(h) - k + 1].copy()
        with np.errstate(over="ignore"):
            for i in range(1, k):
                run = _mix(run + _GOLD) + h[i : len(h) - k + 1 + i]
        whole = doc[: len(run)] == doc[k - 1 :]
        return doc[: len(run)][whole], _mix(run[whole])

    def bags(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text number, hash, multiplicity) of every distinct run of every text, by text."""
        doc, run = self(texts)
        order = np.lexsort((run, doc))
        doc, run = doc[order], run[order]
        first = np.ones(len(run), bool)
        first[1:] = (doc[1:] != doc[:-1]) | (run[1:] != run[:-1])
        at = np.flatnonzero(first)
        return doc[at], run[at], np.diff(np.append(at, len(run)))


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n x m, earliest points; inf for an empty bag) of n bags given by rows (bag, element hash, weight).

    Weights are discretised to the levels 0, 1, 2, 4, 8, ... A process runs on each interval between levels below the
    weight, at the rate of its length; a point has a height in its interval and counts if that is below the weight. All
    processes go forward point by point and stop once they are later than every register of their bag.
    """
    h = np.full((n, m), np.inf)
    flat = h.reshape(-1)
    levels = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1, 1)
    row = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, 2.0 ** (level - 1))
    length = np.where(level <= 1, 1.0, 2.0 ** (level - 1))
    d, w = doc[row], weight[row].astype(float)
    with np.errstate(over="ignore"):
        state = _mix(element[row] + level.astype(np.uint64) * _GOLD)
    # only the top interval of a weight is cut by heights
    cut_off = low + length > w
    x = np.zeros(len(d))
    while len(d):
        with np.errstate(over="ignore"):
            state = state + _GOLD
        r = _mix(state)
        x = x - np.log(((r >> np.uint64(33)).astype(float) + 0.5) * 2.0**-31) / length
        slot = ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
        where = d * m + slot.astype(np.int64)
        if cut_off.any():
            height = (_mix(r ^ _GOLD) >> np.uint64(11)).astype(float) * 2.0**-53
            ok = ~cut_off | (low + length * height < w)
            np.minimum.at(flat, where[ok], x[ok])
        else:
            np.minimum.at(flat, where, x)
        alive = np.flatnonzero(np.bincount(d, minlength=n))
        most = np.zeros(n)
        most[alive] = h[alive].max(axis=1)
        go = x < most[d]
        d, w, x, state, low, length, cut_off = (a[go] for a in (d, w, x, state, low, length, cut_off))
    return h


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """32-bit key of each band of each signature."""
    bits = sig.view(np.uint64)
    key = np.zeros((len(sig), bands), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = _mix(key + _GOLD + bits[:, r : bands * rows : rows])
    return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def bit_sketch(sig: np.ndarray) -> np.ndarray:
    """One bit of each of the first 128 registers, as two 64-bit numbers, and two other bits of each, as four."""
    x = _mix(sig[:, :SKETCH].view(np.uint64))
    one = np.packbits((x >> np.uint64(63)).astype(np.uint8), axis=1)
    two = np.packbits(np.stack([(x >> np.uint64(61)).astype(np.uint8) & 1, (x >> np.uint64(62)).astype(np.uint8) & 1], axis=2).reshape(len(sig), -1), axis=1)
    return np.ascontiguousarray(np.concatenate([one, two], axis=1)).view(np.int64)


def agreeing(least: float, bits: int) -> int:
    """Registers of a sketch that agree in their bits at likeness `least`, less 3.5 deviations: fewer agree once in 4,000 such pairs."""
    p = least + (1 - least) / 2**bits
    return int(SKETCH * p - 3.5 * (SKETCH * p * (1 - p)) ** 0.5)


def near_duplicates(df: DataFrame, text: str, size: int = 5, least: float = 0.8, bag: bool = True, within: str | None = None, plan: tuple[int, int] | None = None) -> DataFrame:
    """Pairs (h1_a, h2_a, h1_b, h2_b, likeness) of different texts with a likeness of at least `least`.

    A text is named by two 64-bit hashes of itself (h1, h2: see text_id()); exact copies are one text, so copies cost no pairs.
    `bag`: the likeness is of bags (sum of smaller over sum of larger multiplicities), else of sets of distinct runs.
    `within`: a column; only texts with the same value of it are compared, and it is in the result. `plan`: see band_plan().

    Null and empty texts and texts of fewer than `size` words have no runs and are in no pair. Repeated rows count once.
    Other columns are not read. Copies of a text leave a task once. Keys are counted with a combining aggregate, and those of single texts are
    dropped; a key that very many texts share is split into blocks, so that no place compares more than BLOCK texts with BLOCK others. All pairs
    of different texts under a key are compared by their sketches, none is left out.
    """
    bands, rows = plan or band_plan(df.count(), least)
    registers = max(bands * rows, SKETCH)
    group = F.col(within).cast("string") if within else F.lit("")
    base = df.select(group.alias("g"), *text_id(F.col(text)), F.col(text).alias("text")).where("text is not null")
    sketches = ["s1", "s2", "t1", "t2", "t3", "t4"]
    schema = T.StructType(
        [T.StructField("g", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("h1", *sketches)), T.StructField("keys", T.ArrayType(T.IntegerType(), False))]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        known: set[tuple] = set()
        for b in batches:
            ids = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for s in blocks(b.column(2), 3_000_000):
                if len(known) > SIGNED:
                    known.clear()
                new = [i for i in range(s.start, s.stop) if not (ids[i] in known or known.add(ids[i]))]
                doc, run, times = shingles.bags(b.column(2).take(pa.array(new, pa.int64())).to_pylist())
                has = np.unique(doc)
                if not len(has):
                    continue
                number = np.searchsorted(has, doc)
                sig = bag_minhash(number, run, times if bag else np.ones(len(times), np.int64), len(has), registers)
                bits = bit_sketch(sig)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), pa.array(band_keys(sig, bands, rows).reshape(-1)))
                at = pa.array(np.array(new, np.int64)[has])
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(bits[:, i]) for i in range(6)), keys], names=schema.names)

    signed = cut(base.select("g", "h1", "text").mapInArrow(sign, schema))
    place = signed.select(F.xxhash64("g").alias("gh"), "h1", F.posexplode("keys").alias("band", "k"))
    # one number for group, band and key
    place = place.select((F.shiftleft(F.col("band").cast("long"), 32) + F.pmod("k", F.lit(1 << 32))).bitwiseXOR(F.col("gh")).alias("key"), "h1")
    # keys of single texts go first; then the sketches come to what is left, so that chance meetings end in the join that finds them
    shared = place.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(place.join(shared, "key").select("key", "h1", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")).distinct())
    sketch = signed.select("g", "h1", "s1", "s2").dropDuplicates(["g", "h1"])
    met = met.join(sketch, "h1").withColumn("block", F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int"))
    zero, last = F.lit(0), F.col("blocks") - 1
    a = met.select("key", "g", F.col("h1").alias("a"), F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("block").alias("lo"), F.explode(F.sequence("block", last)).alias("hi"))
    b = met.select("key", F.col("g").alias("g2"), F.col("h1").alias("b"), F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.explode(F.sequence(zero, "block")).alias("lo"), F.col("block").alias("hi"))
    apart = F.bit_count(F.col("a1").bitwiseXOR(F.col("b1"))) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    likely = a.join(b, ["key", "lo", "hi"]).where("(lo < hi or a < b) and a <> b and g = g2").where(SKETCH - apart >= agreeing(least, 1))
    likely = likely.select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _verified(base, cut(_likelier(likely, signed, least)), size, least, bag, within)


def _likelier(pairs: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """The pairs that agree in the sketches of two bits too."""
    names = ["t1", "t2", "t3", "t4"]
    bits = signed.select("g", "h1", *names).dropDuplicates(["g", "h1"])
    for side in ("a", "b"):
        pairs = pairs.join(bits.select("g", F.col("h1").alias(side), *(F.col(c).alias(f"{side}{c}") for c in names)), ["g", side])
    apart = F.lit(0)
    for c in names:
        x = F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))
        apart = apart + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return pairs.where(SKETCH - apart >= agreeing(least, 2)).select("g", "a", "b")


def _verified(base: DataFrame, pairs: DataFrame, size: int, least: float, bag: bool, within: str | None) -> DataFrame:
    """The pairs whose exact likeness is enough; only texts that are in a pair are read again."""
    wanted = cut(pairs.select("g", F.col("a").alias("h1")).union(pairs.select("g", F.col("b").alias("h1"))).distinct())
    if wanted.count() <= BROADCAST_ROWS:  # the texts then stay where they are
        wanted = F.broadcast(wanted)
    schema = T.StructType(
        [T.StructField("g", T.StringType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]
        + [T.StructField("runs", T.ArrayType(T.LongType(), False))]
    )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for b in batches:
            for s in blocks(b.column(3), 3_000_000):
                doc, run, times = shingles.bags(b.column(3)[s.start : s.stop].to_pylist())
                if bag:  # the i-th occurrence of a run is an element of its own, so that a bag becomes a set
                    row = np.repeat(np.arange(len(doc)), times)
                    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    with np.errstate(over="ignore"):
                        doc, run = doc[row], _mix(run[row] + nth.astype(np.uint64) * _GOLD)
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=s.stop - s.start))])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(run.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(b.column(i)[s.start : s.stop] for i in range(3)), lists], names=schema.names)

    texts = base.join(wanted, ["g", "h1"], "left_semi").dropDuplicates(["g", "h1", "h2"]).select("g", "h1", "h2", "text").mapInArrow(runs, schema)
    texts = cut(texts)
    a = texts.select("g", F.col("h1").alias("a"), F.col("h2").alias("h2_a"), F.col("runs").alias("ra"))
    b = texts.select("g", F.col("h1").alias("b"), F.col("h2").alias("h2_b"), F.col("runs").alias("rb"))
    both = F.size(F.array_intersect("ra", "rb"))
    out = pairs.join(a, ["g", "a"]).join(b, ["g", "b"]).withColumn("both", both)
    out = out.withColumn("likeness", F.col("both") / (F.size("ra") + F.size("rb") - F.col("both"))).where(F.col("likeness") >= least)
    cols = [F.col("a").alias("h1_a"), "h2_a", F.col("b").alias("h1_b"), "h2_b", "likeness"]
    return out.select(*([F.col("g").alias(within)] if within else []), *cols)


def text_id(text) -> list:
    """Columns h1, h2 that name a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2")]


def _members(df: DataFrame, key: str, text: str, size: int, within: str) -> tuple[DataFrame, DataFrame]:
    """(rows (within, k, t), members (within, k, h1, h2)) of texts that have a run of `size` words."""
    rows = df.select(F.col(within), F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    words = F.col("t").rlike(r"(?:[\p{L}\p{N}]+[^\p{L}\p{N}]+){%d}[\p{L}\p{N}]" % (size - 1))  # stops at the first run
    return rows, cut(rows.where(words).select(within, "k", *text_id(F.col("t"))).distinct())


def duplicate_keys(df: DataFrame, key: str, text: str, size: int, least: float, within: str, bag: bool = False) -> DataFrame:
    """Distinct rows (within, key_a, key_b): all pairs of different keys with texts of a likeness of at least `least`.

    Exact copies are found by their hashes and near ones by near_duplicates(); key_a is the smaller by code points. A key
    with several texts is in a pair if one of them is. Null keys are in none. The result grows with the square of a group of copies: where
    that is not asked for, duplicate_classes() says the same with a row for each key.
    """
    rows, members = _members(df, key, text, size, within)
    a = members.select(within, F.col("h1").alias("h1_a"), F.col("h2").alias("h2_a"), F.col("k").alias("ka"))
    b = members.select(within, F.col("h1").alias("h1_b"), F.col("h2").alias("h2_b"), F.col("k").alias("kb"))
    near = near_duplicates(rows, "t", size, least, bag, within)
    near = near.join(a, [within, "h1_a", "h2_a"]).join(b, [within, "h1_b", "h2_b"])
    same = members.join(members.withColumnRenamed("k", "kb"), [within, "h1", "h2"]).where("k < kb")
    pairs = near.select(within, "ka", "kb").unionByName(same.select(within, F.col("k").alias("ka"), "kb")).where("ka <> kb")
    return pairs.select(within, F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def duplicate_classes(df: DataFrame, key: str, text: str, within: str, size: int = 5, least: float = 0.8, bag: bool = True) -> DataFrame:
    """Rows (within, key, class_id, links), one per key with a text of at least `size` words.

    Keys are in one class if a chain of texts of a likeness of at least `least`, or of exact copies, leads from one to the other; class_id is its
    smallest key. links: how many different texts are that like to the texts of the key; copies are no links. A key with several texts links
    their classes. Null keys and shorter texts are left out.
    """
    rows, members = _members(df, key, text, size, within)
    near = cut(near_duplicates(rows, "t", size, least, bag, within))

    def node(h1: str, h2: str):
        return F.struct(F.col(within).alias("w"), F.col(h1).alias("h1"), F.col(h2).alias("h2"))

    # only texts that are like others, or whose key has others, take part in the search for classes; all others stand alone
    a, b = node("h1_a", "h2_a"), node("h1_b", "h2_b")
    members = members.select(within, "k", node("h1", "h2").alias("t"))
    several = members.groupBy(within, "k").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi")
    side = several.join(members, [within, "k"]).select(F.col("lo").alias("a"), F.col("t").alias("b"))
    found = components(near.select(a.alias("a"), b.alias("b")).union(side))
    linked = near.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    found = found.join(linked, "node", "left").withColumnRenamed("node", "t")
    keys = members.join(found, "t", "left").groupBy(within, "k").agg(F.min(F.coalesce("least", "t")).alias("of"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    first = keys.groupBy("of").agg(F.min("k").alias("class_id"))
    return keys.join(first, "of").select(within, F.col("k").alias(key), "class_id", "links")
