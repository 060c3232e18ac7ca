"""Near duplicates: copies, big families, classes and their links, against brute force."""

import itertools
import random

from pyspark.sql import functions as F

from sparkfolio.llm import neardup
from sparkfolio.llm.classes import components


def joined(edges):
    """Smallest node of each node's class, by merging sets."""
    of = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        one = of.get(a, {a}) | of.get(b, {b})
        for x in one:
            of[x] = one
    return {x: min(s) for x, s in of.items()}


def test_components_are_brute_force(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2100)] + [(None, 5), (7, None), (9, 9)] + edges[:20]
    got = components(spark.createDataFrame(edges, "a int, b int")).collect()
    assert {r.node: r.least for r in got} == joined(edges) and len(got) == len(joined(edges))
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def family(rng, n, words=40):
    """Texts that differ from one another in a word or two at the end."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    return [" ".join([*base, f"x{i}", f"y{rng.randrange(10**6)}"]) for i in range(n)]


def test_blocks_lose_no_pair(spark, monkeypatch):
    rng = random.Random(3)
    texts = family(rng, 60) + family(rng, 3) + [f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(20)]
    df = spark.createDataFrame([("s", f"k{i:03}", t) for i, t in enumerate(texts)], "src string, key string, text string")
    want = {("s", f"k{i:03}", f"k{j:03}") for lo, hi in ((0, 60), (60, 63)) for i, j in itertools.combinations(range(lo, hi), 2)}
    for block in (2000, 7):
        monkeypatch.setattr(neardup, "BLOCK", block)
        assert {tuple(r) for r in neardup.duplicate_keys(df, "key", "text", 3, 0.8, "src").collect()} == want


def test_copies_are_one_text(spark):
    """A text that most rows hold costs one signature for each task, no pairs, and a row for each key in the classes."""
    one = "the pump moves a fluid through the valve into the tank of the plant"
    many = spark.range(60_000).select(F.lit("s").alias("src"), F.col("id").cast("string").alias("key"), F.lit(one).alias("text"))
    other = spark.createDataFrame([("s", "near", one + " x"), ("s", "far", "nothing here is like the others at all"), ("s", None, one), ("s", "null", None), ("s", "short", "a b")], "src string, key string, text string")
    df = many.unionByName(other).repartition(8)
    assert neardup.near_duplicates(df, "text", 3, 0.8).count() == 1
    got = neardup.duplicate_classes(df, "key", "text", "src", size=3, bag=False)
    by = {(r.class_id, r.links): r.n for r in got.groupBy("class_id", "links").agg(F.count("*").alias("n")).collect()}
    assert by == {("0", 1): 60_001, ("far", 0): 1}


def test_classes_count_bags(spark):
    a, b = "p q r s t " * 6, "p q r s t " * 7
    rows = [("x", "1", a), ("x", "2", b), ("x", "3", "p q r s t"), ("y", "4", a), ("x", "2", "u v w x y z"), ("x", "5", "u v w x y z"), ("x", "6", None)]
    df = spark.createDataFrame(rows, "src string, key string, text string").selectExpr("*", "0 as links", "'c' as class_id", "1 as h1")
    got = {(r.src, r.key, r.class_id, r.links) for r in neardup.duplicate_classes(df, "key", "text", "src").collect()}
    assert got == {("x", "1", "1", 1), ("x", "2", "1", 1), ("x", "5", "1", 0), ("x", "3", "3", 0), ("y", "4", "4", 0)}
    flat = {(r.key, r.class_id) for r in neardup.duplicate_classes(df.where("src = 'x'"), "key", "text", "src", bag=False).collect()}
    assert flat == {("1", "1"), ("2", "1"), ("5", "1"), ("3", "3")}
    assert neardup.duplicate_classes(df.where("1 = 0"), "key", "text", "src").count() == 0
