"""Spam, look-alikes, scans, near duplicates and names against brute force or planted cases."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import lookalike, names, neardup, scans, spam

# ---------------------------------------------------------------- spam

PROSE = "The pump of the system is coupled to a valve, and the valve controls each line when the sensor of the pump detects a leak in it. "
REPORT = "Search report\n" + "".join(f"D{i}: US{i}123456B2, www.site{i}.example/page. The document describes a pump which is near the valve of the system.\n" for i in range(9))
GLOSSARY = "".join(f"{w}: the part of a machine that is used for the control of a flow.\n" for w in ("valve", "pump", "seal", "rotor"))
SPAM = [
    "buy toner | cheap toner | toner | best gasket set | toner | gasket set | gasket set | toner | buy gasket set",
    "\n".join(f"http://a{i}.example/page-{i}" for i in range(30)),
    PROSE[:60] + "\n" + ", ".join(f"#tag{i}word" for i in range(60)),
    "Cheap toner best valve parts! Discount toner valve parts sale. Toner valve parts toner! Best toner cheap valve parts toner.",
    "; ".join(f"Rotor XA-{i} | {i}.99 EUR | in stock" for i in range(30)),
]
HAM = [PROSE, PROSE * 30, REPORT, GLOSSARY, "1. A pump.\n2. The pump of claim 1, wherein the valve is open.\n" * 9, "弁は流体の流れを調整する474。" * 9, "", " ", "word", None]


def test_spam(spark):
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(SPAM + HAM)] + [(0, SPAM[0], 0.5)], "doc_id bigint, text string, links double")
    assert {r.doc_id for r in spam.find_spam(df).collect()} == set(range(len(SPAM)))
    assert spam.spam_features(df).count() == len(SPAM + HAM) + 1
    assert spam.find_spam(df.where("1 = 0")).count() == 0


def test_spam_in_batches_is_spam_alone():
    texts = SPAM + HAM
    whole = spam.features(texts, spam.Terms())
    for i, t in enumerate(texts):
        one = spam.features([t], spam.Terms())
        assert all(np.isclose(one[k][0], whole[k][i]) for k in spam.FEATURES)


# ---------------------------------------------------------------- look-alikes

TEXTS = {
    "a": "The said pump is coupled. The valve near the said pump and configured as one.",
    "b": "Тһе ѕаіd pump is ﬁne, vａｌｖe​ near\xa0the pump.",
    "c": "Устройство содержит корпус и датчик а также сушку. value of α was 2 m² ½",
    "d": "re\xadjects at 5 MΩ fine",
    "e": "énergie fluidе",  # the corpus doesn't know fluide
    "f": None,
    "g": "",
    "h": " \t\n",
    "i": "two  blanks",
}


def test_lookalikes(spark):
    rows = [("s", k, t, "x") for k, t in TEXTS.items()] + [("s", "b", TEXTS["b"], "x"), (None, None, "ﬁne", "x")]
    df = spark.createDataFrame(rows, "src string, rec_key string, text string, item string").withColumnRenamed("item", "w1")
    got = {}
    for r in lookalike.find_oddities(df, ["src", "rec_key"], "text").collect():
        got.setdefault(r.rec_key, set()).add(r.item)
    assert got == {
        "b": {"The", "said", "fine", "valve", "near the"},
        "d": {"rejects", "MΩ"},
        "e": {"énergie"},
        "i": {"two blanks"},
        None: {"fine"},
    }
    text = {r.rec_key: r.text for r in lookalike.consistent_text(df.where("rec_key is not null").distinct(), ["src", "rec_key"], "text").collect()}
    assert text["b"] == "The said pump is fine, valve near the pump." and text["c"] == TEXTS["c"] and text["f"] is None and text["i"] == "two blanks"
    assert lookalike.find_oddities(df.where("1 = 0"), ["src", "rec_key"], "text").count() == 0


def test_joiners_stay_where_they_mean_something():
    assert lookalike.base_form("می‌خواهم") == "می‌خواهم" and lookalike.base_form("va‌lve") == "valve"


# ---------------------------------------------------------------- near duplicates


def shingles(text, k=3):
    w = re.findall(r"[^\W_]+", text.lower())
    return set(zip(*(w[i:] for i in range(k))))


def test_bag_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    for wa, wb in (([1] * 60, [1] * 30 + [0] * 30), (rng.integers(0, 9, 60), rng.integers(0, 9, 60)), ([5.5] * 10, [2.25] * 10)):
        wa, wb = np.asarray(wa, float), np.asarray(wb, float)
        element = np.random.default_rng(2).integers(0, 2**63, len(wa)).astype(np.uint64)
        doc = np.repeat([0, 1], len(wa))
        w = np.concatenate([wa, wb])
        keep = w > 0
        sig = neardup.bag_minhash(doc[keep], np.concatenate([element, element])[keep], w[keep], 2, 4096)
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 0.035


@pytest.mark.parametrize("bag", [False, True])
def test_near_duplicates_are_brute_force(spark, bag):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocab, k=60)) for _ in range(40)]
    for t in list(texts):
        for edits in (1, 3, 6, 12):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    rows = [("x", f"k{i:03}", t) for i, t in enumerate(texts)] + [("x", "copy", texts[0]), ("y", "other", texts[0]), ("x", "k000", texts[0])]
    rows += [("x", "null", None), ("x", "empty", ""), ("x", "short", "two words"), ("x", "short2", "two words"), ("x", None, texts[0])]
    df = spark.createDataFrame(rows, "src string, key string, text string").selectExpr("*", "1 as h1", "2 as g")
    got = {tuple(r) for r in neardup.duplicate_keys(df, "key", "text", 3, 0.5, "src", bag=bag).collect()}

    def like(a, b):
        if bag:
            from collections import Counter

            x, y = (Counter(list(zip(*(t.split()[i:] for i in range(3))))) for t in (a, b))
            return sum((x & y).values()) / sum((x | y).values())
        return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))

    mine = [(s, k, t) for s, k, t in set(rows) if t and k and len(t.split()) > 2]
    want = {(s, *sorted((k, q))) for (s, k, t), (z, q, u) in itertools.combinations(mine, 2) if s == z and k != q and like(t, u) >= 0.5}
    assert got <= want and len(got) >= 0.98 * len(want) and ("x", "copy", "k000") in got
    assert neardup.duplicate_keys(df.where("1 = 0"), "key", "text", 3, 0.5, "src").count() == 0


# ---------------------------------------------------------------- names


PEOPLE = {
    "Franziska Jalhozker": {"Jalhozker, Franziska", "Dr. Franziska Jalhozker", "Franzi Jalhozker", "F. Jalhozker", "JALHOZKER, Franziska A.", "Franziska Jalhozkr", "Jalhozker Franziska"},
    "Theresa Jalhozker": {"T Jalhozker", "Theresa  Jalhozker ", "Tess Jalhozker", "THERESA JALHOZKER"},
    "José Hozkerduz": {"Jose Hozkerduz", "Hozkerduz, J."},
    "William Moftussax": {"Bill Moftussax", "W.A. Moftussax", "William Motfussax"},
}
FIRMS = {
    "Lukfuv Electronics Robotics GmbH": {"LUKFUV ELECTRONICS ROBOTICS GMBH", "Lukfuv Electr. Robot.", "Robotics Electronics Lukfuv G.m.b.H.", "The Lukfuv-Electronics & Robotics, GmbH"},
    "Lukfuv Electronics AG": {"Lukfuv Electronics Aktiengesellschaft", "Lufkuv Electronics A.G."},
    "University of Babton Optics": {"Univ. of Babton Optics", "Babton University of Optics"},
    "Kobton Materials Pharmaceuticals Ltd.": {"Kobton Materials Pharma Limited", "Kobtton Mat. Pharmaceuticals Ltd"},
}


def test_variant_spellings(spark):
    rows = []
    for table, col in ((PEOPLE, 0), (FIRMS, 1)):
        for main, others in table.items():
            for name, n in [(main, 20), *((o, 2) for o in others)]:
                rows += [(([name], None), (None, [name]))[col]] * n
    rows += [(None, None), ([], []), ([None, "", "  "], [None, "", "..."])]
    df = spark.createDataFrame(rows, "inventors array<string>, assignees array<string>").selectExpr("*", "'x' as name")
    got = {tuple(r) for r in names.variant_spellings(df).collect()}
    want = set()
    for role, table in (("inventor", PEOPLE), ("assignee", FIRMS)):
        for main, others in table.items():
            want |= {(role, *sorted(p)) for p in itertools.combinations({main, *others}, 2)}
    assert got == want
    assert names.variant_spellings(df.where("1 = 0")).count() == 0


# ---------------------------------------------------------------- scans


def scanned_rows():
    rng = random.Random(9)
    words = "retrieval-tuning mixing suffers compressor solvent pump each the valve controls near said rotor modern corner".split()
    body = [(f"c{i}", " ".join(rng.choices(words, k=40)) + ".", "Pump with solvent") for i in range(120)]
    bad = [
        ("h", "the com-\npressor mixing near\nthe retrieval-\ntuning pump.", "Pump with solvent"),
        ("p", "the pump controls the com\xad\n\n- 3 -\nPUMP WITH SOLVENT\n\npressor mixing near each valve.", "Pump with solvent"),
        ("m", "each rnixing snffers near the cornpressor\nsaid so1vent.", "Pump with solvent"),
        ("r", "the valve controls\nUS 10,000,002 A1\np. 2\nApp1. No. 10/000,008   7\nMaproldek et al.\nsaid pump.\n\n4/12\n\n[0086] each pump.", None),
        ("n", None, None),
        ("e", "", "x"),
        ("b", "  \n ", "x"),
        ("one", "12", "x"),
        (None, "each rnixing pump\nsaid.", None),
    ]
    return body + bad


def test_scans(spark):
    df = spark.createDataFrame([("s", *r, "z") for r in scanned_rows()], "src string, rec_key string, text string, title string, item string")
    df = df.withColumnRenamed("item", "word")
    got = {(r.rec_key, r.defect, r.item) for r in scans.scan_faults(df.union(df.limit(5)), ["src", "rec_key"]).collect()}
    assert got == {
        ("h", "hyphenation", "compressor"),
        ("h", "hyphenation", "retrieval-tuning"),
        ("p", "hyphenation", "compressor"),
        ("p", "page_number", "- 3 -"),
        ("p", "running_header", "PUMP WITH SOLVENT"),
        ("m", "misread", "mixing"),
        ("m", "misread", "suffers"),
        ("m", "misread", "compressor"),
        ("m", "misread", "solvent"),
        ("r", "running_header", "US 10,000,002 A1"),
        ("r", "running_header", "App1. No. 10/000,008   7"),
        ("r", "running_header", "Maproldek et al."),
        ("r", "page_number", "p. 2"),
        ("r", "page_number", "4/12"),
        (None, "misread", "mixing"),
    }
    text = {r.rec_key: r.text for r in scans.reflowed(df, ["src", "rec_key"]).collect()}
    assert text["h"] == "the compressor mixing near the retrieval-tuning pump."
    assert text["p"] == "the pump controls the compressor mixing near each valve."
    assert text["m"] == "each mixing suffers near the compressor said solvent."
    assert text["r"] == "the valve controls said pump.\n\n[0086] each pump." and text["n"] is None
    assert scans.scan_faults(df.where("1 = 0"), ["src", "rec_key"]).count() == 0


def test_a_valid_rare_word_stands_by_its_contexts(spark):
    rng = random.Random(3)
    ours, theirs = "pump valve rotor seal piston motor gear shaft".split(), "glass filler ceramic polymer resin necklace".split()
    rows = [(f"h{i}", " ".join(f"{rng.choice(ours)} head {rng.choice(ours)}" for _ in range(8))) for i in range(60)]
    rows += [(f"g{i}", " ".join(f"{rng.choice(theirs)} {rng.choice(theirs)}" for _ in range(8))) for i in range(60)]
    rows += [(f"b{i}", f"{theirs[i % 6]} bead {theirs[(i * 5 + 1) % 6]}") for i in range(24)]  # one glyph from head, a twentieth as often
    rows += [("m", "pump hcad valve")]  # a misreading among head's own neighbours
    df = spark.createDataFrame([("s", *r, None) for r in rows], "src string, rec_key string, text string, title string")
    got = {(r.rec_key, r.item) for r in scans.scan_faults(df, ["src", "rec_key"]).collect()}
    assert got == {("m", "head")}


def test_long_words_and_all_places_are_tried(spark):
    for word, read in (("configurational", "c0nfigurati0nal"), ("0xideofoam", "0xide0f0am"), ("n" * 70 + "o", "n" * 70 + "0")):
        assert word in scans.readings(read)
    vocabulary = spark.createDataFrame([("configurational", 50), ("c0nfigurati0nal", 1), ("m" * 70, 50), ("m" * 69 + "rn", 1)], "word string, n bigint")
    got = {(r.word, r.fix) for r in scans.suspects(vocabulary).collect()}
    assert got == {("c0nfigurati0nal", "configurational"), ("m" * 69 + "rn", "m" * 70)}


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    df = spark.createDataFrame([("s", *r) for r in scanned_rows()], "src string, rec_key string, text string, title string")
    want = set(map(tuple, scans.scan_faults(df, ["src", "rec_key"]).collect()))
    monkeypatch.setattr(scans, "FILTER_BITS", 64)  # most words pass it
    assert set(map(tuple, scans.scan_faults(df, ["src", "rec_key"]).collect())) == want


def test_filter_holds_its_words(spark):
    words = [f"wörd{i}" for i in range(500)]
    bits = scans.word_filter(spark.createDataFrame([(w,) for w in words], "word string"), 1 << 16)
    assert all(scans.in_filter(bits, w) for w in words) and sum(scans.in_filter(bits, f"x{i}") for i in range(2000)) < 20


def test_vectors_link_the_words(spark, monkeypatch):
    """With vectors that say nothing no misread word is corrected."""
    df = spark.createDataFrame([("s", *r) for r in scanned_rows()], "src string, rec_key string, text string, title string")
    monkeypatch.setattr(scans, "context_vectors", lambda counts: (np.zeros((scans.BUCKETS, scans.DIMENSIONS)), np.full(scans.BUCKETS, 1 / scans.BUCKETS)))
    assert scans.scan_faults(df, ["src", "rec_key"]).where("defect = 'misread'").count() == 0
    assert scans.scan_faults(df, ["src", "rec_key"]).where("defect = 'hyphenation'").count() == 3


def test_context_vectors_tell_contexts_apart():
    """Two groups of buckets that stand beside their own group only."""
    counts = np.zeros((scans.BUCKETS, scans.BUCKETS))
    counts[:20, :20] = counts[20:40, 20:40] = 50
    v, share = scans.context_vectors(counts)
    u = v[:40] / np.linalg.norm(v[:40], axis=1, keepdims=True)
    like = u @ u.T
    assert like[:20, :20].mean() > 0.9 and like[:20, 20:].mean() < 0.3 and abs(share.sum() - 1) < 1e-9
    assert np.isfinite(scans.context_vectors(np.zeros_like(counts))[0]).all()


def test_headers_by_recurrence(spark):
    """A line of no known form that interrupts sentences on page after page, with page numbers in Roman figures."""
    rng = random.Random(4)
    words = "pump valve rotor seal motor gear shaft moves drives holds the near each".split()
    some = lambda: " ".join(rng.choices(words, k=8))
    pages = [f"{some()}\nMETHOD AND APPARATUS FOR COOLING\n{some()}\n- xii -\n{some()}." for _ in range(4)]
    long = "\n".join(f"{some()}\nCooling of Machines {i}\n{some()}" for i in range(3))
    cutted = f"{some()} com-\nMETHOD AND APPARATUS FOR COOLING\npressor {some()}"
    rows = [("s", f"p{i}", "d1", t) for i, t in enumerate(pages)] + [("s", "cut", "d1", cutted), ("s", "long", "d2", long), ("s", "once", "d3", pages[0].replace("xii", "iv"))]
    rows += [("s", f"copy{i}", "d4", f"{words[0]} the\nGear Box Unit\nmoves") for i in range(6)] + [(None, None, None, pages[1])]
    df = spark.createDataFrame([(*r, None) for r in rows], "src string, rec_key string, doc string, text string, title string")
    got = {}
    for r in scans.scan_faults(df, ["src", "rec_key"]).collect():
        got.setdefault(r.rec_key, set()).add((r.defect, r.item))
    head = ("running_header", "METHOD AND APPARATUS FOR COOLING")
    assert all(got[f"p{i}"] == {head, ("page_number", "- xii -")} for i in range(4))
    assert got["cut"] == {head, ("hyphenation", "compressor")}
    assert got["long"] == {("running_header", f"Cooling of Machines {i}") for i in range(3)}
    assert got["once"] == {("page_number", "- iv -")} and not any(k and k.startswith("copy") for k in got)
    text = {r.rec_key: r.text for r in scans.reflowed(df, ["src", "rec_key"]).collect()}
    assert "COOLING" not in text["p0"] and " compressor " in text["cut"] and "COOLING" in text["once"] and "Gear Box Unit" in text["copy0"]


def test_null_keys_keep_their_own_corrections(spark):
    rows = scanned_rows()
    df = spark.createDataFrame([("s", None, r[1], r[2]) for r in rows], "src string, rec_key string, text string, title string")
    got = {r.text for r in scans.reflowed(df, ["src", "rec_key"]).collect()}
    assert "each mixing suffers near the compressor said solvent." in got and "the compressor mixing near the retrieval-tuning pump." in got and None in got
    assert scans.reflowed(df, ["src", "rec_key"]).count() == len({(r[1], r[2]) for r in rows})


def test_band_plan_keeps_its_promises():
    for n in (1, 10**6, 10**9, 10**12):
        for least in (0.3, 0.5, 0.8, 1.0):
            bands, rows = neardup.band_plan(n, least)
            assert (1 - min(least, 0.99) ** rows) ** bands <= neardup.MISSED and n * neardup.CHANCE**rows <= neardup.MEETINGS


def test_near_duplicates_with_another_plan(spark):
    base = [f"w{i} x{i} y{i} z{i}" for i in range(30)]
    text = " ".join(base)
    df = spark.createDataFrame([(1, text), (2, text + " more words here"), (3, "other words altogether now")], "k int, t string")
    for plan in ((4, 2), (100, 4)):
        assert len(neardup.near_duplicates(df, "t", plan=plan).collect()) == 1


def test_many_texts_are_verified_by_a_join(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "a b c d e f g")], "k int, t string").withColumn("s", F.lit("x"))
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    got = {(r.key_a, r.key_b) for r in neardup.duplicate_keys(df, "k", "t", 3, 0.5, "s").collect()}
    assert got == {(1, 2), (1, 3), (2, 3)}
