"""The segment join against brute force for all numbers of edits, and which slips link names."""

import itertools
import random

import pytest

from sparkfolio.llm import names


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 9))) for _ in "ab")
        for most in (0, 1, 2, 3):
            assert names.distance(a, b, most) == min(levenshtein(a, b), most + 1)
    assert names.exchanged("abcd", "acbd") and not names.exchanged("abcd", "acbe") and not names.exchanged("ab", "abc") and not names.exchanged("ab", "ab")


@pytest.mark.parametrize("least, most, letters", [(3, 6, "abc"), (6, 11, "abcd"), (19, 24, "abcdefgh")])
def test_segment_join_is_brute_force(spark, least, most, letters):
    """Each range of lengths crosses one of the bounds at which the number of edits changes."""
    rng = random.Random(least)
    seeds = ["".join(rng.choices(letters, k=rng.randint(least, most))) for _ in range(60)]
    given = ["", "x", "anna", "otto"]
    words = set()
    for s in seeds:
        for _ in range(5):
            w = list(s)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 1)] = rng.choice(letters) * rng.randint(0, 1)
                w = w or ["a"]
            words.add((f"{''.join(w)} {rng.choice(given)}".strip(), len(w)))
    got = {(r.a, r.b) for r in names.segment_join(spark.createDataFrame(sorted(words), "name string, head int")).collect()}
    want, both = set(), sorted(words)
    for (a, _), (b, _) in itertools.product(both, repeat=2):
        if a != b and len(a) >= len(b) and (" " in a) == (" " in b) and levenshtein(a, b) <= names.edits(len(a)):
            want.add((a, b))
    # a blank that moved is no slip of a word: such pairs may be left out
    apart = {(a, b) for a, b in want if sum(abs(len(x) - len(y)) for x, y in zip(a.split(" "), b.split(" "))) > names.edits(len(a))}
    assert want - apart <= got <= want and len(want) > 20


def linked(spark, people=(), firms=()):
    rows = [([x], None) for x, n in people for _ in range(n)] + [(None, [x]) for x, n in firms for _ in range(n)]
    df = spark.createDataFrame(rows, "inventors array<string>, assignees array<string>")
    return {(r.name_a, r.name_b) for r in names.variant_spellings(df).collect()}


def pairs(*groups):
    return {tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)}


def test_short_words_given_names_and_first_letters(spark):
    people = [("John Lee", 20), ("John Leee", 2), ("Katherine Mueller", 30), ("Kathrine Mueller", 2), ("Katherine Mullr", 1), ("Peter Jalhozker", 12), ("Peter Kalhozker", 1)]
    firms = [("Bosch GmbH", 20), ("Bsch GmbH", 1), ("Sony KK", 20), ("Sny KK", 2), ("Siemens AG", 30), ("Siemmenns AG", 2), ("Lukfuv Electronics AG", 9), ("Lukfuv Elecrtonics AG", 1)]
    want = pairs(("John Lee", "John Leee"), ("Katherine Mueller", "Kathrine Mueller", "Katherine Mullr"), ("Peter Jalhozker", "Peter Kalhozker"))
    want |= pairs(*[[f[0] for f in firms[i : i + 2]] for i in range(0, 8, 2)])
    assert linked(spark, people, firms) == want


def test_words_of_their_own_stand(spark):
    """Names as alike as those above, but as frequent, or of words that others have too."""
    people = [("John Lee", 20), ("John Lea", 9), ("Katherine Mueller", 30), ("Kathrine Mueller", 2), ("Kathrine Schmidt", 5), ("Kathrine Weber", 4), ("Anna Huber", 20), ("Anne Huber", 15)]
    firms = [("Sony KK", 20), ("Sonz KK", 15), ("Lukfuv Optics AG", 20), ("Lukfuv Robotics AG", 2)]
    assert linked(spark, people, firms) == set()


def test_slips_of_slips_are_followed(spark):
    people = [("Peter Jalhozkerdin", 30), ("Peter Jalhozkerdn", 9), ("Peter Jalhozkrdn", 4), ("Peter Jalozkrdn", 1)]
    assert linked(spark, people) == pairs([p[0] for p in people])


def test_abbreviations_are_looked_up(spark):
    firms = [("Dorvek International Manufacturing Ltd", 20), ("Dorvek Intl. Mfg. Ltd", 2), ("Dorvek Int. Manuf. Ltd", 1), ("Dorvek Interest Ltd", 5)]
    assert linked(spark, (), firms) == pairs([f[0] for f in firms[:3]])
