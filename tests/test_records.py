"""References, nested records and hierarchies against brute force on small fixtures."""

import json
import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.operators.flatten import INTAKE_RULES, _parse, _parse_deep, flatten, typed_table, visit, write_tables
from sparkfolio.operators.hierarchy import circles, descendants, hierarchy
from sparkfolio.operators.references import citation_references, claim_references, orphan_counts, orphan_references

T = [datetime(2021, 1, d) for d in range(1, 29)]
CLAIMS = "claim_id bigint, doc_id string, number int, claim_text string, dependent_on int, loaded_at timestamp_ntz, cancelled_at timestamp_ntz, ref_key string"
PATENTS = "record_id bigint, doc_id string, citations array<string>, ingested_at timestamp_ntz, removed_at timestamp_ntz, at string"
PRIOR = "doc_id string, registered_at timestamp_ntz, removed_at timestamp_ntz"


def orphans(spark, claims, patents, prior):
    c, p, q = spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(patents, PATENTS), spark.createDataFrame(prior, PRIOR)
    return orphan_references({"patent_claims": claim_references(c), "patents": citation_references(p, q)})


def test_reference_states(spark):
    claims = [
        (1, "A", 1, None, None, T[5], T[6], "x"),
        (2, "A", 2, "", 1, T[5], None, "x"),
        (3, "A", 3, "", 1, T[6], None, "x"),  # the parent was cancelled by then
        (4, "A", 4, "", 9, T[5], None, "x"),
        (5, "A", 5, "", 6, T[5], None, "x"),  # the parent comes later
        (6, "A", 6, "", None, T[7], None, "x"),
        (7, "A", 4, "", 9, T[9], None, "x"),  # the same once more
        (8, None, 1, "", 5, T[9], None, "x"),
        (9, "A", None, "", 5, T[9], None, "x"),
    ]
    patents = [
        (1, "US10000001A1", ["US-10000002.b2", "us 10,000,002 B2", None, "n/a", "see search report", "EP9999999A1", "EP1000000A1"], T[5], None, "x"),
        (2, "US10000002B2", None, T[6], None, "x"),
        (3, "US10000003B2", [], T[6], None, "x"),
        (4, None, ["EP9999999A1"], T[6], None, "x"),
    ]
    got = {tuple(r) for r in orphans(spark, claims, patents, [("EP1000000A1", T[0], T[5]), (None, T[0], None)]).collect()}
    assert got == {
        ("patent_claims", "A", "3", "1", "deleted", "2021-01"),
        ("patent_claims", "A", "4", "9", "missing", "2021-01"),
        ("patent_claims", "A", "5", "6", "late", "2021-01"),
        ("patents", "US10000001A1", "", "US10000002B2", "late", "2021-01"),
        ("patents", "US10000001A1", "", "EP9999999A1", "missing", "2021-01"),
        ("patents", "US10000001A1", "", "EP1000000A1", "deleted", "2021-01"),
    }


def test_references_of_empty_tables(spark):
    found = orphans(spark, [], [], [])
    assert found.count() == 0 and orphan_counts(found).count() == 0


def brute_tree(rows):
    up = {}
    for g, n, p in rows:
        if g is not None and n is not None:
            up[g, n] = min(up.get((g, n), 2**63), 2**63 - 1 if p is None else p)
    out = {}
    for g, n in up:
        way, x, seen = [n], n, {n}
        while (g, up[g, x]) in up:
            x = up[g, x]
            if x in seen:
                way = None
                break
            seen.add(x)
            way.append(x)
        out[g, n] = (-1, -1, "") if way is None else (way[-1], len(way) - 1, "/".join(map(str, reversed(way))))
    return out


@pytest.mark.parametrize("seed,part_rows", [(1, 1000), (2, 40), (3, 7)])
def test_hierarchy_is_brute_force(spark, seed, part_rows):
    rng = random.Random(seed)
    rows = [("chain", i, i + 1) for i in range(150)] + [("back", i, i - 1) for i in range(150)] + [("star", i, 0) for i in range(60)]
    rows += [("ring", i, (i + 1) % 9) for i in range(9)] + [("ring", 20 + i, i) for i in range(9)] + [("self", 1, 1), ("self", 2, 1), (None, 1, 2), ("n", None, 2)]
    rows += [("mix", i, rng.randrange(90)) for i in range(90)] + [("wood", i, rng.randrange(i - 12, i + 1) or None) for i in range(1, 90)]
    rows += rows[:20]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, n int, p int").selectExpr("*", "'x' as path", "1 as state", "g as t")
    tree = hierarchy(df, "g", "n", "p", part_rows=part_rows)
    got = {(r.g, r.n): (r.root, r.node_depth, r.node_path) for r in tree.collect()}
    want = brute_tree(rows)
    assert got == want and tree.count() == len(want)
    below = {(r.g, r.n, r.descendant, r.distance) for r in descendants(tree, "g", "n").collect()}
    assert below == {(g, int(a), n, d - i) for (g, n), (_, d, path) in want.items() if d > 0 for i, a in enumerate(path.split("/")[:-1])}
    if part_rows == 40:
        rings = {(r.g, r.circle, r.n) for r in circles(tree, df, "g", "n", "p").collect()}
        assert {x for x in rings if x[0] in ("ring", "self")} == {("ring", 0, i) for i in range(9)} | {("self", 1, 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_descendants_of_circles_are_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [("ring", i, (i + 1) % 9) for i in range(9)] + [("ring", 20 + i, 19 + i if i else 3) for i in range(21)] + [("self", 1, 1), ("self", 2, 1), ("self", 3, 2), ("open", 2, 1), ("open", 3, 2)]
    rows += [("mix", i, rng.randrange(60)) for i in range(60)] + [("pair", 1, 2), ("pair", 2, 1), ("pair", 3, 2), ("pair", 5, None), (None, 1, 1)]
    up = {(g, n): p for g, n, p in rows if g is not None}
    want = set()
    for g, n in up:
        x, distance, seen = n, 0, {n}
        while (g, up.get((g, x))) in up and up[g, x] not in seen:
            x, distance = up[g, x], distance + 1
            seen.add(x)
            want.add((g, x, n, distance))
    df = spark.createDataFrame(rows + rows[:9], "g string, n int, p int")
    got = [tuple(r) for r in descendants(hierarchy(df, "g", "n", "p", part_rows=20), "g", "n", df, "p").collect()]
    # an absent parent is no node, so it has no descendants
    assert sorted(got) == sorted(w for w in want if (w[0], w[1]) in up)


def test_hierarchy_of_nothing(spark):
    tree = hierarchy(spark.createDataFrame([], "g string, n int, p int"), "g", "n", "p")
    assert tree.count() == 0 and descendants(tree, "g", "n").count() == 0


RECORD = {
    "doc_id": "X",
    "claims": [None, {"number": "1", "text": "t", "limitations": {"text": "l", "sub": [{"text": "s"}, None, {"text": "u", "sub": {"text": "v"}}]}}],
    "description": {"heading": "H", "paragraphs": "p", "subsections": [{"paragraphs": ["a", None, "b"]}]},
    "assignees": ["N", {"name": "M", "contacts": [{"type": "a", "value": "b"}]}],
    "sections": None,
}


def test_flatten(spark, tmp_path):
    rows = [(1, json.dumps(RECORD)), (2, None), (3, ""), (4, "[]"), (5, json.dumps(RECORD)[:-1]), (6, '{"a": NaN}'), (7, "{}"), (None, '{"claims": 3}')]
    df = spark.createDataFrame(rows, "record_id bigint, payload string").selectExpr("*", "'x' as node_path", "'y' as body")
    flat = flatten(df, "record_id", "payload")
    got = [(r.child_kind, r.node_path, r.parent_path) for r in flat.where("record_id = 1").collect()]
    assert got == [
        ("claim", "claims[1]", ""),
        ("limitation", "claims[1].limitations[0]", "claims[1]"),
        ("limitation", "claims[1].limitations[0].sub[0]", "claims[1].limitations[0]"),
        ("limitation", "claims[1].limitations[0].sub[2]", "claims[1].limitations[0]"),
        ("limitation", "claims[1].limitations[0].sub[2].sub[0]", "claims[1].limitations[0].sub[2]"),
        ("section", "description[0]", ""),
        ("paragraph", "description[0].paragraphs[0]", "description[0]"),
        ("section", "description[0].subsections[0]", "description[0]"),
        ("paragraph", "description[0].subsections[0].paragraphs[0]", "description[0].subsections[0]"),
        ("paragraph", "description[0].subsections[0].paragraphs[2]", "description[0].subsections[0]"),
        ("assignee", "assignees[0]", ""),
        ("assignee", "assignees[1]", ""),
        ("contact", "assignees[1].contacts[0]", "assignees[1]"),
    ]
    assert {r.record_id for r in flat.collect()} == {1, None}
    write_tables(flat, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert [r.name for r in typed_table(back, "assignee").where("record_id = 1").orderBy("node_path").collect()] == ["N", "M"]
    assert [(r.number, r.text) for r in typed_table(back, "claim").where("record_id = 1").collect()] == [(1, "t")]
    assert [r.text for r in typed_table(back, "paragraph").orderBy("node_path").collect()] == ["p", "a", "b"]
    assert flatten(df.where("1 = 0"), "record_id", "payload").count() == 0


def scalars(x):
    if isinstance(x, (dict, list)):
        return [s for v in (x.values() if isinstance(x, dict) else x) for s in scalars(v)]
    return [] if x is None else [str(x)]


def test_every_scalar_comes_out_once(spark):
    record = RECORD | {
        "title": "T", "source": {"provider": "P", "note": None}, "more": {"a.b": "dot", "a": {"b": ["l0", {"c": "l1"}]}},
        "claims": ["lone claim", {"number": "no number", "text": "ct", "dependent_on": 4, "dependentOn": 5, "limitations": "ll"}, ["in", "array"]],
        "assignees": ["N", {"name": "M", "address": {"city": "C", "country": "D"}, "contacts": {"type": "a", "value": "b"}}],
        "description": [{"heading": "H", "paragraphs": ["p", {"x": "obj"}]}],
    }
    df = spark.createDataFrame([(1, json.dumps(record))], "record_id bigint, payload string")
    flat = flatten(df, "record_id", "payload", root="record")
    out, tables = [], {}
    for tag in ("record", "assignee", "contact", "claim", "limitation", "section", "paragraph"):
        tables[tag] = [r.asDict() for r in typed_table(flat, tag).collect()]
        for r in tables[tag]:
            out += [str(v) for k, v in r.items() if v is not None and k not in ("record_id", "node_path", "parent_path", "node_depth", "rest")]
            out += json.loads(r["rest"] or "{}").values()
    assert sorted(out) == sorted(scalars(record))
    assert [(r["address_city"], r["address_country"]) for r in tables["assignee"]] == [(None, None), ("C", "D")]
    assert [(r["doc_id"], r["title"], r["source_provider"], r["node_path"]) for r in tables["record"]] == [("X", "T", "P", "")]


def test_deep_json(spark):
    deep = '{"claims":' + '[{"limitations":' + '[{"sub":' * 5000 + "[]" + "}]" * 5000 + "}]}"
    assert len(list(visit(_parse(deep), INTAKE_RULES))) == 5001
    for good in ('{"a": [1, -2.5e3, "x\\u00e9\\"", true, null, {}, []], "b": {"c": [[]]}}', " [ ] ", "3"):
        assert _parse_deep(good) == json.loads(good)
    for bad in ('{"a": 1,}', "[1,]", '{"a" 1}', "[1 2]", "{", '["x"', "", "[] []", "[NaN]", "{,}"):
        with pytest.raises(ValueError):
            _parse_deep(bad)
    df = spark.createDataFrame([(1, deep)], "record_id bigint, payload string")
    assert flatten(df, "record_id", "payload", payload=False).count() == 5001


VALUES = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(VALUES, st.sampled_from([None, 1]))
def test_deep_parser_is_the_library_parser(value, indent):
    text = json.dumps(value, indent=indent)
    assert _parse_deep(text) == json.loads(text)
    for cut in (text[:-1], text + "]", text + "x"):
        try:
            want = json.loads(cut)
        except ValueError:
            with pytest.raises(ValueError):
                _parse_deep(cut)
        else:
            assert _parse_deep(cut) == want


def test_long_chains_are_given_away_as_they_are_made():
    import tracemalloc

    import numpy as np
    import pandas as pd

    from sparkfolio.operators import hierarchy as h

    n = 6_000
    order = np.random.default_rng(1).permutation(n)
    part = pd.DataFrame({"g": "a", "x": np.arange(n)[order], "parent": (np.arange(n) - 1)[order], "has_parent": (np.arange(n) > 0)[order]})
    tracemalloc.start()
    letters = sum(sum(map(len, rows["path"])) for rows in h._local(part, "g", "x"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert letters == sum(sum(map(len, map(str, range(i + 1)))) + i for i in range(n)) and peak < letters / 3
    part = part[part["x"] < 300]
    got = pd.concat(list(h._local(part, "g", "x"))).set_index("x")
    assert all(got.loc[i, "path"] == "/".join(map(str, range(i + 1))) and got.loc[i, "depth"] == i for i in range(300))


def test_counts_are_sums_of_references(spark):
    from sparkfolio.operators.references import orphan_references, reference_counts

    targets = spark.createDataFrame([("k1", 5), ("k2", 1)], "ref_key string, d int").selectExpr("ref_key", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, d) as born", "cast(null as timestamp_ntz) as gone")
    refs = spark.range(40).selectExpr("concat('d', id) as doc_id", "'' as ref_from", "concat('k', id % 4) as ref_to", "concat('k', id % 4) as ref_key", "timestamp_ntz'2020-01-02' + make_interval(0, 0, 0, cast(id % 6 as int) * 12) as at")
    sources = {"t": (targets, refs.union(refs.limit(1).selectExpr("doc_id", "ref_from", "ref_to", "ref_key", "cast(null as timestamp_ntz) as at")))}
    rows = orphan_references(sources).groupBy("ref_table", "ref_month", "ref_state").count()
    assert sorted(map(str, rows.collect())) == sorted(str(r).replace("refs=", "count=") for r in reference_counts(sources).collect()) and rows.count() > 3
