"""Text, vector and offset functions on literals."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfolio.functions import offsets, vector
from sparkfolio.functions import text as tx
from sparkfolio.functions.language import detect_language
from sparkfolio.operators.chunking import pack, paragraph_spans, recursive_split, section_chunks


def one(spark, expression, **values):
    from pyspark.sql.types import StringType

    df = spark.range(1).select(*[(F.lit(v) if v is not None else F.lit(None).cast(StringType())).alias(k) for k, v in values.items()])
    return df.select(expression.alias("x")).collect()[0].x


def test_tokens(spark):
    assert one(spark, tx.tokenize("t"), t="G06F16/2457 ph-value 3.5 Café!") == ["g06f16/2457", "ph-value", "3.5", "caf"]
    assert one(spark, tx.tokenize("t"), t="") == [] and one(spark, tx.tokenize("t"), t=None) is None
    assert one(spark, tx.estimate_tokens("t"), t="Öl, 2 m²! a_b") == 6
    windows = one(spark, tx.fixed_windows(F.split("t", " "), 20), t=" ".join(map(str, range(100))))
    assert len(windows) == 5 and windows[1].startswith("20 21")
    assert one(spark, tx.fixed_windows(tx.tokenize("t"), 3, 1), t="a b c d e") == ["a b c", "c d e", "e"]
    assert one(spark, tx.fixed_windows(tx.tokenize("t"), 3), t="") == []
    with pytest.raises(ValueError):
        tx.fixed_windows("t", 0)


def test_text_parts(spark):
    assert one(spark, tx.sentences("t"), t=" A b. C?  D! ") == ["A b.", "C?", "D!"]
    assert one(spark, tx.paragraphs("t"), t="a\n \n\n b \n\n\t\n") == ["a", "b"]
    assert one(spark, tx.word_count("t"), t=" \n ") == 0 and one(spark, tx.word_count("t"), t="a\tb") == 2
    assert one(spark, tx.stable_chunk_id("a", "b", F.lit(0), "c"), a="US1", b="sec", c="hello") == one(spark, tx.stable_chunk_id("a", "b", F.lit(0), "c"), a="US1", b="sec", c="hello")
    assert len(one(spark, tx.stable_chunk_id("a", F.lit(None), F.lit(0), "c"), a="US1", c="")) == 12
    assert one(spark, tx.xml_escape("t"), t='<a & "b">') == '&lt;a &amp; "b"&gt;'
    assert [str(one(spark, tx.iso_date("t"), t=d)) for d in ("2020-02-29T1", "2021-02-29", "20200101", "2020-1-1", "")] == ["2020-02-29", "None", "None", "None", "None"]
    assert one(spark, tx.char_error_rate("a", "b"), a="abc", b="abd  x") == pytest.approx(1.0)
    assert one(spark, tx.char_error_rate("a", "b"), a="", b="abc") == 0
    assert one(spark, tx.token_overlap("a", "b"), a="a b", b="b c") == pytest.approx(1 / 3) and one(spark, tx.token_overlap("a", "b"), a="", b="") == 0
    assert one(spark, tx.html_text("t"), t="<style>p{}</style>a<br>b &amp;lt; c") == "a b &lt; c"
    assert one(spark, tx.url_host("t"), t="https://WWW.a.example/x?y") == "www.a.example"


def test_language(spark):
    for text, want in (("the valve of a pump", "en"), ("eine Düse und die Lösung", "de"), ("chaque valve et une pompe", "fr"), ("cada bomba con la válvula", "es"), ("弁は流れを調整する", "ja"), ("xy", "unknown"), (None, "unknown"), ("zzz", "unknown")):
        assert one(spark, detect_language("t"), t=text) == want


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(vector.dot("a", "b"), vector.cosine("a", "b"), vector.squared_l2("a", "b")).collect()
    assert tuple(got[0]) == pytest.approx((1.0, 1 / 50**0.5, 13.0)) and tuple(got[1]) == pytest.approx((0, 0, 2))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30) | st.text("éẹ́ﬁ½Å한한 a", max_size=20), st.sampled_from(offsets.FORMS))
def test_offsets_lead_back(text, form):
    normal, starts, ends = offsets.offset_map(text, form)
    assert normal == unicodedata.normalize(form, text) and len(starts) == len(ends) == len(normal)
    for a in range(len(normal)):
        for b in range(a + 1, min(a + 6, len(normal)) + 1):
            span = text[min(starts[a:b]) : max(ends[a:b])]
            assert normal[a:b] in unicodedata.normalize(form, span)
    if normal:
        assert (min(starts), max(ends)) == (0, len(text))


def test_offsets_in_columns(spark):
    df = spark.createDataFrame([("ﬁx é ½",), ("",), (None,)], "t string").withColumn("m", offsets.build_offset_map("t", "NFKC"))
    m = df.select("m.normalized", offsets.recover_original("m", F.lit(0), F.lit(1)), offsets.recover_original("m", F.lit(0), F.size("m.orig_start")), offsets.original_span("m", F.lit(2), F.lit(2))).collect()
    assert (m[0][0], m[0][1], m[0][2], tuple(m[0][3])) == ("fix é 1⁄2", "ﬁ", "ﬁx é ½", (1, 1))
    assert m[1][0] == "" and m[1][1] is None and m[2][0] is None


def test_packing():
    assert pack([100, 50, 200, 10], 180, 1) == [(0, 2), (1, 2), (2, 3), (3, 4)]
    assert pack([], 10) == [] and pack([500], 10) == [(0, 1)] and pack([1, 1, 1], 10) == [(0, 3)]
    assert [("a\n\n b \n \n\nc")[a:b] for a, b in paragraph_spans("a\n\n b \n \n\nc")] == ["a", " b ", "c"]
    assert all(len(x) <= 20 for x in recursive_split("word " * 50 + "x" * 90, 20, 5)) and recursive_split("", 5) == []


def test_section_chunks(spark):
    text = "Café one two.\n\n" + "three four five " * 10 + "\n\nsix"
    df = spark.createDataFrame([("s", text, 1), ("e", "", 1), ("n", None, 1)], "section_id string, text string, norm_start int")
    rows = section_chunks(df, ["section_id"], "text", target=20, overlap=1).collect()
    assert {r.section_id for r in rows} == {"s"} and rows[0].text.startswith("Café one")
    for r in rows:
        assert unicodedata.normalize("NFC", text[r.orig_start : r.orig_end]) == unicodedata.normalize("NFC", text)[r.norm_start : r.norm_end]
