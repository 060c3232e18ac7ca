"""Look-alikes in Greek words, styled letters, and rows without a key."""

import pytest

from sparkfolio.llm import lookalike

L, G, C = (lookalike.script(w) for w in ("word", "λόγος", "слово"))


def test_own_script_may_be_greek():
    for wrong, right in (("λόγoς", "λόγος"), ("πρoϊόν", "προϊόν"), ("λόγоς", "λόγος"), ("Aθήνα", "Αθήνα")):
        assert lookalike.repaired(wrong, "", "") == right and lookalike.script(right) == G
    assert lookalike.repaired("fluidе", "", "") == "fluide" and lookalike.repaired("датчиk", "", "") is None and lookalike.repaired("корпyс", "", "") == "корпус"
    for unit in ("μm", "kΩ", "MΩ", "αβ", "λ"):
        assert lookalike.repaired(unit, L, L) is None
    assert lookalike.main_script("λόγoς") == G and lookalike.main_script("слoво") == C


@pytest.mark.parametrize("styled, plain", [("𝐯𝐚𝐥𝐯𝐞", "valve"), ("ⓅⓤⓂⓟ", "PuMp"), ("Ⅳ", "IV"), ("ｖａｌｖｅ", "valve"), ("𝟙𝟚", "12"), ("m²", "m²"), ("½", "½"), ("①", "①"), ("α", "α")])
def test_styled_letters(styled, plain):
    assert lookalike.base_form(styled) == plain


def test_rows_without_keys_keep_their_own_repairs(spark):
    known = "the said pump and the valve λόγος"
    rows = [(None, f"number{i} раіd рumр") for i in range(300)] + [(None, "sаid valve λόγoς"), ("k", known), ("k", "рumр"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "rec_key string, text string").selectExpr("*", "1 as fixes", "2 as __l")
    got = [r.text for r in lookalike.consistent_text(df, ["rec_key"], "text").collect()]
    assert len(got) == len(rows) and "said valve λόγος" in got and None in got and "" in got and "number7 раіd pump" in got
    items = {(r.rec_key, r.item) for r in lookalike.find_oddities(df, ["rec_key"], "text").collect()}
    assert items == {(None, "pump"), ("k", "pump"), (None, "said"), (None, "λόγος")}
