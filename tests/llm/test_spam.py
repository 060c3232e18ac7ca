"""Spam by recurrence: grammar is learned, repetition decides, and prose of languages that nobody listed stands."""

import random

import numpy as np
import pytest

from sparkfolio.llm import spam

# Sentences of languages that the collection below knows nothing of.
FOREIGN = {
    "ru": "Насос соединён с клапаном, который регулирует поток жидкости в системе. Датчик измеряет давление, и контроллер сравнивает его с заданным значением. Если давление превышает порог, клапан закрывается и подаётся сигнал.",
    "pl": "Pompa jest połączona z zaworem, który reguluje przepływ cieczy w układzie. Czujnik mierzy ciśnienie, a sterownik porównuje je z wartością zadaną. Gdy ciśnienie przekroczy próg, zawór zamyka się i wysyłany jest sygnał.",
    "tr": "Pompa, sistemdeki sıvı akışını düzenleyen bir vanaya bağlıdır. Sensör basıncı ölçer ve denetleyici bunu ayarlanan değerle karşılaştırır. Basınç eşiği aştığında vana kapanır ve bir sinyal gönderilir.",
    "zh": "该泵与调节系统中液体流动的阀门相连。传感器测量压力，控制器将其与设定值进行比较。当压力超过阈值时，阀门关闭并发送信号。这种结构降低了能耗，提高了装置的可靠性。",
    "ko": "펌프는 시스템의 유체 흐름을 조절하는 밸브에 연결된다. 센서는 압력을 측정하고 제어기는 이를 설정값과 비교한다. 압력이 임계값을 초과하면 밸브가 닫히고 신호가 전송된다.",
    "th": "ปั๊มเชื่อมต่อกับวาล์วซึ่งควบคุมการไหลของของเหลวในระบบ เซ็นเซอร์วัดความดันและตัวควบคุมเปรียบเทียบกับค่าที่ตั้งไว้",
    "hi": "पंप एक वाल्व से जुड़ा है जो प्रणाली में द्रव के प्रवाह को नियंत्रित करता है। संवेदक दाब को मापता है और नियंत्रक उसकी तुलना निर्धारित मान से करता है।",
    "it": "La pompa è collegata a una valvola che regola il flusso del liquido nel sistema. Il sensore misura la pressione e il regolatore la confronta con il valore impostato.",
    "fi": "Pumppu on yhdistetty venttiiliin, joka säätää nesteen virtausta järjestelmässä. Anturi mittaa painetta, ja ohjain vertaa sitä asetettuun arvoon.",
}


def corpus(rng):
    """Sentences of an invented language with two words of grammar, and spam of its nouns."""
    noun = lambda: "".join(rng.choice(("ka", "lo", "mi", "ru", "te", "va", "so", "ni")) for _ in range(3))
    prose = [" ".join(f"Zu {noun()} {noun()} hem {noun()} zu {noun()} hem {noun()} {noun()} {noun()}." for _ in range(6)) for _ in range(60)]
    shop = [noun() for _ in range(6)]
    stuffed = [" | ".join(rng.choice(shop) + " " + rng.choice(shop) for _ in range(40)) for _ in range(4)]
    stuffed += [". ".join(" ".join(rng.choice(shop) for _ in range(9)) for _ in range(8)) + "." for _ in range(4)]
    tags = [" > ".join(f"{noun()} {noun()}" for _ in range(40)) for _ in range(4)] + [" ".join(noun() for _ in range(90)) for _ in range(2)]
    links = [" | ".join(f'<a href="http://{noun()}.example/{i}">{noun()} {noun()}</a>' for i in range(12)) for _ in range(3)]
    return prose, stuffed, tags, links


def frame(spark, texts, lang="xx"):
    return spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")


def test_grammar_is_learned(spark):
    prose, stuffed, tags, links = corpus(random.Random(5))
    df = frame(spark, prose + stuffed + tags + links + [None, "", "  "])
    assert {r.word for r in spam.grammar_words(df, lang="lang").collect()} == {"zu", "hem"}
    assert {r.word for r in spam.grammar_words(df).collect()} == {"zu", "hem"}
    assert spam.grammar_words(df.limit(5)).count() == 0  # too few to say
    got = {r.doc_id for r in spam.find_spam(df, lang="lang", known=()).collect()}
    assert got == set(range(len(prose), len(prose + stuffed + tags + links)))
    got = {r.doc_id for r in spam.find_spam(df.union(df).repartition(5), lang="lang", known=()).collect()}
    assert got == set(range(len(prose), len(prose + stuffed + tags + links)))


def test_recurrence_decides():
    prose, stuffed, tags, links = corpus(random.Random(6))
    f = spam.features(stuffed, spam.Terms(("zu", "hem")))
    assert spam.is_spam(f).all()
    off = {k: np.zeros(len(v)) if k in ("autocorrelation", "gap_regularity") else v for k, v in f.items()}
    assert not spam.is_spam(off).any()
    f = spam.features(tags, spam.Terms(("zu", "hem")))
    assert spam.is_spam(f).all() and not spam.is_spam({**f, "distinct_share": np.zeros(len(tags))}).any()


@pytest.mark.parametrize("known", [(), spam.KNOWN])
def test_prose_of_unknown_languages_stands(spark, known):
    prose, *_ = corpus(random.Random(7))
    df = frame(spark, prose).union(frame(spark, FOREIGN.values(), None).selectExpr("doc_id + 1000", "text", "lang"))
    assert spam.find_spam(df, lang="lang", known=known).count() == 0


def test_markup_is_no_word():
    terms = spam.Terms()
    f = spam.features(['<a href="x.example/a">cheap toner</a> <a href="y.example">toner</a> <b>ink</b> cheap ink toner sale'], terms)
    assert f["n_terms"][0] == 10 and f["listed"][0] == 1 and f["links"][0] == 0.2
