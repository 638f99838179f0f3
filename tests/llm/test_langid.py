import random

import pytest
from pyspark.sql import functions as F

from cladeflow.llm import langid as li

WORDS = {
    "en": "the samples were kept because only few reads remained and nobody could say why this week".split(),
    "de": "die Proben wurden behalten weil nur wenige Lesungen blieben und niemand konnte sagen warum".split(),
    "fr": "les échantillons ont été gardés car il ne restait que peu de lectures et personne ne savait".split(),
    "es": "las muestras se guardaron porque solo quedaban pocas lecturas y nadie pudo decir el motivo".split(),
    "pt": "as amostras foram mantidas porque restavam poucas leituras e ninguém sabia dizer o motivo não".split(),
    "nl": "de monsters werden bewaard omdat er slechts weinig lezingen over waren en niemand wist waarom".split(),
}


def line(rnd, lang, n=12):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def found(spark):
    rnd = random.Random(5)
    rows, truth = [], {}
    for i in range(400):
        lang = rnd.choice(li.LANGUAGES)
        other = rnd.choice(li.LANGUAGES)
        lines = [line(rnd, lang), "", line(rnd, lang), "((QZ1:0.2,QZ2:0.3):0.1);", line(rnd, other)]
        label = lang if rnd.random() < 0.7 else rnd.choice([None, "xx", "", other, f" {lang.upper()}-XX ", li.NAMES[lang][-1].title()])
        truth[i] = (label, {0: lang, 2: lang, 4: other})
        rows.append((i, "\n".join(lines), label, rnd.choice(["A", "a ", None]), rnd.choice(["h1", None]), 1))
    rows += [(1000, None, "en", "a", "h1", 1), (1001, "", None, "a", None, 1), (1002, "LRT=2; p=0.3\nACGTACGTAA", "en", None, None, 1)]
    df = spark.createDataFrame(rows, "k long, body string, lab string, src string, hst string, words int")
    return li.languages(df, "k", "body", "lab", "src", "hst").cache(), truth


def test_lines_and_documents(found):
    got, truth = found
    right = total = 0
    for r in got.where("doc_id < 1000").collect():
        lines = {x["line_no"]: x["d"] for x in r["lines"]}
        assert set(lines) == {0, 2, 4}
        for k, lang in truth[r["doc_id"]][1].items():
            total += 1
            right += lines[k]["lang"] == lang
            assert 1 / 6 - 1e-9 <= lines[k]["confidence"] <= 1
    assert right / total > 0.98


def test_texts_without_words(found):
    for r in found[0].where("doc_id >= 1000").collect():
        assert (r["words"], r["lang"], r["confidence"], r["lines"]) == (0, None, None, [])


def test_foreign_lines_follow_the_label(found):
    got, truth = found
    norm = {n: k for k, v in li.NAMES.items() for n in v}
    want = {(d, k, x) for d, (label, lines) in truth.items() for k, x in lines.items() if norm.get((label or "").strip().lower().split("-")[0]) != x}
    have = {(r["doc_id"], r["line_no"], r["lang"]) for r in li.foreign_lines(got).collect()}
    assert len(want & have) / len(want | have) > 0.96


def test_segments_cover_all_lines(found):
    got, _ = found
    segs = li.segments(got).collect()
    words = got.agg(F.sum("words")).first()[0]
    assert sum(s["words"] for s in segs) == words
    assert all(s["first_line"] <= s["last_line"] for s in segs)


@pytest.mark.parametrize(("label", "want"), [("en", "en"), (" EN_us ", "en"), ("Portuguese", "pt"), ("pt-BR", "pt"), ("dut", "nl"), ("gl", None), ("und", None), ("", None), (None, None), ("0", None), ("english language", None)])
def test_labels(spark, label, want):
    df = spark.createDataFrame([(label,)], "c string")
    assert df.select(li.declared_language(F.col("c")).alias("x")).first()["x"] == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "k long, body string, lab string, src string, hst string")
    assert li.languages(df, "k", "body", "lab", "src", "hst").count() == 0


def test_unsure_texts_can_stay_open(spark):
    words = {"en": "the and with results were found in samples from", "de": "und die mit ergebnisse wurden in proben aus der gefunden"}
    docs = [(i, words[lang], lang, "a", "h") for i, lang in enumerate(["en", "de"] * 40)] + [(100, "zzyx qwv", None, "a", "h")]
    df = spark.createDataFrame(docs, "k long, body string, lab string, src string, hst string")
    run = lambda least: {r["doc_id"]: r for r in li.languages(df, "k", "body", "lab", "src", "hst", least_confidence=least).collect()}
    plain, strict = run(0.0), run(0.97)
    assert plain[100]["lang"] is not None and plain[100]["confidence"] < 0.97
    assert strict[100]["lang"] is None and strict[100]["confidence"] == plain[100]["confidence"] and strict[100]["lines"][0]["d"]["lang"] is None
    assert {r["lang"] for k, r in strict.items() if k < 100} == {"en", "de"}
