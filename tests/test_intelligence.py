"""Fixture tests of strategies, word checks, scores and structure."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import intelligence as it
from pagewright.operators import vocabulary


def test_page_types_and_regions(spark):
    rows = [(1, 1, "paragraph", True, False, False, "Preeti", "legacy", False, False), (1, 2, "image", False, True, False, None, "unknown", False, True), (1, 3, "table", True, False, True, "Mangal", "unicode", False, False), (1, 3, "figure", False, True, False, None, "unknown", False, False)]
    b = spark.createDataFrame(rows, "doc_id int, page int, kind string, contains_text boolean, contains_image boolean, contains_table boolean, font string, encoding string, mixed_fonts boolean, ocr_eligible boolean")
    got = {r.page: (r.page_type, r.strategy, r.legacy_fonts) for r in it.page_types(b).collect()}
    assert got == {1: ("digital_legacy", "direct_with_conversion", ["Preeti"]), 2: ("scanned_clean", "ocr_standard", []), 3: ("mixed", "hybrid", [])}
    assert [r.strategy for r in it.regions(b).orderBy("page", "kind").collect()] == ["direct_with_conversion", "ocr_standard", "skip", "table_extraction"]
    assert {r.page: r.all_ink for r in it.all_image_based(b).collect()} == {1: False, 2: True, 3: False}


def test_glyphs(spark):
    rows = [(0, "Arial", "क", None, "x"), (1, "Arial", None, "ख", "x"), (2, "Arial", "�", None, "ग"), (3, "Preeti", None, None, "s"), (4, "Arial", None, None, "s"), (5, "Arial", None, None, ""), (6, "Arial", None, None, None)]
    df = spark.createDataFrame(rows, "i int, font string, a string, b string, c string")
    got = [(r.g.text, r.g.confidence) for r in df.select("i", it.glyph(*(F.col(x) for x in ("font", "a", "b", "c"))).alias("g")).orderBy("i").collect()]
    assert got == [("क", 95.0), ("ख", 90.0), ("ग", 80.0), ("s", 40.0), ("s", 75.0), ("�", 0.0), ("�", 0.0)]


def test_words_and_blocks(spark):
    vocab = vocabulary.vocabulary(spark)
    t = spark.createDataFrame([(1, "नेपाल सरकार"), (2, "नेपालाा कमल"), (3, "abc"), (4, ""), (5, None)], "id int, text string")
    words = {r.word: (r.repaired, r.confidence) for r in it.checked_words(it.words_of(t), vocab).collect()}
    assert words["नेपाल"] == ("नेपाल", 100.0) and words["कमल"] == ("कमल", 95.0) and words["नेपालाा"][0] == "नेपाल"
    q = {r.id: (r.n_words, r.confidence, r.n_known) for r in it.block_quality(t, vocab).collect()}
    assert q[1] == (2, 100.0, 2) and q[3] == (0, 100.0, 0) and q[4] == q[5] == (0, 0.0, 0)
    levels = {r.id: r for r in it.confidence_levels(t, vocab).collect()}
    assert levels[1].word == 100.0 and levels[1].line == 85.0 and levels[3].word == 80.0 and levels[4].page == 0.0 and levels[2].uncertain == ["कमल"]


def test_reports(spark):
    e = spark.createDataFrame([(1, 1, 50.0), (1, 2, 90.0)], "doc_id int, element_id int, confidence double")
    r = it.confidence_report(e).collect()[0]
    assert (r.n, r.overall, r.least, r.greatest, r.n_low, r.low) == (2, 70.0, 50.0, 90.0, 1, [1])
    a = spark.createDataFrame([(1, "भ्याट", 20.0), (1, "करयोग्य", 100.0), (1, "जम्मा", 110.0), (2, "भ्याट", 13.0), (2, "करयोग्य", 100.0), (3, "x", 200.0), (3, "जम्मा", 100.0)], "doc_id int, label string, value double")
    assert {(x.doc_id, x.issue) for x in it.amount_issues(a).collect()} == {(1, "vat"), (3, "component")}
    d = spark.createDataFrame([("1999/13/40 2080/01/02",)], "c string")
    assert d.select(it.date_issues(F.col("c")).alias("d")).first().d == ["year", "month", "day"]


def test_structure(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 10.0, 20.0, False, "Title"), (1, 1, 0.0, 20.0, 10.0, False, "text"), (1, 1, 0.0, 30.0, 10.0, True, "bold"), (1, 1, 0.0, 5.0, 10.0, False, " ")], "doc_id int, page int, x0 double, y0 double, size double, bold boolean, text string")
    sizes = spark.createDataFrame([(1, 10.0, [20.0])], "doc_id int, body_size double, sizes array<double>")
    assert it.structured_text(b, sizes).first().text == "\n# Title\ntext\n\n### bold"
    blocks = spark.createDataFrame([(1, 1, 2, "b", 0.0), (1, 1, 1, "a", 80.0), (1, 1, 3, " ", 60.0)], "doc_id int, page int, reading_order int, text string, confidence double")
    assert tuple(it.page_text(blocks).first())[2:] == ("a\n\nb", 70.0)


def test_meaning(spark):
    df = spark.createDataFrame([("दफा १ लागू हुन्छ। कति हो?",), ("",)], "c string")
    got = df.select(it.sentence_meaning(F.col("c"), F.col("c")).alias("m"), it.sentence_context(F.col("c"), F.col("c")).alias("t")).collect()
    assert got[0].m.legal == 1 and got[0].m.questions == 1 and got[0].t.startswith("NEPALI SENTENCE") and got[1].t == ""


def test_hints(spark):
    df = spark.createDataFrame([(["nep"],), (["eng", "nep"],), ([],)], "l array<string>")
    assert [r[0] for r in df.select(it.language_hint(F.col("l"))).collect()] == ["nep", "nep+eng", "nep+eng"]
    assert df.limit(1).select(it.font_confidence(F.lit(True), F.lit(100), F.lit(100), F.lit(True), F.lit(20)), it.recommended_pipeline(F.lit(False), F.lit(True), F.lit(1))).first()[:] == (pytest.approx(100.0), "direct_legacy_conversion")
