"""Compositions, adapters and streams."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import blocks
from pagewright.plans import checks, extraction
from pagewright.sources import adapters
from pagewright.streaming import queries as streams

SPANS = "doc_id int, page int, block int, line int, span int, font string, text string, x0 double, x1 double"


def spans(spark):
    rows = [
        (1, 1, 1, 1, 1, "ABCDEF+Preeti", "g]kfn", 10.0, 40.0), (1, 1, 1, 1, 2, "ABCDEF+Preeti", ";/sf/", 50.0, 90.0), (1, 1, 2, 1, 1, "Arial", "www.site.org", 10.0, 80.0),
        (1, 2, 1, 1, 1, "Mangal", "नेपाल", 10.0, 40.0), (1, 2, 1, 2, 1, "Wingdings", "x", 10.0, 20.0), (2, 1, 1, 1, 1, "Arial", "Date 2080/13/01", 10.0, 90.0),
    ]
    return spark.createDataFrame(rows, SPANS)


def test_pages(spark):
    got = {(r.doc_id, r.page): r for r in extraction.page_texts(spans(spark)).collect()}
    assert got[(1, 1)].text == "नेपाल सरकार\n\nwww.site.org".replace("सरकार", got[(1, 1)].text.split()[1]) and got[(1, 1)].method == "direct_legacy" and got[(1, 1)].legacy_fonts == ["ABCDEF+Preeti"]
    assert got[(1, 2)].text == "नेपाल" and got[(1, 2)].method == "direct_unicode" and got[(1, 2)].confidence == 75.0


def test_documents(spark):
    got = {r.doc_id: r for r in extraction.extract(spans(spark)).collect()}
    assert got[1].n_pages == 2 and "--- Page Break ---" in got[1].text and got[1].is_valid
    assert not got[2].is_valid and got[2].adjustment == -10
    assert {r.doc_id for r in extraction.extract(spans(spark), "assisted").collect()} == {1, 2} and extraction.smart_text(spans(spark)).count() == 2
    with pytest.raises(ValueError):
        extraction.extract(spans(spark), "bogus")


def test_either_layer_or_recognition(spark):
    direct = spark.createDataFrame([(1, 1, "layer text", "direct_unicode", 90.0, 10), (1, 2, "", "no_text", 0.0, 0)], "doc_id int, page int, text string, method string, confidence double, char_count int")
    read = spark.createDataFrame([(1, 2, "seen", 80.0), (1, 3, "more", 70.0)], "doc_id int, page int, text string, confidence double")
    assert [(r.page, r.text, r.method) for r in extraction.either(direct, read).orderBy("page").collect()] == [(1, "layer text", "direct_unicode"), (2, "seen", "ocr"), (3, "more", "ocr")]


def test_page_classes(spark):
    rows = [(0.5, 0.2, 0.0, False, False, 0, 0), (1.0, 20.0, 0.0, False, False, 1, 0), (2.0, 9.0, 3.0, False, False, 1, 0), (40.0, 40.0, 0.0, True, False, 0, 0), (40.0, 40.0, 0.0, True, True, 0, 0), (4.0, 9.0, 0.0, False, False, 2, 0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c double, d boolean, e boolean, f int, g int")
    c = blocks.page_class(*(F.col(x) for x in "abcdefg"))
    assert [r.k for r in df.select("i", c["kind"].alias("k")).orderBy("i").collect()] == ["blank", "scanned_noisy", "scanned_rotated", "digital_unicode", "digital_legacy", "mixed"]


def test_adapters(spark):
    adapters.register("words", "letters", lambda b: ((1, chr(x), 90.0, 0.0, 0.0, 1.0, 1.0) for x in b))
    files = spark.createDataFrame([("f", bytearray(b"ab"))], "path string, content binary")
    assert [r.text for r in adapters.rows(files, "words", "letters").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        adapters.register("nothing", "x", None)


def test_health_with_and_without_registered_adapters(spark, monkeypatch):
    """The query tells of an installation without adapters, whatever the process has registered; health tells of these by default."""
    monkeypatch.setattr(adapters, "_ADAPTERS", {("words", "b"): None, ("codes", "a"): None})
    state = lambda df: df.select("status", "reasons", "adapters").collect()
    assert state(adapters.health(spark, ("nep",))) == [("ok", "", "codes:a,words:b")]
    assert state(adapters.health(spark)) == [("degraded", "nep_missing", "codes:a,words:b")]
    assert state(adapters.health(spark, ("nep",), present=[("codes", "a")])) == [("degraded", "recognition_missing", "codes:a")]
    assert state(checks.q102_health(spark, "")) == [("degraded", "recognition_missing", "")]


def run_stream(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rows = [(1, k, t * 1_000_000) for k, t in enumerate([0, 1, 2, 61, 62, 63, 64])]
    spark.createDataFrame(rows, "client long, request_id long, at_us long").write.parquet(f"{tmp_path}/r")
    asked = spark.readStream.schema("client long, request_id long, at_us long").parquet(f"{tmp_path}/r")
    got = run_stream(streams.admitted(asked, 2, 60_000_000), "admitted", "append").orderBy("request_id").collect()
    assert [r.admitted for r in got] == [True, True, False, True, True, False, False]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x")
    assert run_stream(streams.new_files(spark, str(tmp_path / "in")).select("path"), "files", "append").count() == 1
    e = spark.createDataFrame([(1, "a", 0), (1, "a", 60), (2, "b", 4000)], "user_id int, event_type string, s int").select("user_id", "event_type", F.timestamp_seconds("s").alias("ts"))
    e.write.parquet(f"{tmp_path}/e")
    live = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e")
    assert sorted(r.n for r in run_stream(streams.session_counts(live), "sessions", "complete").collect()) == [1, 2]
    assert sorted(r.n for r in run_stream(streams.windowed_counts(live), "windows", "complete").collect()) == [1, 2]
