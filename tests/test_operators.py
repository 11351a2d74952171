"""Fixture tests of the operators on words, pages, fonts and corrections."""

import io
import zipfile

from pyspark.sql import functions as F

from pagewright.operators import admission, blocks, corrections, crosspage, documents, fonts, layout, vocabulary
from pagewright.operators.repair import repaired_corruption
from pagewright.sources import files

TSV = "doc_id int, text array<string>, conf array<double>, left array<int>, top array<int>, width array<int>, height array<int>"


def test_words_become_rows_with_tabs(spark):
    tsv = spark.createDataFrame([(1, ["Name", "Amount", "|", "Ram", "500", "_", "नेप"], [90.0, 90.0, 90.0, 90.0, 90.0, 90.0, 36.0], [10, 200, 300, 10, 200, 5, 10], [10, 10, 10, 40, 41, 70, 70], [40, 60, 5, 30, 30, 5, 30], [12] * 7)], TSV)
    assert layout.layout_text(layout.words_of(tsv)).collect()[0].text == "Name\tAmount\nRam\t500\nनेप"


def spans(spark, places):
    return spark.createDataFrame([(1, 1, 1, 1, k, t, a, b) for k, (t, a, b) in enumerate(places)], "doc_id int, page int, block int, line int, span int, text string, x0 double, x1 double")


def test_span_gaps(spark):
    joined = lambda p, **k: layout.joined_spans(spans(spark, p), **k).collect()[0].text
    assert joined([("a", 50.0, 58.0), ("b", 59.0, 70.0)]) == "ab"
    assert joined([("a", 50.0, 58.0), ("b", 73.0, 80.0)]) == "a b"
    assert joined([("a", 50.0, 58.0), ("b", 198.0, 210.0)]) == "a\tb"
    assert joined([("a", 50.0, 58.0), ("b", 59.0, 70.0)], from_start=True) == "a b"


def grid(rows):
    return [(1, 1, t, float(x), float(y), float(x + 6 * len(t)), float(y + 10)) for y, row in rows for x, t in row]


PLACES = "doc_id int, page int, text string, x0 double, y0 double, x1 double, y1 double"


def test_borderless_table(spark):
    rows = [(20 * k, [(40, f"a{k}"), (150, f"b{k}"), (230, f"c{k}")]) for k in range(4)]
    got = layout.borderless_tables(spark.createDataFrame(grid(rows), PLACES)).orderBy("line").collect()
    assert [r.cells for r in got] == [[f"a{k}", f"b{k}", f"c{k}"] for k in range(4)] and {r.table for r in got} == {0}
    prose = [(20 * k, [(40, "some words in a line")]) for k in range(5)]
    assert layout.borderless_tables(spark.createDataFrame(grid(prose), PLACES)).count() == 0


def test_drawn_table(spark):
    df = spark.createDataFrame([([["a", "नेप"], ["long"]],), ([],)], "rows array<array<string>>")
    got = [r[0] for r in df.select(layout.drawn_table(F.col("rows"))).collect()]
    assert got == ["┌──────┬────────┐\n│ a    │ नेप │\n├──────┼────────┤\n│ long │        │\n└──────┴────────┘", ""]


def test_reading_order_of_two_columns(spark):
    boxes = [(1, 40, 10, 540, 30), (2, 40, 40, 260, 60), (3, 320, 45, 540, 65), (4, 40, 70, 260, 90), (5, 320, 75, 540, 95), (6, 40, 100, 540, 120), (7, 40, 130, 260, 150), (8, 320, 130, 540, 150)]
    e = spark.createDataFrame([(1, 1, i, float(a), float(b), float(c), float(d)) for i, a, b, c, d in boxes], "doc_id int, page int, element_id int, x0 double, y0 double, x1 double, y1 double")
    wide = e.where("x1 - x0 < 400")
    columns = layout.columns_of(wide, 600.0)
    assert columns.count() == 2
    got = layout.reading_order(e, columns).orderBy("reading_order").collect()
    assert [r.element_id for r in got] == [1, 2, 4, 3, 5, 6, 7, 8]


def test_prevailing_blocks(spark):
    rows = [(1, 1, 1, "table", 80.0, 0.0, 0.0, 100.0, 100.0), (1, 1, 2, "paragraph", 90.0, 10.0, 10.0, 90.0, 90.0), (1, 1, 3, "paragraph", 70.0, 200.0, 0.0, 300.0, 100.0), (1, 1, 4, "heading", 60.0, 201.0, 1.0, 299.0, 99.0)]
    b = spark.createDataFrame(rows, "doc_id int, page int, block_id int, kind string, confidence double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.block_id for r in blocks.prevailing(b).collect()) == [1, 4]


def test_vocabulary_and_correction(spark):
    vocab = vocabulary.vocabulary(spark)
    assert vocab.count() == 274
    words = spark.createDataFrame([("नेपाल",), ("नेपल",), ("सरकर",), ("अअअअ",)], "word string")
    got = {r.word: (r.corrected, r.confidence) for r in vocabulary.corrected_words(words, vocab).collect()}
    assert got["नेपाल"] == ("नेपाल", 100.0) and got["नेपल"] == ("नेपाल", 85.0) and got["सरकर"] == ("सरकार", 85.0) and got["अअअअ"] == ("अअअअ", 30.0)


def test_only_damaged_words_change(spark):
    rows = spark.createDataFrame([(1, "काठमाडौ सरकार पोखरा"), (2, "कखगघ ठिक"), (3, "साधारण  पाठ"), (4, None), (5, "")], "id int, text string")
    got = {r.id: r.text for r in repaired_corruption(rows, vocabulary.vocabulary(spark), ["id"]).collect()}
    assert got == {1: "काठमाडौ सरकार पोखरा", 2: "कखगघ ठिक", 3: "साधारण पाठ", 4: None, 5: ""}


def test_near_misses_and_their_correction(spark):
    words = spark.createDataFrame([(1, p, w) for p in (1, 2, 3, 4, 5) for w in ("सरकार", "नेपाल")] + [(1, 2, "सरकर"), (1, 3, "सब")], "doc_id int, page int, word string")
    misses = crosspage.near_misses(words)
    assert [(r.page, r.original, r.suggested, r.frequency) for r in misses.collect()] == [(2, "सरकर", "सरकार", 5)]
    pages = spark.createDataFrame([(1, 2, "यो सरकर हो"), (1, 3, "सब")], "doc_id int, page int, text string")
    assert [r.text for r in crosspage.with_corrections(pages, misses).orderBy("page").collect()] == ["यो सरकार हो", "सब"]


def test_running_lines_and_continuations(spark):
    lines = spark.createDataFrame([(1, p, "header", f"Act  page {p}") for p in range(1, 5)] + [(1, 1, "footer", "once"), (2, 1, "header", "x"), (2, 2, "header", "x")], "doc_id int, page int, zone string, line string")
    assert [(r.doc_id, r.zone, r.line, r.n_pages) for r in crosspage.running_lines(lines).collect()] == [(1, "header", "Act page #", 4)]
    pages = spark.createDataFrame([(1, 1, "ends here."), (1, 2, "goes on"), (1, 3, "last")], "doc_id int, page int, text string")
    assert [(r.page, r.next_page) for r in crosspage.continued_sentences(pages).collect()] == [(2, 3)]


def test_fonts(spark):
    rows = spark.createDataFrame([(1, 1, "ABCDEF+Preeti", "g]kfn ;/sf/"), (1, 2, "Mangal", "नेपाल"), (1, 3, "Odd", "sf cf of")], "doc_id int, place int, font string, text string")
    table = fonts.font_table(rows)
    got = {r.font: (r.family, r.conversion_map, r.is_legacy) for r in table.collect()}
    assert got == {"ABCDEF+Preeti": ("preeti", "preeti", True), "Mangal": ("unicode", None, False), "Odd": ("preeti", "preeti", True)}
    summary = fonts.font_summary(table).collect()[0]
    assert (summary.n_fonts, summary.dominant_family, summary.dominant_map, summary.is_mixed, summary.strategy) == (3, "preeti", "preeti", True, "mixed")
    found = {r.font: r.family for r in fonts.resolved(spark.createDataFrame([(1, "preeti"), (1, "Mangal"), (1, "Arial")], "doc_id int, font string"), table).collect()}
    assert found == {"preeti": "preeti", "Mangal": "unicode", "Arial": "unicode"}


def test_corrections(spark):
    e = spark.createDataFrame([(1, 10, "ab", "ac", "", "", 70.0), (2, 20, "ab", "ac", "", "", 90.0), (3, 30, "xy", "xz", "Preeti", "", 60.0), (4, 40, "long", "longer", "Preeti", "legal", 80.0)] + [(k, k, "ab", "ac", "", "", 50.0) for k in range(5, 9)], "event_id int, seen_at int, original string, corrected string, font string, domain string, confidence double")
    store = corrections.store(e)
    assert {(r.original, r.n, r.confidence) for r in store.collect()} == {("ab", 6, 90.0), ("xy", 1, 60.0), ("long", 1, 80.0)}
    assert [(r.wrong, r.meant, r.n) for r in corrections.common_confusions(e).collect()] == [("b", "c", 6), ("y", "z", 1)]
    asked = spark.createDataFrame([("ab", "Other", "x"), ("xy", "Preeti", ""), ("zz", "", "")], "original string, font string, domain string")
    got = {r.original: (r.suggestion, r.confidence) for r in corrections.suggested(asked, store, corrections.font_maps(e)).collect()}
    assert got == {"ab": ("ac", 85.0), "xy": ("xz", 80.0), "zz": (None, None)}
    assert {(r.original, r.n) for r in corrections.merged(store, e).collect()} == {("ab", 12), ("xy", 2), ("long", 2)}


def test_admission(spark):
    times = [0, 1, 2, 61, 62, 63, 64]
    r = spark.createDataFrame([(1, k, t * 1_000_000) for k, t in enumerate(times)], "client long, request_id long, at_us long")
    got = admission.admitted(r, 2, 60_000_000).orderBy("request_id").collect()
    assert [x.admitted for x in got] == [True, True, False, True, True, False, False]


def test_text_files(spark):
    d = spark.createDataFrame([(1, "one\n\n--- Page Break ---\n\ntwo", 2), (2, "alone", 1), (3, " ", 0), (4, None, 0)], "doc_id int, text string, n_pages int")
    got = {r.doc_id: r.content for r in documents.text_files(d).collect()}
    bar = "═" * 60
    assert got[1] == f"{bar}\n  PAGE 1 / 2\n{bar}\n\none\n\n{bar}\n  PAGE 2 / 2\n{bar}\n\ntwo\n" and got[2] == "alone\n" and got[3] == got[4]


def test_graph_order(spark):
    nodes = spark.createDataFrame([(1, n) for n in "abcd"], "doc_id int, node string")
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "a", "c")], "doc_id int, source string, target string")
    assert {r.node: r.rank for r in documents.graph_order(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}


def test_file_decoders(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f'<w:document {w}><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:br w:type="page"/><w:t>two</w:t></w:r></w:p></w:body></w:document>'
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "a.docx").write_bytes(b.getvalue())
    (tmp_path / "b.html").write_text("<p>x &amp; y</p><script>no</script><p>z</p>")
    (tmp_path / "c.txt").write_text("p1\fp2")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {(r.path.rpartition("/")[2], r.page): (r.text, r.status) for r in files.pages(files.scan(spark, str(tmp_path))).collect()}
    assert got[("a.docx", 1)][0] == "one" and got[("a.docx", 2)][0] == "two" and got[("b.html", 1)][0] == "x & y\n\nz" and got[("c.txt", 2)][0] == "p2"
    assert got[("d.pdf", 0)][1] == "unsupported" and got[("e.docx", 0)][1].startswith("unreadable")
