"""What is known of pages, words and glyphs, and what follows: strategies, routes, word checks, scores, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import devanagari as dv
from ..functions.legacy import force_converted, is_legacy_font, map_name
from ..functions.text import DEVANAGARI, SPACE, corruption_score, is_blank, n_of, n_visible, share, stripped
from .vocabulary import closest_words, corrected_words, known

# What a page's class is called, and how its text is got.
PAGE_TYPES = {"digital_unicode": "digital_unicode", "digital_legacy": "digital_legacy", "digital": "digital_unicode", "scanned": "scanned_clean", "scanned_noisy": "scanned_noisy", "scanned_rotated": "scanned_rotated", "scanned_image": "scanned_clean", "image_only": "image_only", "mixed": "mixed", "blank": "blank", "table_heavy": "table_heavy"}
STRATEGIES = {"digital_unicode": "direct", "digital_legacy": "direct_with_conversion", "scanned_clean": "ocr_standard", "scanned_noisy": "ocr_enhanced", "scanned_rotated": "ocr_with_deskew", "image_only": "ocr_standard", "mixed": "hybrid", "blank": "skip", "table_heavy": "table_extraction", "form_page": "form_extraction"}
# Which region a block's class is, and how its text is got.
REGIONS = {"heading": "heading", "paragraph": "body_text", "list": "list", "table": "table", "figure": "figure", "caption": "caption", "image": "figure", "chart": "figure", "formula": "equation", "qr_code": "qr_code", "barcode": "figure", "signature": "signature", "stamp": "stamp", "header": "header", "footer": "footer", "margin_note": "margin_note", "handwriting": "margin_note"}
BLOCK_STRATEGIES = {"table": "table_extraction", "qr_code": "skip", "barcode": "skip", "figure": "skip", "image": "skip", "chart": "skip", "stamp": "skip", "signature": "skip", "handwriting": "ocr_standard", "margin_note": "ocr_standard", "header": "direct", "footer": "direct", "heading": "direct", "list": "direct", "paragraph": "direct", "caption": "direct", "formula": "direct"}


def _looked_up(c: Column, table: dict[str, str], otherwise: Column | str) -> Column:
    found = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    for k, v in table.items():
        found = F.when(c == k, v).otherwise(found)
    return found


def page_types(blocks: DataFrame) -> DataFrame:
    """doc_id, page, page_type, strategy, fonts, legacy_fonts, has_tables, has_images, has_stamps, has_text of pages' blocks (doc_id, page, kind, contains_text, font, encoding)."""
    legacy = (F.col("encoding") == "legacy") & F.col("font").isNotNull()
    p = blocks.groupBy("doc_id", "page").agg(
        F.bool_or("contains_text").alias("has_text"), F.bool_or(F.col("kind").isin("image", "figure", "chart")).alias("has_images"), F.bool_or(F.col("kind") == "table").alias("has_tables"), F.bool_or(F.col("kind") == "stamp").alias("has_stamps"),
        F.array_sort(F.collect_set("font")).alias("fonts"), F.array_sort(F.collect_set(F.when(legacy, F.col("font")))).alias("legacy_fonts"),
    )
    kind = F.when(F.col("has_text") & ~F.col("has_images"), F.when(F.size("legacy_fonts") > 0, "digital_legacy").otherwise("digital_unicode")).when(~F.col("has_text") & F.col("has_images"), "scanned").otherwise("mixed")
    page_type = _looked_up(kind, PAGE_TYPES, "mixed")
    return p.select("doc_id", "page", page_type.alias("page_type"), _looked_up(page_type, STRATEGIES, "hybrid").alias("strategy"), "fonts", "legacy_fonts", "has_tables", "has_images", "has_stamps", "has_text")


def regions(blocks: DataFrame) -> DataFrame:
    """blocks with region and strategy; what a block holds overrules its class."""
    s = (
        F.when(F.col("contains_table"), "table_extraction")
        .when(F.col("mixed_fonts") | (F.col("encoding") == "mixed"), "pdf_extraction")
        .when(F.col("encoding") == "unicode", "direct")
        .when(F.col("encoding") == "legacy", "direct_with_conversion")
        .when(~F.col("contains_text") & F.col("contains_image"), F.when(F.col("ocr_eligible"), "ocr_standard").otherwise("skip"))
        .otherwise(_looked_up(F.col("kind"), BLOCK_STRATEGIES, "direct"))
    )
    return blocks.withColumn("region", _looked_up(F.col("kind"), REGIONS, "body_text")).withColumn("strategy", s)


def all_image_based(blocks: DataFrame) -> DataFrame:
    """doc_id, page, all_ink: whether recognition is all that can read the page."""
    return blocks.groupBy("doc_id", "page").agg(F.bool_and("ocr_eligible").alias("all_ink"))


def language_hint(languages: Column) -> Column:
    nep, eng = F.array_contains(languages, "nep"), F.array_contains(languages, "eng")
    return F.when(nep & eng, "nep+eng").when(nep, "nep").when(eng, "eng").otherwise("nep+eng")


def recommended_pipeline(is_scanned: Column, is_digital: Column, legacy_font_pages: Column) -> Column:
    return F.when(is_scanned, "ocr_full").when(legacy_font_pages > 0, "direct_legacy_conversion").when(is_digital, "direct_unicode").otherwise("hybrid")


def processing_order(pages: DataFrame) -> DataFrame:
    """pages with place: the most complex first, by tables, columns and noise; equals by page."""
    points = F.when(F.col("has_tables"), 10).otherwise(0) + F.when(F.col("columns") > 1, 5).otherwise(0) + F.when(F.col("page_type") == "scanned_noisy", 8).otherwise(0)
    return pages.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(points), "page")))


def glyph(font: Column, cmap: Column, named: Column, embedded: Column) -> Column:
    """struct(text, confidence, source) of a glyph: by the font's code table, its glyph names, the file's own mapping, a legacy map, else what there is."""
    real = lambda c: c.isNotNull() & (c != "") & (c != "�")
    said = lambda text, sure, source: F.struct(text.alias("text"), F.lit(sure).alias("confidence"), F.lit(source).alias("source"))
    made = force_converted(embedded, map_name(font))
    return (
        F.when(real(cmap), said(cmap, 95.0, "font_cmap"))
        .when(real(named), said(named, 90.0, "font_glyph_name"))
        .when(real(embedded) & embedded.rlike(f"[{DEVANAGARI}]"), said(embedded, 80.0, "pdf_tounicode_devanagari"))
        .when(real(embedded) & is_legacy_font(font), said(embedded, 40.0, "pdf_tounicode_legacy_suspect"))
        .when(real(embedded), said(embedded, 75.0, "pdf_tounicode"))
        .when(is_legacy_font(font) & (embedded != "") & (made != embedded), said(made, 60.0, "legacy_converter"))
        .when(embedded != "", said(embedded, 30.0, "fallback"))
        .otherwise(said(F.lit("�"), 0.0, "unknown"))
    )


def font_confidence(has_cmap: Column, n_glyphs: Column, n_codes: Column, has_outlines: Column, n_devanagari: Column) -> Column:
    """0 to 100: how far a font's own tables can be trusted."""
    points = F.when(has_cmap, 40.0).otherwise(0.0) + F.least(F.lit(30.0), n_glyphs * 0.5) + F.least(F.lit(20.0), n_codes * 0.3) + F.when(has_outlines, 10.0).otherwise(0.0)
    return F.least(F.lit(100.0), points + F.when(n_devanagari > 10, 15.0).when(n_devanagari > 0, 5.0).otherwise(0.0))


def children(edges: DataFrame, relation: str = "parent_child") -> DataFrame:
    """source, children of edges (source, target, relation)."""
    return edges.where(F.col("relation") == relation).groupBy("source").agg(F.array_sort(F.collect_list("target")).alias("children"))


def captions_of(edges: DataFrame) -> DataFrame:
    """target, caption: the first caption of each figure. edges: (place, source, target, relation)."""
    return edges.where("relation = 'caption_of'").groupBy("target").agg(F.min_by("source", "place").alias("caption"))


def words_of(texts: DataFrame, key: str = "id", column: str = "text") -> DataFrame:
    """key, word: the Devanagari words of texts."""
    return texts.select(key, F.explode(F.regexp_extract_all(column, F.lit(f"[{DEVANAGARI}]+"), F.lit(0))).alias("word"))


def checked_words(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """word, repaired, confidence, reason of the distinct words: known, regular, corrected by the vocabulary, repaired, or neither."""
    w = F.col("word")
    base = known(words.select("word").distinct(), vocab).withColumn("fixed", dv.repaired(w)).withColumn("wrong", dv.n_sequence_errors(w) > 0)
    best = corrected_words(base.where("domain is null and wrong").select("word"), vocab).select(F.col("word").alias("_w"), "corrected", F.col("confidence").alias("sure"), "source")
    fixed_known = vocab.select(F.col("word").alias("_v"), F.lit(True).alias("is_known"))
    both = base.join(best, w == F.col("_w"), "left").join(fixed_known, F.col("fixed") == F.col("_v"), "left")
    by_vocabulary = (F.col("corrected") != w) & (F.col("sure") >= 65)
    said = lambda text, sure, reason: F.struct(text.alias("repaired"), sure.cast("double").alias("confidence"), reason.alias("reason"))
    out = (
        F.when(~w.rlike(f"[{DEVANAGARI}]") | F.col("domain").isNotNull(), said(w, F.lit(100), F.lit("")))
        .when(~F.col("wrong"), said(w, F.lit(95), F.lit("")))
        .when(by_vocabulary, said(F.col("corrected"), F.col("sure"), F.concat(F.lit("kb_"), "source")))
        .when(F.col("is_known"), said(F.col("fixed"), F.lit(90), F.lit("repaired_to_known_word")))
        .when(F.col("fixed") != w, said(F.col("fixed"), F.lit(70), F.lit("sequence_repaired")))
        .otherwise(said(w, F.lit(60), F.lit("unvalidated")))
    )
    return both.withColumn("o", out).select("word", "o.*")


def block_quality(texts: DataFrame, vocab: DataFrame, key: str = "id") -> DataFrame:
    """key, n_words, confidence, n_known, n_repaired for every text: its words' mean confidence, 100 without words, 0 without text."""
    words = words_of(texts, key)
    checked = words.join(checked_words(words, vocab), "word")
    named = checked.join(vocab.select(F.col("word").alias("_v")), F.col("repaired") == F.col("_v"), "left")
    sums = named.groupBy(key).agg(F.count("*").alias("n_words"), F.avg("confidence").alias("mean"), F.count("_v").alias("n_known"), F.count_if(F.col("reason") != "").alias("n_repaired"))
    sure = F.when(F.coalesce(F.col("text"), F.lit("")) == "", 0.0).otherwise(F.coalesce("mean", F.lit(100.0)))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return texts.select(key, "text").join(sums, key, "left").select(key, zero("n_words"), sure.alias("confidence"), zero("n_known"), zero("n_repaired"))


def confidence_levels(texts: DataFrame, vocab: DataFrame, key: str = "id", most: int = 20) -> DataFrame:
    """key, character, word, line, paragraph, page, uncertain: confidence at five levels, and the first words that nothing known is near; the report names that many."""
    t = F.col("text")
    # Marks that count as certain.
    marks = "à¥¤,.;:!?()\\-"
    wrong = dv.n_sequence_errors(t) - F.regexp_count(t, F.lit(f"(?<![{DEVANAGARI}])[{dv.MATRA}{dv.HALANT}]"))
    deva, latin, sure = n_of(t, DEVANAGARI), n_of(t, "A-Za-z"), F.length(F.regexp_replace(t, rf"(?U)[^{SPACE}{marks}]+", ""))
    rest = F.length(t) - deva - latin - sure
    character = (90.0 * (deva - wrong) + 40.0 * wrong + 85.0 * latin + 95.0 * sure + 70.0 * rest) / F.greatest(F.length(t), F.lit(1))
    lines = F.filter(F.split(t, "\n"), lambda x: ~is_blank(x))
    line_ratio = lambda x: share(n_of(x, DEVANAGARI), n_visible(x))
    good = F.size(F.filter(lines, lambda x: (line_ratio(x) > 0.7) | (line_ratio(x) < 0.1)))
    line = F.when(F.size(lines) > 0, (85.0 * good + 60.0 * (F.size(lines) - good)) / F.size(lines)).otherwise(70.0)
    has_paragraph = F.exists(F.split(t, "\n\n"), lambda x: F.length(stripped(x)) >= 10)
    words = words_of(texts, key)
    flags = known(words, vocab)
    per = flags.groupBy(key).agg((F.count("domain") / F.count("*") * 100).alias("word_share"))
    placed = texts.select(key, F.posexplode(F.regexp_extract_all("text", F.lit(f"[{DEVANAGARI}]+"), F.lit(0))).alias("place", "word")).where(F.length("word") >= 3)
    odd = known(placed, vocab).where("domain is null").drop("domain")
    near = closest_words(odd.select("word"), vocab, top=1).select("word")
    lost = odd.join(near, "word", "left_anti").groupBy(key).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), 1, most).alias("uncertain"))
    base = texts.select(key, "text", character.alias("character"), line.alias("line"), F.when(has_paragraph, line).otherwise(70.0).alias("paragraph")).join(per, key, "left").join(lost, key, "left")
    blank, word = is_blank(t), F.coalesce("word_share", F.lit(80.0))
    page = F.col("character") * 0.2 + word * 0.35 + F.col("line") * 0.25 + F.col("paragraph") * 0.2
    out = {"character": F.col("character"), "word": word, "line": F.col("line"), "paragraph": F.col("paragraph"), "page": page}
    return base.select(key, *(F.when(blank, 0.0).otherwise(v).alias(k) for k, v in out.items()), F.when(~blank, F.coalesce("uncertain", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("uncertain"))


def confidence_report(elements: DataFrame, most: int = 20) -> DataFrame:
    """doc_id, n, overall, least, greatest, n_low, low of elements (doc_id, element_id, confidence); the report names that many low ones."""
    low = F.col("confidence") < 60
    return elements.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("overall"), F.min("confidence").alias("least"), F.max("confidence").alias("greatest"), F.count_if(low).alias("n_low"), F.slice(F.array_sort(F.collect_list(F.when(low, F.col("element_id")))), 1, most).alias("low"))


def block_metrics(spans: DataFrame) -> DataFrame:
    """doc_id, page, block, n_chars, n_lines, max_size, is_bold, font, first_line, list_share, nep, eng of spans (doc_id, page, block, line, span, font, size, bold, text)."""
    keys = ["doc_id", "page", "block"]
    line_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), "")
    lines = spans.groupBy(*keys, "line").agg(line_text.alias("t"))
    item = F.col("t").rlike(r"(?U)\A\s*(?:[क-ह][.)]\s|\([क-ह]\)\s|[०-९]+[.)]\s|\d+[.)]\s|[a-zA-Z][.)]\s|\([a-zA-Z]\)\s|\(\d+\)\s|[ivxIVX]+[.)]\s|[-•●○▪▸►]\s)")
    by_line = lines.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.min_by("t", "line").alias("first_line"), (F.count_if(item) / F.count("*")).alias("list_share"))
    fonts = spans.groupBy(*keys, "font").agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("line", "span")).alias("first"))
    top = fonts.groupBy(*keys).agg(F.min_by("font", F.struct((-F.col("n")).alias("less"), "first")).alias("font"))
    sums = spans.groupBy(*keys).agg(F.sum(n_visible(F.col("text"))).alias("n_chars"), F.max("size").alias("max_size"), F.bool_or("bold").alias("is_bold"), F.sum(n_of(F.col("text"), DEVANAGARI)).alias("nep"), F.sum(n_of(F.col("text"), "A-Za-z")).alias("eng"))
    return sums.join(by_line, keys).join(top, keys)


def heading_level(size: Column, bold: Column, body: Column, sizes: Column) -> Column:
    """0 to 3: by the first, middle and last of the sizes over the body's; bold text of the body's size is of level 3 where there are any."""
    k = F.size(sizes)
    second, third = F.when(k == 2, F.get(sizes, 1)).when(k > 2, F.get(sizes, F.floor(k / 2).cast("int"))), F.when(k > 2, F.get(sizes, k - 1))
    hit = lambda bound: F.coalesce(size >= bound - 0.25, F.lit(False))
    return F.when((k == 0) | (size <= 0), 0).when(hit(F.get(sizes, 0)), 1).when(hit(second), 2).when(hit(third), 3).when(bold & (size >= body - 0.5), 3).otherwise(0)


def structured_text(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, page, text: blocks from the top, headings marked. blocks: (doc_id, page, x0, y0, size, bold, text); sizes: (doc_id, body_size, sizes)."""
    level = heading_level(F.col("size"), F.col("bold"), F.col("body_size"), F.col("sizes"))
    t = stripped(F.col("text"))
    line = F.when(level > 0, F.concat(F.lit("\n"), F.repeat(F.lit("#"), level), F.lit(" "), t)).otherwise(t)
    rows = blocks.join(sizes, "doc_id").where(~is_blank(F.col("text"))).select("doc_id", "page", F.struct("y0", "x0", line.alias("line")).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n")
    return rows.groupBy("doc_id", "page").agg(F.regexp_replace(joined, "\n{3,}", "\n\n").alias("text"))


def without_running(lines: DataFrame, running: DataFrame) -> DataFrame:
    """lines (doc_id, page, zone, line) that aren't running ones."""
    return lines.join(running.select("doc_id", "zone", "line").distinct(), ["doc_id", "zone", "line"], "left_anti")


def sentence_meaning(c: Column, repaired: Column) -> Column:
    """struct(summary, n_clauses, legal, questions, corruption) of a text and its repaired form."""
    parts = dv.clauses(repaired)
    n = lambda f: F.size(F.filter(parts, f))
    first_legal = F.coalesce(dv.clause_domain(F.get(parts, 0)) == "legal", F.lit(False))
    notes = F.array_compact(F.array(F.when(first_legal, "Legal/regulatory Nepali document"), F.when(repaired != c, "OCR corruption repaired")))
    summary = F.when(F.size(notes) > 0, F.array_join(notes, " · ")).otherwise(F.substring(repaired, 1, 120))
    return F.struct(summary.alias("summary"), F.size(parts).alias("n_clauses"), n(lambda x: dv.clause_domain(x) == "legal").alias("legal"), n(dv.is_question).alias("questions"), corruption_score(c).alias("corruption"))


def sentence_context(c: Column, repaired: Column, most: int = 1200) -> Column:
    """A short report on a text's sense, cut at most characters; empty for a text without clauses and damage."""
    m, parts = sentence_meaning(c, repaired), F.slice(dv.clauses(repaired), 1, 5)
    lines = F.transform(parts, lambda x: F.concat(F.lit("  • ["), dv.clause_domain(x), F.lit("] "), F.substring(x, 1, 100)))
    head = F.array(F.lit("NEPALI SENTENCE INTELLIGENCE (use for meaning, not literal glyph match):"), F.concat(F.lit("Document sense: "), m["summary"]))
    fixed = F.when(repaired != c, F.array(F.concat(F.lit("Rule-based OCR repair preview: "), F.substring(repaired, 1, 300)))).otherwise(F.array().cast("array<string>"))
    out = F.array_join(F.concat(head, fixed, lines), "\n")
    return F.when((F.size(parts) == 0) & (m["corruption"] == 0), "").when(F.length(out) <= most, out).otherwise(F.concat(F.substring(out, 1, most - 3), F.lit("...")))


def amount_issues(amounts: DataFrame) -> DataFrame:
    """doc_id, issue, label of labelled amounts (doc_id, label, value): VAT that isn't 13 % (within a twentieth), parts over the total by more than a hundredth."""
    low = F.lower("label")
    of = lambda name, k: F.max(F.when(low == name, F.col("value"))).over(Window.partitionBy("doc_id")).alias(k)
    each = amounts.select("doc_id", "label", "value", of("भ्याट", "vat"), of("करयोग्य", "taxable"), of("जम्मा", "total"))
    vat = each.where((low == "भ्याट") & (F.abs(F.col("vat") - F.col("taxable") * 0.13) > F.col("taxable") * 0.13 * 0.05)).select("doc_id", F.lit("vat").alias("issue"), "label").distinct()
    parts = each.where((low != "जम्मा") & (F.col("value") > F.col("total") * 1.01)).select("doc_id", F.lit("component").alias("issue"), "label")
    return vat.union(parts)


def date_issues(c: Column) -> Column:
    """year, month and day for each date in a text whose year isn't from 2000 to 2120, or whose month or day can't be."""
    p = F.lit(r"(\d{4})[./\-](\d{1,2})[./\-](\d{1,2})")
    dates = F.arrays_zip(*(F.regexp_extract_all(c, p, F.lit(i)).alias(k) for i, k in ((1, "y"), (2, "m"), (3, "d"))))
    bad = lambda k, lo, hi, name: F.transform(F.filter(dates, lambda x: ~x[k].cast("int").between(lo, hi)), lambda x: F.lit(name))
    return F.concat(bad("y", 2000, 2120, "year"), bad("m", 1, 12, "month"), bad("d", 1, 32, "day"))


def page_text(blocks: DataFrame) -> DataFrame:
    """doc_id, page, text, confidence: blocks' texts in reading order, and the mean of confidences over 0."""
    text = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda x: ~is_blank(x["text"])), lambda x: x["text"]), "\n\n")
    return blocks.groupBy("doc_id", "page").agg(text.alias("text"), F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("confidence"))
