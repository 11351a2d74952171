"""From spans to documents: the compositions that a service would call."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classes, legacy, quality, semantics
from ..functions import devanagari as dv
from ..functions.fidelity import Fidelity
from ..functions.text import corruption_score, devanagari_ratio, is_blank, nfc, stripped, tidy
from ..operators import crosspage, documents, fonts, layout, vocabulary
from ..operators.repair import repaired_corruption


def converted_spans(spans: DataFrame) -> DataFrame:
    """spans with raw_text, text converted where it has to be, and converted. spans: (doc_id, page, block, line, span, font, text, x0, x1)."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "block", "line", "span"))
    table = fonts.font_table(spans.select("doc_id", order.alias("place"), "font", "text"))
    known = fonts.resolved(spans, table)
    name = fonts.parsed_name(F.col("font"))
    family = F.col("family")
    encoding = F.when(family == "unicode", "unicode").when(F.col("is_legacy"), "legacy").otherwise("unknown")
    goes = fonts.should_convert(F.col("text"), F.col("font"), family, F.col("is_legacy"), name["is_cid"], encoding)
    guess = legacy.guessed_font(F.col("text"))
    own = F.when(legacy.is_legacy_font(F.col("font")), legacy.map_name(F.col("font"))).when((guess["confidence"] >= 55) & ~guess["family"].isin("unicode", "unknown"), guess["family"])
    m = F.coalesce(F.col("conversion_map"), own)
    made = F.when(m.isNotNull(), legacy.force_converted(F.col("text"), m)).otherwise(F.col("text"))
    out = known.withColumn("_goes", goes).withColumn("_made", made).withColumn("raw_text", F.col("text"))
    text = F.when(fonts.is_decorative(F.col("font")), "").when(F.col("_goes"), quality.accepted_conversion(F.col("text"), F.col("_made"))).otherwise(F.col("text"))
    return out.select(*(c for c in spans.columns if c != "text"), "raw_text", text.alias("text"), F.col("_goes").alias("converted"))


def page_texts(spans: DataFrame, mode: str | None = None) -> DataFrame:
    """doc_id, page, text, method, confidence, char_count, devanagari_ratio, fonts, legacy_fonts, converted_ratio."""
    fidelity = Fidelity.of(mode)
    done = converted_spans(spans)
    lines = layout.joined_spans(done.where("raw_text <> ''"))
    in_order = lambda *k: F.array_sort(F.collect_list(F.struct(*k, "text")))
    joined = lambda rows, by: F.array_join(F.transform(rows, lambda x: x["text"]), by)
    blocks = lines.groupBy("doc_id", "page", "block").agg(joined(in_order("line"), "\n").alias("text"))
    raw = blocks.groupBy("doc_id", "page").agg(joined(in_order("block"), "\n\n").alias("text"))
    composed = nfc(F.col("text"))
    cleaned = raw.select("doc_id", "page", F.col("text").alias("raw"), composed.alias("t"))
    cleaned = cleaned.select("doc_id", "page", "raw", tidy(dv.repaired(F.col("t")) if fidelity.matra_repair else F.col("t")).alias("text"))
    used = F.array_sort(F.collect_set("font"))
    facts = done.where("raw_text <> ''").groupBy("doc_id", "page").agg(used.alias("fonts"), F.array_sort(F.collect_set(F.when(F.col("converted"), F.col("font")))).alias("legacy_fonts"), (F.sum(F.when(F.col("converted"), F.length("raw_text")).otherwise(0)) / F.sum(F.length("raw_text"))).alias("converted_ratio"))
    both = cleaned.join(facts, ["doc_id", "page"])
    conversion = quality.conversion_label(F.col("raw"), F.col("text"), F.coalesce(F.get("legacy_fonts", 0), F.lit("")))
    method = F.when(is_blank(F.col("text")), "no_text").when(F.size("legacy_fonts") > 0, "direct_legacy").otherwise("direct_unicode")
    return both.select("doc_id", "page", "text", method.alias("method"), quality.page_confidence(F.col("text"), conversion).alias("confidence"), F.length(stripped(F.col("text"))).alias("char_count"), devanagari_ratio(F.col("text")).alias("devanagari_ratio"), "fonts", "legacy_fonts", "converted_ratio")


def extract(spans: DataFrame, mode: str | None = None, domain: str = "general") -> DataFrame:
    """doc_id, text, n_pages, mean_confidence, is_valid, adjustment, n_issues: a document's pages joined, corrected across pages in assisted mode, and checked.

    Checks change only the confidence. Documents without spans don't appear.
    """
    fidelity = Fidelity.of(mode)
    pages = page_texts(spans, mode)
    if fidelity.cross_page:
        words = pages.select("doc_id", "page", F.explode(F.regexp_extract_all("text", F.lit("[ऀ-ॿ]+"), F.lit(0))).alias("word"))
        long = pages.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 2").select("doc_id")
        misses = crosspage.near_misses(words.join(long, "doc_id", "left_semi"))
        pages = pages.drop("text").join(crosspage.with_corrections(pages.select("doc_id", "page", "text"), misses), ["doc_id", "page"])
    docs = documents.joined_pages(pages.select("doc_id", "page", "text", "confidence"))
    checked = docs.withColumn("issues", semantics.all_issues(F.col("text"), F.lit(domain)))
    v = semantics.verdict(F.col("issues"))
    return checked.select("doc_id", "text", "n_pages", F.greatest(F.lit(0.0), F.col("mean_confidence") + v["adjustment"]).alias("mean_confidence"), v["is_valid"].alias("is_valid"), v["adjustment"].alias("adjustment"), F.size("issues").alias("n_issues"))


def smart_text(spans: DataFrame, least_corruption: float = 0.0) -> DataFrame:
    """doc_id, text, score, label: text layers only, with damaged words repaired by the vocabulary where glyphs are lost."""
    docs = documents.joined_pages(page_texts(spans).select("doc_id", "page", "text", "confidence")).select("doc_id", "text")
    damaged = corruption_score(F.col("text")) > least_corruption
    vocab = vocabulary.vocabulary(spans.sparkSession)
    fixed = repaired_corruption(docs.where(damaged), vocab, ["doc_id"]).unionByName(docs.where(~damaged))
    return fixed.select("doc_id", "text", quality.score(F.col("text")).alias("score"), quality.label(F.col("text")).alias("label"))


def classified(docs: DataFrame) -> DataFrame:
    """doc_id, primary, secondary, confidence, kind of documents (doc_id, text)."""
    c = classes.document_class(F.col("text"))
    return docs.select("doc_id", c.alias("c"), dv.document_kind(F.col("text")).alias("kind")).select("doc_id", "c.*", "kind")


def either(direct: DataFrame, recognised: DataFrame, least_chars: int = 5) -> DataFrame:
    """doc_id, page, text, method, confidence: the text layer where it has enough characters, else what was recognised."""
    d = direct.select("doc_id", "page", F.col("text").alias("d_text"), F.col("method").alias("d_method"), F.col("confidence").alias("d_conf"), "char_count")
    both = d.join(recognised.select("doc_id", "page", F.col("text").alias("r_text"), F.col("confidence").alias("r_conf")), ["doc_id", "page"], "full")
    has = F.coalesce((F.col("d_method") != "no_text") & (F.col("char_count") >= least_chars), F.lit(False))
    return both.select("doc_id", "page", F.when(has, F.col("d_text")).otherwise(F.coalesce("r_text", "d_text")).alias("text"), F.when(has, F.col("d_method")).when(F.col("r_text").isNotNull(), "ocr").otherwise("no_text").alias("method"), F.when(has, F.col("d_conf")).otherwise(F.coalesce("r_conf", F.lit(0.0))).alias("confidence"))
