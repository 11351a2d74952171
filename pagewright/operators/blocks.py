"""Blocks on pages: overlaps, captions, zones, and what a page's blocks say of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

# Which class of block prevails where blocks overlap.
PRIORITY = {"table": 100, "qr_code": 95, "barcode": 94, "signature": 90, "stamp": 88, "formula": 85, "chart": 80, "figure": 78, "image": 75, "handwriting": 74, "header": 72, "footer": 70, "heading": 65, "list": 60, "caption": 58, "margin_note": 56, "paragraph": 50}


def priority(kind: Column) -> Column:
    found = F.lit(0)
    for k, v in PRIORITY.items():
        found = F.when(kind == k, v).otherwise(found)
    return found


def overlapping(left: DataFrame, right: DataFrame, least: float, how: str = "left_semi") -> DataFrame:
    """left's blocks that some block of right on the same page covers by more than least of their area, or with left_anti those that none does."""
    r = right.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), g.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("_b"))
    own = g.box(left["x0"], left["y0"], left["x1"], left["y1"])
    return left.join(r, (left["doc_id"] == F.col("_d")) & (left["page"] == F.col("_p")) & (g.overlap_ratio(own, F.col("_b")) > least), how)


def prevailing(blocks: DataFrame) -> DataFrame:
    """Blocks that no block of higher priority, or of equal priority and more confidence, has pushed out.

    Whether a block stays depends on those that stayed before it, so each
    page's blocks are folded in order of priority and confidence.
    """
    b = F.struct((-priority(F.col("kind"))).alias("less"), (-F.col("confidence")).cast("double").alias("less_sure"), F.col("block_id").alias("block_id"), g.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("box"))
    pages = blocks.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(b)).alias("bs"))

    def step(kept, x):
        clash = F.exists(kept, lambda k: (g.iou(x["box"], k["box"]) > 0.55) | ((g.overlap_ratio(x["box"], k["box"]) > 0.65) & (k["less"] <= x["less"])))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    start = F.filter(F.col("bs"), lambda x: F.lit(False))
    kept = pages.select("doc_id", "page", F.explode(F.transform(F.aggregate("bs", start, step), lambda x: x["block_id"])).alias("block_id"))
    return blocks.join(kept, ["doc_id", "page", "block_id"], "left_semi")


def block_ids(blocks: DataFrame) -> DataFrame:
    """blocks with name pNNN_bNNN, in order from the top."""
    k = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "block_id"))
    return blocks.withColumn("name", F.format_string("p%03d_b%03d", F.col("page").cast("int"), k))


def captions(texts: DataFrame, figures: DataFrame) -> DataFrame:
    """Text blocks that begin like a caption and stand from 5 above to 80 under a figure's lower edge, with 30 % of a common width."""
    start = r"(?iU)\A(?:Figure|Fig\.?|Table|Chart|Graph|Diagram|Photo|Image|छवि|तालिका|चित्र|सारणी)\s*[०-९\d]"
    f = figures.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), g.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("_b"))
    t = texts.where(F.col("text").rlike(start) & (F.length("text") <= 300))
    near = (F.col("y0") >= F.col("_b.y1") - 5) & (F.col("y0") < F.col("_b.y1") + 80) & (g.x_overlap(g.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), F.col("_b")) > 0.3)
    return t.join(f, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & near, "left_semi")


def body_size(elements: DataFrame, weighted: bool = True) -> DataFrame:
    """doc_id, page, body_size: the commonest size, in halves and by characters, or in tenths and by elements; the first seen wins ties."""
    size = F.bround(F.col("size") * 2) / 2 if weighted else F.bround("size", 1)
    weight = F.length("text") if weighted else F.lit(1)
    each = elements.where("size > 0").groupBy("doc_id", "page", size.alias("s")).agg(F.sum(weight).alias("n"), F.min("place").alias("first"))
    return each.groupBy("doc_id", "page").agg(F.max_by("s", F.struct("n", (-F.col("first")).alias("less"))).alias("body_size"))


def heading_sizes(elements: DataFrame, step: float = 1.5) -> DataFrame:
    """doc_id, body_size, sizes: distinct sizes over the body's by more than step, largest first; their first, middle and last stand for levels 1 to 3."""
    counts = elements.where("size > 0").groupBy("doc_id", (F.bround(F.col("size") * 2) / 2).alias("s")).agg(F.count("*").alias("n"))
    body = counts.groupBy("doc_id").agg(F.max_by("s", F.struct("n", (-F.col("s")).alias("less"))).alias("body_size"), F.collect_set("s").alias("all"))
    return body.select("doc_id", "body_size", F.sort_array(F.filter("all", lambda s: s > F.col("body_size") + step), asc=False).alias("sizes"))


def column_count(blocks: DataFrame, width: float) -> DataFrame:
    """doc_id, page, columns: 1, 2 or 3 by wide gaps between the centres of blocks that aren't narrow; 1 with fewer than three of them."""
    c, wide = (F.col("x0") + F.col("x1")) / 2, F.col("x1") - F.col("x0") > width * 0.05
    gap = c - F.lag(c).over(Window.partitionBy("doc_id", "page", wide).orderBy(c))
    counted = blocks.withColumn("gap", F.when(wide, gap)).groupBy("doc_id", "page").agg(F.count_if(F.col("gap") > width * 0.18).alias("n"), F.count_if(wide).alias("k"))
    return counted.select("doc_id", "page", F.when(F.col("k") < 3, 1).otherwise(F.least(F.col("n") + 1, F.lit(3))).alias("columns"))


def margins(blocks: DataFrame) -> DataFrame:
    """doc_id, page, left, top, right, bottom: the ends of what a page shows."""
    return blocks.groupBy("doc_id", "page").agg(F.min("x0").alias("left"), F.min("y0").alias("top"), F.max("x1").alias("right"), F.max("y1").alias("bottom"))


def page_class(coverage: Column, ink: Column, skew: Column, has_unicode: Column, has_legacy: Column, n_scanned: Column, n_tables: Column) -> Column:
    """struct(kind, confidence) of a page by per cent of text and ink, skew, fonts, scanned regions and tables."""
    said = lambda kind, sure: F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))
    scanned = (coverage < 3) & (ink > 3)
    return (
        F.when((coverage < 1) & (ink < 1), said("blank", 90.0))
        .when(scanned & (F.abs(skew) > 2), said("scanned_rotated", 80.0))
        .when(scanned & (ink > 15), said("scanned_noisy", 75.0))
        .when(scanned, said("scanned", 85.0))
        .when(has_legacy & (coverage >= 3), said("digital_legacy", 88.0))
        .when(has_unicode & (coverage >= 5), said("digital_unicode", 92.0))
        .when((coverage >= 3) & (n_scanned > 0), said("mixed", 70.0))
        .when((n_tables >= 2) & (coverage < 20), said("table_heavy", 78.0))
        .when(coverage >= 3, said("digital", 75.0))
        .otherwise(said("mixed", 55.0))
    )


def document_class(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, pages of each sort, whether digital, scanned or mixed, languages by size, mean confidence. pages: (doc_id, page, coverage, n_scanned, kind, confidence, has_legacy, n_tables, n_images, nep, eng, numeric)."""
    digital, scan = F.col("coverage") >= 5, (F.col("coverage") < 5) & ((F.col("n_scanned") > 0) | F.col("kind").isin("scanned", "scanned_noisy", "image_only"))
    d = pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.count_if(digital).alias("digital_pages"), F.count_if(scan).alias("scanned_pages"), F.count_if("has_legacy").alias("legacy_font_pages"), F.count_if(F.col("n_tables") > 0).alias("pages_with_tables"),
        F.count_if(F.col("n_images") > 0).alias("pages_with_images"), F.avg("confidence").alias("confidence"), *(F.sum(k).alias(k) for k in ("nep", "eng", "numeric")),
    )
    is_digital = F.col("digital_pages") / F.col("n_pages") >= 0.8
    is_scanned = (F.col("scanned_pages") / F.col("n_pages") >= 0.8) & (F.col("digital_pages") / F.col("n_pages") < 0.2)
    ranked = F.array_sort(F.filter(F.array(*(F.struct((-F.col(k)).alias("less"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, k in enumerate(("nep", "eng", "numeric")))), lambda x: x["less"] < 0))
    names = F.transform(ranked, lambda x: x["name"])
    return d.select("doc_id", "n_pages", "digital_pages", "scanned_pages", (F.col("n_pages") - F.col("digital_pages") - F.col("scanned_pages")).alias("mixed_pages"), "legacy_font_pages", "pages_with_tables", "pages_with_images", is_digital.alias("is_digital"), is_scanned.alias("is_scanned"), (~is_digital & ~is_scanned).alias("is_mixed"), names.alias("languages"), F.get(names, 0).alias("dominant_language"), "confidence")


def signatures(images: DataFrame, width: float, height: float) -> DataFrame:
    """Images in the lower 35 % of a page that are wider than high and of a signature's size."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return images.where((F.col("y0") >= height * 0.65) & (w > h) & w.between(width * 0.08, width * 0.5) & (h <= height * 0.12))


def stamps(images: DataFrame, width: float, height: float) -> DataFrame:
    """Nearly square images of a stamp's size in a page's corners."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    corner = ((cx < width * 0.35) | (cx > width * 0.65)) & ((cy < height * 0.35) | (cy > height * 0.65))
    return images.where(corner & (w / h).between(0.7, 1.4) & w.between(width * 0.06, width * 0.3))


def charts(images: DataFrame, vectors: DataFrame, tables: DataFrame, covered: float = 0.3) -> DataFrame:
    """Images that are neither small nor long, and vector drawings of eight strokes or more, that no table covers; with confidence."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ratio = w / F.greatest(h, F.lit(1.0))
    drawn = images.where((w * h >= 2000) & (ratio > 0.4) & (ratio < 2.5)).withColumn("confidence", F.lit(55.0))
    stroked = vectors.where((F.col("strokes") >= 8) & (w > 80) & (h > 60)).withColumn("confidence", F.lit(50.0))
    return overlapping(drawn, tables, covered, "left_anti").unionByName(overlapping(stroked, tables, covered, "left_anti"), allowMissingColumns=True)


def handwriting(vectors: DataFrame, texts: DataFrame, left: float, right: float) -> DataFrame:
    """Vector drawings of four strokes or more in the side margins that no text covers by a fifth."""
    drawn = vectors.where((F.col("strokes") >= 4) & ((F.col("x1") <= left) | (F.col("x0") >= right)))
    return overlapping(drawn, texts, 0.2, "left_anti")
