"""What is decided about page images: sizes, qualities, scales, and which of several readings of a page stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEVANAGARI, n_of, share

# Scales at which pages are drawn, by a machine's tier, for up to 30, 100, 200 and more pages.
SCALES = {"high": (6.0, 5.5, 5.0, 4.5), "balanced": (5.5, 5.0, 4.5, 4.0), "safe": (5.0, 4.5, 4.0, 3.5)}
# Confidence and share of Devanagari from which a tier keeps a first reading.
FIRST_READING = {"high": (85.0, 0.3), "balanced": (82.0, 0.25), "safe": (80.0, 0.2)}


def machine_tier(cores: Column, gigabytes: Column) -> Column:
    """high, balanced or safe; memory that isn't known (null) is enough."""
    has = lambda n: (cores >= n) & F.coalesce(gigabytes >= n, F.lit(True))
    return F.when(has(8), "high").when(has(4), "balanced").otherwise("safe")


def drawing_scale(pages: Column, tier: Column) -> Column:
    """The scale of a document's pages; null for an unknown tier."""
    found = F.lit(None).cast("double")
    for name, (small, medium, large, xlarge) in SCALES.items():
        found = F.when(tier == name, F.when(pages > 200, xlarge).when(pages > 100, large).when(pages > 30, medium).otherwise(small)).otherwise(found)
    return found


def kept_quality(sizes: Column, most: int = 900_000, start: int = 88, least: int = 82) -> Column:
    """The highest quality, from start downwards by 2 but not under least, whose file has at most `most` bytes, else the lowest tried.

    sizes: array of struct(quality, bytes) of a page's files; null if none was tried.
    """
    tried = F.sort_array(F.filter(sizes, lambda s: s["quality"].between(least, start) & ((F.lit(start) - s["quality"]) % 2 == 0)), asc=False)
    fits = F.filter(tried, lambda s: s["bytes"] <= most)
    return F.coalesce(F.get(fits, 0)["quality"], F.get(tried, F.size(tried) - 1)["quality"])


def best_reading(readings: DataFrame, least: float = 85.0, least_share: float = 0.3) -> DataFrame:
    """doc_id, page, variant, text, confidence, first: which reading of a page stays.

    readings: (doc_id, page, place, variant, text, confidence), place 0 for the
    plain one. That one stays if it is sure and Devanagari enough; else the one
    worth most, the earlier of equals, of those up to the first later one that
    can't be doubted. A page has a handful of readings.
    """
    deva = n_of(F.col("text"), DEVANAGARI)
    worth = F.col("confidence") * 0.3 + deva * 2 + F.length("text") * 0.1
    enough = (F.col("place") == 0) & (F.col("confidence") >= least) & ((share(deva, F.length("text")) >= least_share) | (deva > 20))
    great = (F.col("place") > 0) & (F.col("confidence") >= 90) & (deva > 30)
    last = F.min(F.when(enough, 0).when(great, F.col("place")))
    each = F.collect_list(F.struct((-worth).alias("less"), "place", "variant", "text", "confidence"))
    pages = readings.groupBy("doc_id", "page").agg(last.alias("last"), F.array_sort(each).alias("each"), F.max(F.coalesce(enough, F.lit(False))).alias("first"))
    kept = F.get(F.filter("each", lambda r: F.coalesce(r["place"] <= F.col("last"), F.lit(True))), 0)
    return pages.withColumn("r", kept).select("doc_id", "page", "r.variant", "r.text", "r.confidence", "first")


def image_pages(images: DataFrame) -> DataFrame:
    """The one page of each image file: all of it is one image, its ink a scanned region above 1 % and perhaps handwriting above 5 %.

    images: (doc_id, width, height, ink, skew), ink in per cent.
    """
    return images.select(
        "doc_id", F.lit(1).alias("page"), "skew", F.lit("scanned_image").alias("kind"), F.lit(80.0).alias("confidence"), F.lit(1).alias("columns"), F.lit("ltr").alias("direction"),
        (F.col("ink") > 1).cast("int").alias("n_scanned"), F.when(F.col("ink") > 1, F.col("ink")).alias("scanned_percent"), (F.col("ink") > 5).cast("int").alias("n_handwritten"),
    )


def image_blocks(images: DataFrame) -> DataFrame:
    """The one block of each image file."""
    return images.select("doc_id", F.lit(1).alias("page"), F.lit("p001_b001").alias("name"), F.lit("image").alias("kind"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").cast("double").alias("x1"), F.col("height").cast("double").alias("y1"), F.lit(90.0).alias("confidence"))
