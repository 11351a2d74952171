"""Repair of text with lost glyphs: only words that hold one may change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.devanagari import in_context, without_lost_glyphs
from ..functions.text import CORRUPTION, DEVANAGARI, SPACE, nfkc, stripped
from .vocabulary import corrected_words

PIECES = rf"(?U)[{SPACE}]+|[।.،,;:!?]+|[^{SPACE}।.،,;:!?]+"


def repaired_corruption(rows: DataFrame, vocab: DataFrame, keys: list[str], domain: str | None = None, least: float = 65.0) -> DataFrame:
    """keys, text: damaged phrases restored, and each damaged word replaced by the vocabulary's if it is sure enough, else without its lost glyphs.

    rows: (keys, text); a null text stays null. Texts without lost glyphs come
    back in their compatibility form with single spaces.
    """
    clean = rows.select(*keys, in_context(nfkc(stripped(F.col("text")))).alias("t"))
    pieces = clean.select(*keys, F.posexplode(F.regexp_extract_all("t", F.lit(PIECES), F.lit(0))).alias("place", "piece"))
    bare = without_lost_glyphs(F.col("piece"))
    marked = pieces.select("*", bare.alias("bare"), F.col("piece").rlike(f"[{CORRUPTION}]").alias("damaged"))
    asks = F.col("damaged") & F.col("bare").rlike(f"[{DEVANAGARI}]") & (F.length("bare") >= 3) & ~F.col("bare").rlike(r"\A[२०-९।.\-/]+\z")
    marked = marked.withColumn("word", F.when(asks, F.col("bare")))
    found = corrected_words(marked.select("word"), vocab, domain).select(F.col("word").alias("_w"), "corrected", "confidence")
    fixed = marked.join(found, F.col("word") == F.col("_w"), "left").select(*keys, "place", F.when(F.col("confidence") >= least, F.col("corrected")).when(F.col("damaged"), F.col("bare")).otherwise(F.col("piece")).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda x: x["piece"]), "")
    out = fixed.groupBy(*keys).agg(joined.alias("text"))
    out = clean.select(*keys, F.col("t").isNull().alias("_null")).join(out, keys, "left")
    return out.select(*keys, F.when(F.col("_null"), None).otherwise(stripped(F.regexp_replace(F.coalesce("text", F.lit("")), f"(?U)[{SPACE}]+", " "))).alias("text"))
