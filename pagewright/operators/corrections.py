"""A store of corrections as a relation: what was corrected how often, and look-ups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def store(events: DataFrame) -> DataFrame:
    """original, font, domain, corrected, n, confidence, last_seen: one row a key, with the first correction and the most confidence.

    events: (event_id, seen_at, original, corrected, font, domain, confidence).
    """
    return events.groupBy("original", "font", "domain").agg(F.min_by("corrected", "event_id").alias("corrected"), F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.max("seen_at").alias("last_seen"))


def merged(old: DataFrame, events: DataFrame) -> DataFrame:
    """A store with more events added to it."""
    new = store(events).withColumn("age", F.lit(1))
    both = old.withColumn("age", F.lit(0)).unionByName(new)
    return both.groupBy("original", "font", "domain").agg(F.min_by("corrected", "age").alias("corrected"), F.sum("n").alias("n"), F.max("confidence").alias("confidence"), F.max("last_seen").alias("last_seen"))


def confusions(events: DataFrame) -> DataFrame:
    """wrong, meant, n: characters exchanged in corrections of equal length."""
    pairs = F.arrays_zip(F.split("original", "").alias("wrong"), F.split("corrected", "").alias("meant"))
    each = events.where(F.length("original") == F.length("corrected")).select(F.explode(pairs).alias("p")).select("p.wrong", "p.meant")
    return each.where("wrong <> meant").groupBy("wrong", "meant").agg(F.count("*").alias("n"))


def common_confusions(events: DataFrame, top: int = 20) -> DataFrame:
    """The top confusions; the report has that many rows."""
    return confusions(events).orderBy(F.desc("n"), "wrong", "meant").limit(top)


def domain_words(events: DataFrame) -> DataFrame:
    """domain, word, n of what was corrected to."""
    return events.where("domain <> ''").groupBy("domain", F.col("corrected").alias("word")).agg(F.count("*").alias("n"))


def font_maps(events: DataFrame) -> DataFrame:
    """font, original, corrected: the last correction of each."""
    return events.where("font <> ''").groupBy("font", "original").agg(F.max_by("corrected", "event_id").alias("corrected"))


def suggested(asked: DataFrame, corrections: DataFrame, maps: DataFrame) -> DataFrame:
    """asked (original, font, domain) with suggestion and confidence: by text, font and domain; by text and font; by the font's map; by the text alone; else null."""
    c = corrections.select(F.col("original").alias("_o"), F.col("font").alias("_f"), F.col("domain").alias("_d"), F.struct("corrected", "n", "confidence").alias("r"))
    out = asked.select("original", "font", "domain").distinct()
    keys = (("r1", F.col("font"), F.col("domain")), ("r2", F.col("font"), F.lit("")), ("r4", F.lit(""), F.lit("")))
    for name, font, domain in keys:
        out = out.join(c.withColumnRenamed("r", name), (F.col("original") == F.col("_o")) & (font == F.col("_f")) & (domain == F.col("_d")), "left").drop("_o", "_f", "_d")
    m = maps.select(F.col("font").alias("_f"), F.col("original").alias("_o"), F.col("corrected").alias("r3"))
    out = out.join(m, (F.col("original") == F.col("_o")) & (F.col("font") == F.col("_f")), "left").drop("_o", "_f")
    answer = lambda text, sure: F.struct(text.alias("suggestion"), sure.cast("double").alias("confidence"))
    found = (
        F.when((F.col("r1.n") >= 2) & (F.col("r1.confidence") >= 60), answer(F.col("r1.corrected"), F.least(F.lit(95), F.col("r1.confidence") + 2 * F.col("r1.n"))))
        .when(F.col("r2.n") >= 3, answer(F.col("r2.corrected"), F.least(F.lit(90), F.col("r2.confidence"))))
        .when(F.col("r3").isNotNull(), answer(F.col("r3"), F.lit(80)))
        .when(F.col("r4.n") >= 5, answer(F.col("r4.corrected"), F.least(F.lit(85), F.col("r4.confidence"))))
    )
    return out.withColumn("a", found).select("original", "font", "domain", "a.suggestion", "a.confidence")


def statistics(events: DataFrame) -> DataFrame:
    """One row: distinct corrections, confusions, font entries and domains."""
    return events.agg(F.countDistinct("original", "font", "domain").alias("corrections"), F.countDistinct(F.when(F.col("font") != "", F.struct("font", "original"))).alias("font_entries"), F.countDistinct(F.when(F.col("domain") != "", F.col("domain"))).alias("domains"))


def recent(rows: DataFrame, keys: list[str], order: str, most: int = 5) -> DataFrame:
    """The last rows of each key; a history keeps that many."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_k") <= most).drop("_k")
