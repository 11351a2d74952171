"""What the pages of a document tell of each other: near misses of frequent words, running lines, continuations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, masked_numbers, stripped
from .vocabulary import _less_one


def near_misses(words: DataFrame, least: int = 3, length: int = 3) -> DataFrame:
    """doc_id, page, original, suggested, frequency: rare words one edit from a frequent word of the same document.

    words: a row (doc_id, page, word) for each occurrence. A word is frequent
    from least occurrences. Words meet on themselves less one character, so
    that no pair is compared that can't be one edit apart. Of several frequent
    words the more frequent one is suggested, then the first in order.
    """
    counts = words.where(F.length("word") >= length).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    keyed = counts.select("doc_id", "word", "n", F.explode(_less_one(F.col("word"))).alias("key"))
    rare = keyed.where(F.col("n") < least)
    frequent = keyed.where(F.col("n") >= least).select("doc_id", F.col("word").alias("suggested"), F.col("n").alias("frequency"), "key")
    met = rare.join(frequent, ["doc_id", "key"]).where(F.levenshtein("word", "suggested") == 1)
    best = met.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "word").orderBy(F.desc("frequency"), "suggested"))).where("k = 1")
    pages = words.select("doc_id", "page", "word").distinct()
    return pages.join(best.select("doc_id", "word", "suggested", "frequency"), ["doc_id", "word"]).select("doc_id", "page", F.col("word").alias("original"), "suggested", "frequency")


def with_corrections(pages: DataFrame, corrections: DataFrame, least: int = 5) -> DataFrame:
    """pages (doc_id, page, text) with the corrections of at least that frequency made one after the other, in order of the original."""
    found = corrections.where(F.col("frequency") >= least).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("original", "suggested"))).alias("edits"))
    edits = F.coalesce("edits", F.array().cast("array<struct<original:string,suggested:string>>"))
    fixed = F.aggregate(edits, F.col("text"), lambda t, e: F.replace(t, e["original"], e["suggested"]))
    return pages.join(found, ["doc_id", "page"], "left").select("doc_id", "page", fixed.alias("text"))


def running_lines(lines: DataFrame, share: float = 0.25, least: int = 2, least_pages: int = 3, masked: bool = True, longer_than: int = 0) -> DataFrame:
    """doc_id, zone, line, n_pages: header and footer lines on enough pages.

    lines: (doc_id, page, zone, line). Lines are compared with numbers masked
    or as they are. A document with fewer than least_pages has none.
    """
    compared = masked_numbers(F.col("line")) if masked else stripped(F.col("line"))
    sizes = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    counted = lines.where(~is_blank(F.col("line"))).select("doc_id", "page", "zone", compared.alias("line")).where(F.length("line") > longer_than).groupBy("doc_id", "zone", "line").agg(F.count("*").alias("n_pages"))
    enough = F.greatest(F.lit(least), F.floor(F.col("pages") * share))
    return counted.join(sizes, "doc_id").where((F.col("pages") >= least_pages) & (F.col("n_pages") >= enough)).select("doc_id", "zone", "line", "n_pages")


def continued_sentences(pages: DataFrame) -> DataFrame:
    """doc_id, page, next_page: pages whose text doesn't end a sentence and the page that follows."""
    after = F.lead("page").over(Window.partitionBy("doc_id").orderBy("page"))
    return pages.withColumn("next_page", after).where(F.col("next_page").isNotNull() & ~is_blank(F.col("text")) & ~stripped(F.col("text")).rlike(r"[.।?!:]\z")).select("doc_id", "page", "next_page")


def continued_tables(tables: DataFrame, page_height: float) -> DataFrame:
    """doc_id, page, table_id, next_table_id: a table that reaches the last 30 % of a page and one in the first 20 % of the next, with as many columns."""
    last = tables.where((F.col("y1") >= page_height * 0.7) & (F.col("n_columns") > 0))
    first = tables.where(F.col("y0") <= page_height * 0.2).select("doc_id", (F.col("page") - 1).alias("page"), "n_columns", F.col("table_id").alias("next_table_id"))
    return last.join(first, ["doc_id", "page", "n_columns"]).select("doc_id", "page", "table_id", "next_table_id")
