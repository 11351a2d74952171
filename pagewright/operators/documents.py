"""Pages and documents: scores, reports, candidates, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.devanagari import sequence_confidence
from ..functions.semantics import verdict
from ..functions.text import DEVANAGARI, PRIVATE, character_error_rate, is_blank, n_of, n_visible, share, stripped
from ..sources.stored import stored

GARBAGE = r"(?i)undefined|NaN|\[object|function\s*\("
#: Weights of a page's scores.
WEIGHTS = {"extraction": 0.35, "layout": 0.25, "encoding": 0.25, "table": 0.15}


def page_scores(pages: DataFrame) -> DataFrame:
    """doc_id, page, extraction, layout, table, encoding, overall, n_warnings.

    pages: (doc_id, page, text, n_columns, unbalanced, tables, empty_tables,
    uneven_tables, has_legacy). Text scores by garbage, private characters and
    length; encoding by Devanagari where legacy fonts are, and by sequences.
    """
    t = F.col("text")
    blank, private = is_blank(t), n_of(t, PRIVATE)
    short = F.length(stripped(t)) < 10
    extraction = F.when(blank, 0.0).otherwise(100.0 - F.when(t.rlike(GARBAGE), 30.0).otherwise(0.0) - F.least(F.lit(20.0), 2.0 * private) - F.when(short, 20.0).otherwise(0.0))
    layout = F.when(F.col("n_columns") > 1, F.when(F.col("unbalanced"), 70.0).otherwise(85.0)).otherwise(95.0)
    table = F.when(F.col("tables") == 0, 100.0).otherwise(F.greatest(F.lit(0.0), 80.0 - 20.0 * F.col("empty_tables") - 10.0 * F.col("uneven_tables")))
    deva = share(n_of(t, DEVANAGARI), n_visible(t))
    low, poor = F.col("has_legacy") & (deva < 0.2), sequence_confidence(t) < 70
    encoding = F.when(blank, 0.0).otherwise(100.0 - F.when(low, 30.0).otherwise(0.0) - F.when(poor, 20.0).otherwise(0.0))
    scores = pages.select("doc_id", "page", extraction.alias("extraction"), layout.alias("layout"), table.alias("table"), encoding.alias("encoding"), F.size(F.array_compact(F.array(*(F.when(w, 1) for w in (blank, ~blank & t.rlike(GARBAGE), ~blank & (private > 0), ~blank & short, ~blank & low, ~blank & poor))))).alias("n_warnings"))
    return scores.withColumn("overall", sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)))


def document_scores(pages: DataFrame) -> DataFrame:
    """doc_id, n_pages, overall, least, extraction, layout, table, encoding, low_pages, n_warnings of page scores."""
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.avg("overall").alias("overall"), F.min("overall").alias("least"), *(F.avg(k).alias(k) for k in ("extraction", "layout", "table", "encoding")),
        F.array_sort(F.collect_list(F.when(F.col("overall") < 60, F.col("page")))).alias("low_pages"), F.sum("n_warnings").alias("n_warnings"),
    )


def validation_report(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, six checks, n_passed, is_valid. pages: (doc_id, page, text, tables, empty_tables, has_legacy, overall); expected: (doc_id, expected_pages)."""
    t = F.col("text")
    sums = pages.groupBy("doc_id").agg(
        F.count("*").alias("n_pages"), F.array_sort(F.collect_list(F.when(F.length(stripped(t)) < 5, F.col("page")))).alias("empty_pages"), F.sum(n_visible(t)).alias("chars"),
        F.sum(n_of(t, DEVANAGARI)).alias("deva"), F.sum(n_of(t, PRIVATE)).alias("private"), F.max("has_legacy").alias("has_legacy"), F.sum("tables").alias("tables"),
        F.sum("empty_tables").alias("empty_tables"), F.avg("overall").alias("overall"),
    ).join(expected, "doc_id")
    quality = 100 - F.least(F.lit(30), 2 * F.col("private")) - F.when(F.col("has_legacy") & (F.col("chars") > 0) & (F.col("deva") / F.col("chars") < 0.2), 20).otherwise(0)
    checks = {
        "page_count": F.col("n_pages") >= F.col("expected_pages"),
        "no_empty_pages": F.size("empty_pages") == 0,
        "encoding_quality": quality >= 60,
        "table_quality": F.col("empty_tables") == 0,
        "text_density": F.when((F.col("expected_pages") > 0) & (F.col("chars") > 0), F.col("chars") / F.col("expected_pages") >= 50),
        "confidence": F.col("overall") >= 50,
    }
    passed = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in checks.values()), F.lit(0))
    n = sum((c.isNotNull().cast("int") for c in checks.values()), F.lit(0))
    valid = checks["page_count"] & checks["encoding_quality"] & checks["confidence"]
    return sums.select("doc_id", *(c.alias(k) for k, c in checks.items()), passed.alias("n_passed"), n.alias("n_checks"), valid.alias("is_valid"), "empty_pages", quality.alias("quality"))


def best_candidates(candidates: DataFrame) -> DataFrame:
    """doc_id, page, source, text, score of the candidate with the most points; the earlier wins ties. candidates: (doc_id, page, source, place, text, score)."""
    best = F.max_by(F.struct("source", "text", "score"), F.struct("score", (-F.col("place")).alias("less")))
    return candidates.groupBy("doc_id", "page").agg(best.alias("b")).select("doc_id", "page", "b.*")


def first_good(candidates: DataFrame, least: float = 75.0) -> DataFrame:
    """The first candidate in order that reaches least, else the best: a ladder of attempts that stops at a good one."""
    key = F.when(F.col("score") >= least, F.struct(F.lit(1).alias("good"), (-F.col("place")).cast("double").alias("k"), (-F.col("place")).alias("less"))).otherwise(F.struct(F.lit(0).alias("good"), F.col("score").cast("double").alias("k"), (-F.col("place")).alias("less")))
    best = F.max_by(F.struct("source", "text", "score"), key)
    return candidates.groupBy("doc_id", "page").agg(best.alias("b")).select("doc_id", "page", "b.*")


def consensus(candidates: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, page, agreed: whether any two sources share that part of their words, by the larger set."""
    words = F.array_distinct(F.filter(F.split("text", r"(?U)\s+"), lambda x: x != ""))
    near = lambda a, b: (a["place"] < b["place"]) & (F.size(F.array_intersect(a["w"], b["w"])) / F.greatest(F.size(a["w"]), F.size(b["w"])) >= least)
    # A page has a text from each of a few engines.
    found = candidates.groupBy("doc_id", "page").agg(F.collect_list(F.struct("place", words.alias("w"))).alias("sets")).withColumn("sets", F.filter("sets", lambda x: F.size(x["w"]) > 0))
    return found.select("doc_id", "page", F.exists("sets", lambda a: F.exists("sets", lambda b: near(a, b))).alias("agreed"))


def method_counts(pages: DataFrame, batch: int = 50) -> DataFrame:
    """doc_id, batch, n_pages, direct_unicode, direct_legacy, no_text, total_chars for every fifty pages. pages: (doc_id, page, method, char_count)."""
    b = F.floor((F.col("page") - 1) / batch) + 1
    n = lambda m: F.count_if(F.col("method") == m).alias(m)
    return pages.groupBy("doc_id", b.alias("batch")).agg(F.count("*").alias("n_pages"), n("direct_unicode"), n("direct_legacy"), n("no_text"), F.sum("char_count").alias("total_chars"))


def joined_pages(pages: DataFrame, separator: str = "\n\n--- Page Break ---\n\n") -> DataFrame:
    """doc_id, text, n_pages, mean_confidence of pages (doc_id, page, text, confidence), in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), separator)
    return pages.groupBy("doc_id").agg(text.alias("text"), F.count("*").alias("n_pages"), F.avg("confidence").alias("mean_confidence"))


def split_pages(c: Column) -> Column:
    """The pages of a text between either kind of page mark, trimmed."""
    c = F.regexp_replace(c, r"(?i)\n*─{30,}\n\s*Page\s+\d+\s*\n─{30,}\n*", "\n\n--- Page Break ---\n\n")
    return F.transform(F.split(c, r"(?i)\s*---\s*Page Break\s*---\s*"), stripped)


def text_files(docs: DataFrame, separators: bool = True, running: bool = True) -> DataFrame:
    """doc_id, content of docs (doc_id, text, n_pages): a text file with a banner before each page, or blank lines between pages; without header and footer lines if asked."""
    bar = "═" * 60
    label = lambda i: F.concat(F.lit(f"{bar}\n  PAGE "), (i + 1).cast("string"), F.lit(" / "), F.col("_total").cast("string"), F.lit(f"\n{bar}\n"))
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), "n_pages").withColumn("_parts", split_pages(F.col("_text")))
    out = out.withColumn("_total", F.greatest(F.coalesce("n_pages", F.lit(0)), F.size("_parts")))
    banners = F.array_join(F.transform("_parts", lambda p, i: F.concat(label(i), F.lit("\n"), p, F.lit("\n"))), "\n")
    joined = F.when(F.size("_parts") > 1, banners).otherwise(F.get("_parts", 0)) if separators else F.array_join("_parts", "\n\n")
    content = joined if running else F.regexp_replace(joined, r"\[(?:HEADER|FOOTER)\][^\n]*\n?", "")
    out = out.withColumn("_content", F.regexp_replace(content, "\n{4,}", "\n\n\n"))
    nothing = "[No text could be extracted from this document.]\n"
    return out.select("doc_id", F.when(is_blank(F.col("_text")), nothing).otherwise(F.concat(stripped(F.col("_content")), F.lit("\n"))).alias("content"))


def quality_report(batches: DataFrame) -> DataFrame:
    """doc_id, report: a line for each batch of pages, in order."""
    pages = F.concat(((F.col("batch") - 1) * 50 + 1).cast("string"), F.lit("-"), ((F.col("batch") - 1) * 50 + F.col("n_pages")).cast("string"))
    line = F.format_string("Batch %d (pages %s): direct_unicode=%d, direct_legacy=%d, no_text=%d, chars=%d", "batch", pages, "direct_unicode", "direct_legacy", "no_text", "total_chars")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("batch", line.alias("line")))), lambda x: x["line"])
    rule = "─" * 60
    return batches.groupBy("doc_id").agg(F.concat(F.lit(f"{rule}\nEXTRACTION QUALITY REPORT\n{rule}\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("report"))


def serialized(elements: DataFrame) -> DataFrame:
    """doc_id, page, text: headers, body in reading order, footnotes and footers, with marks for headings and lists. elements: (doc_id, page, section, place, kind, level, text)."""
    rank = F.when(F.col("section") == "header", 0).when(F.col("section") == "body", 1).when(F.col("section") == "footnote", 2).otherwise(3)
    t = F.col("text")
    piece = (
        F.when(F.col("section") == "header", F.concat(F.lit("[HEADER] "), t))
        .when(F.col("section") == "footer", F.concat(F.lit("[FOOTER] "), t))
        .when(F.col("section") == "footnote", F.concat(F.lit("[FOOTNOTE] "), t))
        .when(F.col("kind").like("heading_%"), F.concat(F.repeat(F.lit("#"), F.substring("kind", 9, 1).cast("int")), F.lit(" "), t))
        .when(F.col("kind") == "list_item", F.concat(F.repeat(F.lit("  "), F.col("level") - 1), t))
        .otherwise(t)
    )
    ordered = F.array_sort(F.collect_list(F.struct(rank.alias("r"), "place", piece.alias("piece"))))
    return elements.where(~is_blank(t)).groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "\n").alias("text"))


def graph_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with rank: a node's longest path from one without predecessor; edges (doc_id, source, target) must have no cycle. Depth rounds, each a join and a table on shared storage."""
    ranked = nodes.select("doc_id", "node").withColumn("rank", F.lit(0))
    while True:
        step = edges.join(ranked.withColumnRenamed("node", "source"), ["doc_id", "source"]).groupBy("doc_id", F.col("target").alias("node")).agg((F.max("rank") + 1).alias("next"))
        new = stored(ranked.join(step, ["doc_id", "node"], "left").select("doc_id", "node", F.greatest("rank", F.coalesce("next", F.lit(0))).alias("rank"), (F.coalesce("next", F.lit(0)) > F.col("rank")).alias("moved")))
        if not new.where("moved").head(1):
            return new.select("doc_id", "node", "rank")
        ranked = new.drop("moved")


def adjusted_confidence(confidence: Column, issues: Column) -> Column:
    """A confidence after a text's semantic issues, not under 0. The text itself stays: only the vocabulary's words with a certainty of 90 would be put in, and those are the words that stand there."""
    return F.greatest(F.lit(0.0), confidence + verdict(issues)["adjustment"])


def golden_pairs(pairs: DataFrame, most: float = 0.02) -> DataFrame:
    """name, rate, status of pairs (name, expected, found): PASS up to that rate of wrong characters, FAIL over it, MISSING without a text."""
    rate = F.when(F.col("found").isNotNull(), character_error_rate(F.col("found"), F.col("expected")))
    return pairs.select("name", rate.alias("rate"), F.when(F.col("found").isNull(), "MISSING").when(rate <= most, "PASS").otherwise("FAIL").alias("status"))


def metrics_of_words(mean: Column, words: Column) -> Column:
    """Whether a recognised page is to be tried again: few words or little confidence."""
    return (words < 2) | (mean < 75)


def batch_files(files: DataFrame) -> DataFrame:
    """name, status, entry, text of converted files (name, text, error): a text's entry in the archive is named after its file."""
    done = F.coalesce(F.col("text") != "", F.lit(False)) & F.col("error").isNull()
    entry = F.concat(F.regexp_replace("name", r"\.[^/.]+\z", ""), F.lit("_unicode.txt"))
    return files.select("name", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), F.when(done, entry).alias("entry"), F.when(done, F.col("text")).alias("text"))
