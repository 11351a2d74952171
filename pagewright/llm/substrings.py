"""Repeated passages by compacting a De Bruijn graph of token k-mers.

An edge is a run of WINDOW words; it is repeated if its words also start
anywhere else. The steps:

1. Every document gives the minimisers of its edges: the least of the short
   runs inside each edge. Equal edges have equal minimisers, so only edges
   whose minimiser occurs twice in the corpus can be repeated, and only those
   go on. That is a small share of all edges and loses none of the repeated.
2. Edges are counted, and each repeated one gets the coordinate (document and
   word) of its first source.
3. Joined back, consecutive edges of a document that lie consecutively in one
   source form a path without branches; it is compacted into one span with
   two coordinates.
4. Both coordinates are read and the spans' words compared (by 128-bit
   digests), so that equal numbers of different words remove nothing.

Rows with equal word sequences form a class, and steps 1 to 4 take each class
once; where it has two rows, all its edges are repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, dropped, map_arrow, texts, texts_of, windows, word_numbers, written

WINDOW, SHORT = 35, 8
#: Bits of a minimiser's position in its document.
PLACE = np.uint64(28)


def _minimisers(numbers: np.ndarray, window: int, short: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of every short run, and for every window the place of its least short run (the first of equal ones)."""
    runs = windows(numbers, short)
    width = window - short + 1
    least = (runs >> PLACE << PLACE) | np.arange(len(runs), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: span - width], least[width - span :])
    return runs, (least & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *(len(r) for r in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else [], kind))


def _first_look(docs: DataFrame, window: int, short: int) -> DataFrame:
    """doc_id, text_hash, n_words, words_key (of the word sequence), whole_sha256, anchors (a number for every minimiser's place)."""

    def start():

        def run(batch):
            n, key, sha, anchors = [], [], [], []
            for text in texts(batch):
                words = text.split()
                joined = b" ".join(words)
                n.append(len(words))
                key.append(hashlib.blake2b(joined, digest_size=16).digest())
                sha.append(hashlib.sha256(joined).digest())
                if len(words) < window:
                    anchors.append(np.empty(0, np.int64))
                    continue
                runs, at = _minimisers(word_numbers(words), window, short)
                anchors.append(runs[np.unique(at)].view(np.int64))
            return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n_words": pa.array(n, pa.int64()), "words_key": pa.array(key, pa.binary()), "whole_sha256": pa.array(sha, pa.binary()), "anchors": _lists(anchors, pa.int64())}

        return run

    return map_arrow(docs, start, "doc_id long, text_hash long, n_words long, words_key binary, whole_sha256 binary, anchors array<long>")


def _edges(docs: DataFrame, window: int, short: int) -> DataFrame:
    """cls, text, edges, places, more: the distinct windows whose minimiser is one of the class's hits, where each starts first, and where else (null for nowhere)."""

    def start():

        def run(batch):
            edges, places, more, counts = [], [], [], []
            hits = batch.column("hits")
            ends, flat = hits.offsets.to_numpy(), hits.values.to_numpy().view(np.uint64)
            for i, text in enumerate(texts(batch)):
                n = word_numbers(text.split())
                runs, at = _minimisers(n, window, short)
                p = np.flatnonzero(np.isin(runs[at], flat[ends[i] : ends[i + 1]])).astype(np.int32)
                e = windows(n, window)[p].view(np.int64)
                order = np.argsort(e, kind="stable")
                e, p = e[order], p[order]
                first = np.r_[True, e[1:] != e[:-1]] if len(e) else np.empty(0, bool)
                edges.append(e[first])
                places.append(p[first])
                more.append(p[~first])
                counts.append(np.diff(np.r_[np.flatnonzero(first), len(e)]) - 1)
            counts = np.concatenate(counts) if counts else np.empty(0, np.int64)
            others = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(np.concatenate(more) if more else [], pa.int32()), mask=pa.array(counts == 0))
            listed = _lists(edges, pa.int64())
            return {"cls": batch.column("cls"), "text": batch.column("text"), "edges": listed, "places": _lists(places, pa.int32()), "more": pa.ListArray.from_arrays(listed.offsets, others)}

        return run

    return map_arrow(docs.select("cls", "text", "hits"), start, "cls long, text string, edges array<long>, places array<int>, more array<array<int>>")


def _digests(asked: DataFrame, window: int) -> DataFrame:
    """cls, at, n, digest of the words of n consecutive windows from word at; asked has texts and lists of (at, n)."""

    def start():
        def run(batch):
            ids, at, n, digest = [], [], [], []
            for doc, text, wanted in zip(batch.column("cls").to_pylist(), texts(batch), batch.column("wanted").to_pylist(), strict=True):
                words = text.split()
                for w in wanted:
                    ids.append(doc)
                    at.append(w["at"])
                    n.append(w["n"])
                    digest.append(hashlib.blake2b(b" ".join(words[w["at"] : w["at"] + w["n"] + window - 1]), digest_size=16).digest())
            return {"cls": pa.array(ids, pa.int64()), "at": pa.array(at, pa.int32()), "n": pa.array(n, pa.int32()), "digest": pa.array(digest, pa.binary())}

        return run

    return map_arrow(asked.select("cls", "text", "wanted"), start, "cls long, at int, n int, digest binary")


def _kept(found: DataFrame, window: int) -> DataFrame:
    """cls, n_removed, kept_sha256, kept_text: the words that no span covers."""

    def start():
        def run(batch):
            removed, sha, kept = [], [], []
            for text, spans in zip(texts(batch), batch.column("wanted").to_pylist(), strict=True):
                words = text.split()
                step = np.zeros(len(words) + 1, np.int32)
                for s in spans:
                    step[s["at"]] += 1
                    step[s["at"] + s["n"] + window - 1] -= 1
                gone = np.cumsum(step[:-1]) > 0
                rest = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(rest).digest())
                kept.append(rest)
            return {"cls": batch.column("cls"), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.binary()), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}

        return run

    return map_arrow(found.select("cls", "text", "wanted"), start, "cls long, n_removed long, kept_sha256 binary, kept_text string")


def _wanted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cls").agg(F.collect_list(F.struct("at", "n")).alias("wanted"))


def repeated_spans(read: DataFrame) -> DataFrame:
    """cls, at, n, source_id, source_at: compacted paths, not yet verified. read has a row (cls, edges, places, more) for each class."""
    each = read.select("cls", F.arrays_zip("edges", "places", "more").alias("z")).select("cls", F.inline("z")).withColumnsRenamed({"edges": "edge", "places": "place"})
    times = 1 + F.when(F.col("more").isNull(), 0).otherwise(F.size("more"))
    first = each.groupBy("edge").agg(F.sum(times).alias("c"), F.min(F.struct("cls", "place")).alias("source")).where("c > 1")
    # Written, so that the join has a shuffle of its own on both sides and a very common edge can be split.
    first = written(first.select("edge", F.col("source.cls").alias("source_id"), F.col("source.place").alias("source_place")))
    again = each.join(first, "edge").select("cls", "source_id", "source_place", F.explode(F.concat(F.array("place"), F.coalesce("more", F.array().cast("array<int>")))).alias("place"))
    again = again.where("cls <> source_id or place <> source_place").select("cls", "place", "source_id", (F.col("place") - F.col("source_place")).alias("shift"))
    # With the same shift, places that are consecutive less their rank are equal: a path without branches.
    path = again.selectExpr("*", "place - row_number() over (partition by cls, source_id, shift order by place) as path")
    return path.groupBy("cls", "source_id", "shift", "path").agg(F.min("place").alias("at"), F.count("*").cast("int").alias("n")).select("cls", "at", "n", "source_id", (F.col("at") - F.col("shift")).alias("source_at"))


def without_repeats(docs: DataFrame, window: int = WINDOW, short: int = SHORT) -> DataFrame:
    """doc_id, text_hash, n_words, n_removed, kept_sha256 (binary), kept_text (null if no word goes) for every row of docs.

    Words are runs of bytes other than white space. A word goes if a window
    over it has the same words as one that starts anywhere else, in the same
    row or another. Null and empty texts have no words; a text of fewer words
    than a window stays. Rows that repeat a doc_id, or have none, are texts of
    their own: they repeat each other if their texts do. text_hash tells them
    apart. Other columns are ignored.
    """
    docs = texts_of(docs).withColumn("text_hash", F.xxhash64("text"))
    look = written(_first_look(docs, window, short), ROWS)
    source = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("source")
    classes = look.groupBy("words_key").agg(source, F.count("*").alias("copies"), F.first("n_words").alias("n")).where(F.col("n") >= window)
    classes = written(classes.select(F.monotonically_increasing_id().alias("cls"), "words_key", "copies", F.col("source.doc_id").alias("source_doc"), F.col("source.text_hash").alias("source_hash")))
    is_source = F.col("doc_id").eqNullSafe(F.col("source_doc")) & (F.col("text_hash") == F.col("source_hash"))
    reps = look.join(classes, "words_key").where(is_source).select("cls", "anchors").dropDuplicates(["cls"])
    twice = written(reps.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    # A class asks for each of its anchors once, however often it has them.
    anchors = reps.select("cls", F.explode(F.array_distinct("anchors")).alias("anchor"))
    hits = anchors.join(twice, "anchor").groupBy("cls").agg(F.collect_list("anchor").alias("hits"))
    hits = written(hits.join(classes.select("cls", "source_doc", "source_hash"), "cls"))
    dropped(twice)
    read = written(_edges(docs.join(hits, is_source), window, short), ROWS)
    dropped(hits)
    if not read.groupBy("cls").agg(F.count("*").alias("c")).where("c > 1").isEmpty():
        # Rows with the same id and text have all been read.
        read = written(read.dropDuplicates(["cls"]))
    spans = written(repeated_spans(read.select("cls", "edges", "places", "more")))

    here = spans.select("cls", "at", "n")
    there = spans.select(F.col("source_id").alias("cls"), F.col("source_at").alias("at"), "n")
    digests = written(_digests(read.select("cls", "text").join(_wanted(here.union(there).distinct()), "cls"), window), ROWS)
    same = (
        spans.join(digests, ["cls", "at", "n"])
        .withColumnRenamed("digest", "own")
        .join(digests.select(F.col("cls").alias("source_id"), F.col("at").alias("source_at"), "n", "digest"), ["source_id", "source_at", "n"])
        .where("own = digest")
    )
    covered = same.select("cls", "at", "n").union(same.select(F.col("source_id"), F.col("source_at"), "n")).distinct()
    left = written(_kept(read.select("cls", "text").join(_wanted(covered), "cls"), window), ROWS)
    dropped(read, spans, digests)

    nothing = F.lit(hashlib.sha256(b"").digest())
    known = look.drop("anchors").join(classes.select("words_key", "cls", "copies"), "words_key", "left").join(left, "cls", "left")
    return known.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.when(F.col("copies") > 1, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copies") > 1, nothing).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(F.col("copies") > 1, "").otherwise(F.col("kept_text")).alias("kept_text"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of their texts and n_chars counted anew; every row stays, also one that loses all words."""
    left = without_repeats(docs).where("n_removed > 0").select(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), F.col("kept_text").alias("cut_text"))
    # Rows with the same id and text lose the same.
    left = left.dropDuplicates(["cut_id", "cut_hash"])
    own_hash = F.xxhash64(docs["text"].cast("string"))
    out = docs.join(left, docs["doc_id"].cast("long").eqNullSafe(left["cut_id"]) & (own_hash == left["cut_hash"]), "left")
    new = {"text": F.coalesce("cut_text", docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("cut_text").isNull(), docs["n_chars"]).otherwise(F.length("cut_text")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))
