"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's tokens are words and runs of other marks. Its features are the hashes
of single tokens and of pairs, in 2^BITS buckets, each with the weight
1 + log(count), and the vector is scaled to length one. A score is a sparse dot
product with the weights. Nothing but the text is ever an input.

Training fits at most SAMPLE labelled rows, those with the least hashes of
their ids, as far as their texts have SAMPLE_CHARS characters together, so that
the same rows are chosen on any cluster and the driver's memory is bounded;
scores cover all rows and whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, slices, trimmed

BITS = 18
#: Labelled rows at most that the classifier is fitted on, characters of these at most, and passes over them.
SAMPLE, SAMPLE_CHARS, PASSES = 4000, 40_000_000, 4
#: The learning rate's scale and offset, and the strengths of the penalties on absolute and squared weights.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.0005, 0.0005

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Hashes(dict):
    """Numbers of tokens, remembered for up to 300,000 of them."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        n = self[token] = xxhash.xxh3_64_intdigest(token.lower().encode("utf-8", "surrogatepass")) | (1 if token.isupper() and len(token) > 1 else 0)
        return n


def features(text: str, hashes: Hashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets in ascending order, and their values; both empty for a text without tokens."""
    tokens = _TOKEN.findall(text)
    n = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    pairs = n[:-1] * np.uint64(0x9E3779B97F4A7C15) + n[1:]
    where, count = np.unique(np.concatenate([n, pairs]) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - bits), return_counts=True)
    value = 1 + np.log(count)
    return where.astype(np.int32), (value / np.sqrt((value * value).sum()) if len(value) else value).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights and bias by per-coordinate updates. rows: (buckets, values, label). Without rows, or with one label only, all weights stay 0 and the bias follows the share of label 1."""
    labels = np.array([r[2] for r in rows], float)
    share = min(max(float(labels.mean()) if len(labels) else 0.5, 0.01), 0.99)
    bias = float(np.log(share / (1 - share)))
    if not len(labels) or labels.min() == labels.max():
        return np.zeros(1 << bits, np.float32), bias
    weigh = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(i):
        strong = np.abs(z[i]) > L1
        return np.where(strong, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2), 0.0)

    bias, bias_n = 0.0, 0.0
    for _ in range(passes):
        for i, x, y in rows:
            w = weights(i)
            p = 1 / (1 + np.exp(-min(max(float(w @ x) + bias, -35), 35)))
            slope = (p - y) * weigh[y]
            g = slope * x
            step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - step * w
            n[i] += g * g
            bias_n += slope * slope
            bias -= 0.1 * slope / (1 + np.sqrt(bias_n))
    return weights(np.arange(1 << bits)).astype(np.float32), bias


def sample_of(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", size: int = SAMPLE) -> DataFrame:
    """doc_id, text, label: the labelled rows with the least hashes of their ids; rows without text or label don't count.

    Of rows that repeat a doc_id the least text counts, of labels that do the
    greatest. The first row whose text goes beyond SAMPLE_CHARS ends the sample.
    """
    marked = labels.where(may_learn).where(F.col(label).isNotNull()).select(F.col("doc_id").alias("labelled_id"), F.col(label).cast("int").alias("label"))
    chosen = marked.groupBy("labelled_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(size)
    # size bounds what is broadcast
    each = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled_id"))
    rows = each.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    # Over size rows at most; their texts stay where they are.
    sized = Window.orderBy(F.xxhash64("sample_id"), "sample_id")
    within = rows.select(F.col("doc_id").alias("sample_id"), F.length("text").alias("n")).withColumn("so_far", F.sum("n").over(sized)).where(F.col("so_far") <= SAMPLE_CHARS).select("sample_id")
    return rows.join(F.broadcast(within), F.col("doc_id") == F.col("sample_id"), "left_semi").select("doc_id", "text", "label")


def trained(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", size: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Weights and bias fitted on the driver; the features of at most size rows come to it."""

    def start():
        hashes = Hashes()

        def run(batch):
            rows = [features(t, hashes, bits) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "buckets": pa.array([r[0].tobytes() for r in rows]), "values": pa.array([r[1].tobytes() for r in rows])}

        return run

    sample = map_arrow(sample_of(docs, labels, may_learn, label, size), start, "doc_id long, label int, buckets binary, values binary")
    rows = sorted((xxhash.xxh3_64_intdigest(str(r["doc_id"])), r["doc_id"], np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["values"], np.float32).astype(float), r["label"]) for r in sample.toLocalIterator())
    return fit([r[2:] for r in rows], bits)


def scored(docs: DataFrame, weights: np.ndarray, bias: float, *more: str) -> DataFrame:
    """doc_id, score for every row of docs, and the columns in more. Null and empty texts score what the bias alone gives; very long ones are scored whole."""
    bits = int(len(weights)).bit_length() - 1
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))  # 4 bytes a bucket, whatever the corpus

    def each(found):
        hashes, (w, b) = Hashes(), model.value
        try:
            for batch in slices(found):
                z = []
                for t in batch.column("text").to_pylist():
                    i, x = features(t or "", hashes, bits)
                    z.append(float(w[i] @ x) + b)
                score = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(score, pa.float64())} | {c: batch.column(c) for c in more})
        finally:
            hashes = batch = None
            trimmed()

    schema = "doc_id long, score double" + "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in more)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more).mapInArrow(each, schema)


def accepted(docs: DataFrame, weights: np.ndarray, bias: float, least: float = 0.5) -> DataFrame:
    """docs without the documents that score under least; the same columns."""
    bits = int(len(weights)).bit_length() - 1
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def each(found):
        hashes, (w, b) = Hashes(), model.value
        try:
            for batch in slices(found):
                keep = []
                for t in batch.column("text").to_pylist():
                    i, x = features(t or "", hashes, bits)
                    keep.append(1 / (1 + np.exp(-min(max(float(w[i] @ x) + b, -35), 35))) >= least)
                yield batch.filter(pa.array(keep, pa.bool_()))
        finally:
            hashes = batch = None
            trimmed()

    return docs.mapInArrow(each, docs.schema)
