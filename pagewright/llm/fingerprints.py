"""Document fingerprints by I-Match, with several randomised lexicon subsets.

Terms are words. The lexicon has the terms whose document frequency lies
within a band of shares of all documents, that is within a band of inverse
document frequency. The band's lower end bounds its size: with a mean of m
distinct terms a document, no more than m / share terms can reach it, whatever
the corpus. Each subset takes a term by the hash of the term and the subset's
number; subsets come in levels that keep 1 term in RATES[level] each. A
document's distinct terms in a subset are sorted and hashed to one part of its
fingerprint; a subset without any of its terms gives no part. A text none of
whose terms is in the band falls back on all its terms.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX_1, MIX_2, map_arrow, mixed, released, texts, texts_of, word_numbers

#: Shares of all documents that a term of the lexicon is in.
BAND = (0.0005, 0.2)
#: One term in so many is in a subset of each level, and subsets of a level.
RATES, SUBSETS = (2, 8, 32, 128, 512), 12
#: Ranges of doc_id at most, and what stands for no doc_id where rows are put in order.
RANGES, NO_ID = 20_000, -(2**63)
FOUND = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Subsets with parts on both sides that a level needs to be compared.
LEAST_PARTS = 3


def _terms(text: bytes) -> np.ndarray:
    return np.unique(word_numbers(text.lower().split()))


class Subsets:
    """The lexicon's terms with a bit for each subset that holds them."""

    def __init__(self, lexicon: np.ndarray):
        self.terms, self.bits = lexicon, self._member(lexicon)

    @staticmethod
    def _member(terms: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(terms), len(RATES) * SUBSETS), bool)
        seeds = np.arange(1, bits.shape[1] + 1, dtype=np.uint64) * MIX_2
        for k, seed in enumerate(seeds):
            bits[:, k] = mixed(terms ^ seed) % np.uint64(RATES[k // SUBSETS]) == 0
        return bits

    def fingerprint(self, terms: np.ndarray) -> str:
        """Eight hexadecimal digits for each subset, or dashes for one that holds none of the terms. terms: sorted and distinct."""
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        at = at[self.terms[at] == terms] if len(self.terms) else at[:0]
        terms, bits = (self.terms[at], self.bits[at]) if len(at) else (terms, self._member(terms))
        # The sum over a subset's sorted distinct terms is their hash: each is mixed first.
        sums = mixed((bits * mixed(terms + MIX_1)[:, None]).sum(0, dtype=np.uint64)) >> np.uint64(32)
        return "".join([f"{x:08x}" if some else "-" * 8 for x, some in zip(sums.tolist(), bits.any(0).tolist(), strict=True)])


def likeness(a: str, b: str) -> float:
    """The largest share of equal parts on a level, of those where either has one; 1 for equal fingerprints, 0 if no level can be compared."""
    if a == b:
        return 1.0
    best, size = 0.0, 8 * SUBSETS
    for at in range(0, size * len(RATES), size):
        pairs = [(a[i : i + 8], b[i : i + 8]) for i in range(at, at + size, 8)]
        some = [x == y for x, y in pairs if x[0] != "-" or y[0] != "-"]
        if len(some) >= LEAST_PARTS:
            best = max(best, sum(some) / len(some))
    return best


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> np.ndarray:
    """Sorted numbers of the terms in the band; document frequencies count all documents. Its size is bounded as said above."""
    total = docs.count()

    def start():

        def run(batch):
            each = [_terms(t) for t in texts(batch)]
            codes, distinct = pd.factorize(np.concatenate(each).view(np.int64))
            return {"term": pa.array(distinct), "n": pa.array(np.bincount(codes, minlength=len(distinct)))}

        return run

    counted = map_arrow(texts_of(docs), start, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    chosen = counted.where((F.col("n") >= band[0] * total) & (F.col("n") <= band[1] * total) & (F.col("n") > 1)).select("term")
    return np.sort(np.array([r[0] for r in chosen.toLocalIterator()], np.int64).view(np.uint64))


def dealt_by_id(docs: DataFrame) -> DataFrame:
    """part, doc_id, text, is_guest in partitions by part: docs dealt to ranges of doc_id; the first document of a range is also a guest of the range before, the very first of the last range.

    The ends of the ranges are ids that occur, about as many as the input has
    partitions and no more than RANGES; one shuffle of the texts, each range to
    a partition of its own, is enough for each document to stand beside its
    next one. The ends, 8 bytes a range, go to the executors.
    """
    n = min(max(1, docs.rdd.getNumPartitions()), RANGES)
    key = F.coalesce("doc_id", F.lit(NO_ID))
    ends = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], max(10_000, 4 * n)).alias("e"), F.min(key).alias("least")).first()
    firsts = np.array(sorted({ends["least"], *(ends["e"] or [])} - {None}), np.int64)
    count = max(1, len(firsts))
    shared = docs.sparkSession.sparkContext.broadcast(firsts)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        at = np.maximum(np.searchsorted(shared.value, ids.to_numpy(), "right") - 1, 0)
        first = shared.value[at] == ids.to_numpy()
        # a guest's place is told by being negative
        return pd.Series([[p, -1 - (p - 1) % count] if f else [p] for p, f in zip(at.tolist(), first.tolist(), strict=True)])

    dealt = docs.select("doc_id", "text", F.explode(places(key)).alias("place"))
    part = F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("part")
    return dealt.select(part, "doc_id", "text", (F.col("place") < 0).alias("is_guest")).repartitionById(count, F.col("part")).sortWithinPartitions("part", "is_guest", "doc_id", "text")


def compared(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The edited text has its last quarter of code points replaced by the first
    as many of the next document's by doc_id (after the last, the first's).
    Null texts are empty; a lone document is its own next. Rows that repeat a
    doc_id follow each other in the order of their texts; rows without one come
    first. Other columns are ignored.
    """
    docs = texts_of(docs)
    terms = docs.sparkSession.sparkContext.broadcast(lexicon(docs, band))
    released(docs.sparkSession)

    def each(batches):
        subsets = Subsets(terms.value)
        # Of the row before: its id, text and fingerprint; and the part's number and first row, for a part without a guest.
        last = part = None
        out: list[tuple] = []

        def add(text: str, mark: str) -> None:
            doc, mine, own_mark = last
            k = len(mine) // 4
            edited = (mine[: len(mine) - k] + text[:k]).encode()
            edited_mark = subsets.fingerprint(_terms(edited))
            out.append((doc, len(mine), hashlib.sha256(edited).hexdigest(), own_mark, edited_mark, likeness(own_mark, edited_mark), likeness(own_mark, mark)))

        def found():
            columns = zip(*out, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])
            out.clear()
            return batch

        for batch in batches:
            for p, doc, text, is_guest in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "is_guest")), strict=True):
                text = text or ""
                mark = subsets.fingerprint(_terms(text.encode()))
                if last is not None and p == part:
                    add(text, mark)
                last, part = None if is_guest else (doc, text, mark), p
            if out:
                yield found()

    return dealt_by_id(docs).mapInArrow(each, FOUND)
