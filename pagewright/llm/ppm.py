"""LM scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to ORDER bytes with counts from the
training texts. A symbol is predicted from the longest context seen; if it
hasn't been seen there, the model escapes to the context without its first
byte, leaving out all symbols that the longer one knows (symbol exclusion).
Escapes are estimated by method D: of n symbols of which q are distinct, a
symbol seen c times has (2c - 1) / 2n and the escape q / 2n. Below the empty
context come the symbols not seen at all, equally likely. An end symbol closes
each text, so that the probabilities of all texts sum to one.

The trie never leaves the cluster. Texts are dealt to blocks of bounded size.
A block gives the distinct strings of ORDER + 1 symbols in its texts, with
counts; the strings' sums over all blocks are the trie, and its levels are
joined from the shortest context upwards to the logarithm that each string's
last symbol costs. A block gets back only its own strings' costs, holds them as
two sorted arrays, and adds them up for its texts as these stream by. So what a
task holds depends on a block's size alone, and what is gathered grows with the
corpus.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, texts, word_numbers, written

ORDER = 5
#: Bytes of text in a block, and of those handled at a time.
BLOCK_BYTES, PIECE_BYTES = 40_000_000, 1_000_000
#: Rows of sorted parts that are merged at a time.
MERGED = 500_000
END, BEFORE, BITS = 256, 257, 9
#: Symbols that may follow a context.
SYMBOLS = 257


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def strings(pieces: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of the texts, END included, the string of it and the order symbols before it; and each text's first place."""
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    starts = np.cumsum(np.r_[0, sizes[:-1]])
    raw = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64)
    raw[starts + sizes - 1] = END
    out = raw.copy()
    for k in range(1, order + 1):
        out[k:] |= raw[:-k] << (BITS * k)
    for place in range(order):
        # The symbols up to place of each text have fewer symbols before them.
        at = (starts + place)[sizes > place]
        keep = BITS * (place + 1)
        fill = sum(BEFORE << (BITS * k) for k in range(place + 1, order + 1))
        out[at] = (out[at] & ((1 << keep) - 1)) | fill
    return out, starts


def pieces_of(all_texts: list):
    """Runs of consecutive texts of about PIECE_BYTES, as slices."""
    at, size = 0, 0
    for i, t in enumerate(all_texts):
        size += len(t)
        if size > PIECE_BYTES:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(all_texts):
        yield slice(at, len(all_texts))


#: Set in keys of words, which makes them negative; strings have at most 54 bits.
WORD = np.uint64(1 << 63)


def word_keys(text: bytes) -> np.ndarray:
    return (word_numbers(text.lower().split()) | WORD).view(np.int64)


def _given_back() -> None:
    """Freed memory goes back to the system, as a task's Python process lives on beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _merging(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys of several sorted parts in order, and the sums of their counts, about MERGED of the parts' rows at a time."""
    longest = max((keys for keys, _ in parts), key=len)
    steps = -(-sum(len(keys) for keys, _ in parts) // MERGED)
    bounds = longest[np.arange(1, steps) * len(longest) // steps] if len(longest) else longest
    cuts = [np.r_[0, np.searchsorted(keys, bounds), len(keys)] for keys, _ in parts]
    for k in range(len(bounds) + 1):
        keys, n = (np.concatenate([p[i][c[k] : c[k + 1]] for p, c in zip(parts, cuts, strict=True)]) for i in (0, 1))
        if not len(keys):
            continue
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        yield keys[first], np.add.reduceat(n[by], first, dtype=np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The parts as one. What is held meanwhile is little more than they and their sum."""
    found = list(_merging(parts)) or parts[:1]
    return tuple(np.concatenate([f[i] for f in found]) for i in (0, 1))


def _counted(blocks: DataFrame, order: int) -> DataFrame:
    """block, key, n: each block's distinct strings and words, with the number of their places in training texts.

    A task holds the distinct keys of the few blocks that come to it.
    """

    def each(batches):
        found = {}
        for batch in batches:
            block, train = batch.column("block").to_numpy(), np.array(batch.column("training").to_pylist(), bool)
            for b in np.unique(block).tolist():
                mine = np.flatnonzero(block == b)
                # Texts to learn from come first, so that most pieces count for all of their places or none.
                mine = mine[np.argsort(~train[mine], kind="stable")]
                own = texts(batch.take(pa.array(mine)))
                for s in pieces_of(own):
                    places, starts = strings(own[s], order)
                    words = [word_keys(t) for t in own[s]]
                    for keys, sizes in ((places, np.diff(np.r_[starts, len(places)])), (np.concatenate(words), list(map(len, words)))):
                        learns = train[mine[s]]
                        codes, distinct = pd.factorize(keys)
                        if learns.all() or not learns.any():
                            n = np.bincount(codes, minlength=len(distinct)) * bool(learns.any())
                        else:
                            n = np.bincount(codes, np.repeat(learns, sizes), len(distinct)).astype(np.int64)
                        by = np.argsort(distinct)
                        parts = found.setdefault(b, [])
                        parts.append((distinct[by], n[by].astype(np.int32)))
                        if len(parts) == 16:
                            found[b] = [_merged(parts)]
                del own, places, words, keys, codes
        for b in list(found):
            for keys, n in _merging(found.pop(b)):
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(keys), b, np.int32)), "key": pa.array(keys), "n": pa.array(n)})
        _given_back()

    return blocks.mapInArrow(each, "block int, key long, n long")


def _shorter(string: Column, order: int) -> Column:
    """The string without its first symbol, of a string with order symbols of context."""
    return string.bitwiseAND(F.lit((1 << (BITS * order)) - 1))


def costs(counts: DataFrame, order: int) -> tuple[DataFrame, list[DataFrame]]:
    """string, cost: log10 of what the model gives each string's last symbol after the others; and the tables that it reads. counts: (string, n), n may be 0."""
    levels = [counts]
    for k in range(order, 0, -1):
        levels.append(written(levels[-1].groupBy(_shorter(F.col("string"), k).alias("string")).agg(F.sum("n").alias("n"))))
    levels.reverse()
    # all_n, q: symbols and distinct symbols seen after the string's context; escaped: cost of the last symbol given that this context is left.
    total = levels[0].agg(F.sum("n").alias("all_n"), F.count_if(F.col("n") > 0).alias("q"))
    low = levels[0].join(F.broadcast(total)).withColumn("escaped", -F.log10(F.greatest(F.lit(1.0), F.lit(float(SYMBOLS)) - F.col("q"))))
    for k in range(1, order + 1):
        below = low.select(F.col("string").alias("short"), F.col("n").alias("low_n"), F.col("all_n").alias("low_all"), F.col("q").alias("low_q"), F.col("escaped").alias("low_escaped"))
        if k == 1:
            below = F.broadcast(below)  # SYMBOLS rows at most
        both = levels[k].withColumn("short", _shorter(F.col("string"), k)).join(below, "short")
        over = "(partition by shiftright(string, %d))" % BITS
        both = both.selectExpr("string", "n", "low_n", "low_all", "low_q", "low_escaped", f"sum(n) over {over} as all_n", f"count_if(n > 0) over {over} as q", f"sum(if(n > 0, low_n, 0)) over {over} as known")
        rest_n, rest_q = F.col("low_all") - F.col("known"), F.col("low_q") - F.col("q")
        escaped = (
            F.when((F.col("low_all") == 0) | (rest_q == 0), F.col("low_escaped"))
            .when(F.col("low_n") > 0, F.log10((2 * F.col("low_n") - 1) / (2.0 * rest_n)))
            .otherwise(F.log10(rest_q / (2.0 * rest_n)) + F.col("low_escaped"))
        )
        before, low = low, both.select("string", "n", "all_n", "q", escaped.alias("escaped"))
        if k < order:
            low = written(low)
            dropped(before, levels[k])
    cost = F.when(F.col("all_n") == 0, F.col("escaped")).when(F.col("n") > 0, F.log10((2 * F.col("n") - 1) / (2.0 * F.col("all_n")))).otherwise(F.log10(F.col("q") / (2.0 * F.col("all_n"))) + F.col("escaped"))
    return low.select("string", cost.alias("cost")), [before, levels[0]]


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """docs with a block number, so that a block has about block_bytes of text; and the number of blocks."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + F.count("*")).first()[0]
    n = max(1, -(-size // block_bytes))
    return docs.withColumn("block", F.pmod(F.hash("doc_id", "text"), F.lit(n)).cast("int")), n


def scored(docs: DataFrame, training: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_symbols for every row of docs.

    score is log10 of the model's probability of the text. base_score is that
    of add-one word frequencies: words are runs of bytes other than white
    space, A-Z in lower case, and one end token closes a text. training says
    of each row whether both learn from it (null: not); they may learn from no
    row. Null texts are empty, and an empty text costs its end. Rows that
    repeat count and score each, in one block if both id and text are equal.
    Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    blocks, n = blocks_of(docs, block_bytes)
    # Four partitions for each block, so that few tasks get more than one block.
    with small_batches(docs.sparkSession):
        asked = written(_counted(blocks.select("block", "training", "text").repartition(4 * n, "block"), order))
    counts = written(asked.groupBy("key").agg(F.sum("n").alias("n")))
    cost, read = costs(counts.where("key >= 0").select(F.col("key").alias("string"), "n"), order)
    words = counts.where("key < 0 and n > 0")
    ends = docs.where("training").count()
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, distinct = int(totals[0]) + ends, totals[1] + (ends > 0)
    values = written(cost.select(F.col("string").alias("key"), F.col("cost").alias("value")).union(words.select("key", F.col("n").cast("double"))))
    dropped(counts, *read)
    answers = asked.select("block", "key").join(values, "key").select("block", F.lit(False).alias("is_text"), "key", "value", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    own = blocks.select("block", F.lit(True).alias("is_text"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"), "doc_id", "text")
    # As many partitions as in counting: a task's work doesn't grow with the corpus.
    rows = answers.union(own).repartition(4 * n, "block").sortWithinPartitions("block", "is_text", "key")
    with small_batches(docs.sparkSession):
        return written(_added_up(rows, order, tokens, distinct, ends))


def _added_up(rows: DataFrame, order: int, tokens: int, distinct: int, ends: int) -> DataFrame:
    """The texts' scores, of rows (block, is_text, key, value, doc_id, text) that have each block's answers by key and then its texts together."""
    least, end_cost = float(np.log10(1 / (tokens + distinct + 1))), float(np.log10((ends + 1) / (tokens + distinct + 1)))

    def score(keys, value, batch):
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "n_symbols")}
        all_texts = texts(batch)
        for s in pieces_of(all_texts):
            words = [word_keys(t) for t in all_texts[s]]
            sizes = np.array(list(map(len, words)), np.int64)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            codes, distinct_words = pd.factorize(np.concatenate(words))
            at = np.searchsorted(keys, distinct_words)
            at[at == len(keys)] = 0
            c = np.where(keys[at] == distinct_words, value[at], 0.0)
            out["n_tokens"].append(sizes + 1)
            out["n_known"].append(np.bincount(owner, (c > 0)[codes], len(sizes)).astype(np.int64) + (ends > 0))
            out["base_score"].append(np.bincount(owner, np.log10(c + 1)[codes], len(sizes)) + sizes * least + end_cost)
            places, starts = strings(all_texts[s], order)
            codes, distinct_strings = pd.factorize(places)
            # Looked up in their order, which is several times as fast.
            by, cost = np.argsort(distinct_strings), np.empty(len(distinct_strings))
            cost[by] = value[np.searchsorted(keys, distinct_strings[by])]
            out["score"].append(np.add.reduceat(cost[codes], starts))
            out["n_symbols"].append(np.diff(np.r_[starts, len(places)]))
        found = {k: pa.array(np.concatenate(v)) for k, v in out.items()}
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": found["n_tokens"], "n_known": found["n_known"], "train_tokens": pa.array(np.full(batch.num_rows, tokens, np.int64)), "base_score": found["base_score"], "score": found["score"], "n_symbols": found["n_symbols"]})

    def each(batches):
        now, parts, keys, value = None, [], None, None
        for batch in batches:
            block, is_text = batch.column("block").to_numpy(), np.array(batch.column("is_text").to_pylist(), bool)
            changes = np.flatnonzero((block[1:] != block[:-1]) | (is_text[1:] != is_text[:-1])) + 1
            for at, end in zip([0, *changes.tolist()], [*changes.tolist(), len(block)], strict=True):
                part = batch.slice(at, end - at)
                if block[at] != now:
                    now, parts, keys, value = block[at], [], None, None
                if not is_text[at]:
                    parts.append((part.column("key").to_numpy().copy(), part.column("value").to_numpy().copy()))
                    continue
                if parts:
                    keys, value = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                    parts = []
                yield score(keys, value, part)
        _given_back()

    return rows.mapInArrow(each, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_symbols long")
