"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

Each text's set of word shingles gets a signature of SLOTS 32-bit minima. Two
sets of similarity s agree in a slot with probability s, so that sets of
similarity 0.75 or more differ in over 31 of 48 slots less than once in 10^8
pairs. The join finds *all* pairs that differ in at most DISTANCE slots: the
signature is cut into CHUNKS chunks; by the pigeonhole principle such a pair
has a chunk with at most DISTANCE // CHUNKS differing slots, so every chunk is
indexed once for each choice of slots that may differ. A key stands for 64
bits of the signature, so that sets without a common shingle don't meet in
any number of documents. Links are confirmed on the full sets.

Texts with equal sets form a class, and only classes go on. Buckets of the
index aren't expanded into pairs. A first round compares each member with the
bucket's hub, the member that meets most others in all its buckets: of copies
of a text that is mostly the text. A second round takes only members that the
first round left in different components of a bucket. Their shingles are put in
one order, the rarest first. Two sets that link have so many shingles in common
that the first common one stands near the beginning of both, so that only sets
that share such a beginning's shingle, with enough of both after it, can link.
What makes a copy too different from its hub to link is rare, so that such
copies mostly don't meet. Of those that do, only pairs whose bitmaps allow a
link are compared: bits of shingles' numbers, each flipped by every shingle it
stands for, differ in no more places than the sets do. No pair within the
distance that links is left out.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MIX_1, ROWS, dropped, map_arrow, mixed, signed, small_batches, texts, texts_of, windows, word_numbers, written
from .components import components

SHINGLE, SLOTS, CHUNKS, DISTANCE = 5, 48, 16, 31
#: Shingles that one task holds, 8 bytes each, of the sets compared with one: of a hub's (RIGHT), of those left for the second round (LEFT). A text with more is alone there.
LEFT, RIGHT = 1_000_000, 500_000
#: 64-bit parts of a set's bitmap.
MARKS = 16


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted 64-bit numbers of the distinct runs of size words; the whole text as one run if it has fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(word_numbers(words), min(size, len(words))))


def _seeds(slots: int) -> np.ndarray:
    return mixed(np.arange(1, slots + 1, dtype=np.uint64) * MIX_1)


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """One row of 32-bit minima for each set that isn't empty."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.empty((0, slots), np.uint32)
    flat = np.concatenate(full)
    starts = np.cumsum([0, *(len(s) for s in full[:-1])])
    out = np.empty((len(full), slots), np.uint32)
    for i, seed in enumerate(_seeds(slots)):
        out[:, i] = mixed(np.minimum.reduceat((flat ^ seed) * (seed | np.uint64(1)), starts)) >> np.uint64(32)
    return out


def _key(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def signed_sets(docs: DataFrame, size: int = SHINGLE, slots: int = SLOTS) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (equal for equal sets, null for empty ones), signature."""

    def start():

        def run(batch):
            out = {"n_shingles": [], "set_key": [], "signature": []}
            all_texts = texts(batch)
            for at in range(0, len(all_texts), 1000):
                sets = [shingles(t, size) for t in all_texts[at : at + 1000]]
                rows = iter(signatures(sets, slots))
                out["n_shingles"] += map(len, sets)
                out["set_key"] += [_key(s) if len(s) else None for s in sets]
                out["signature"] += [next(rows).tobytes() if len(s) else None for s in sets]
            kinds = {"n_shingles": pa.int64(), "set_key": pa.binary(), "signature": pa.binary()}
            return {c: batch.column(c) for c in ("doc_id", "text_hash")} | {c: pa.array(v, kinds[c]) for c, v in out.items()}

        return run

    return map_arrow(_with_hash(docs), start, "doc_id long, text_hash long, n_shingles long, set_key binary, signature binary")


def _with_hash(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_hash, which tells rows with the same doc_id, or without one, apart."""
    return texts_of(docs).withColumn("text_hash", F.xxhash64("text"))


def index_keys(signed_rows: DataFrame, slots: int, chunks: int, distance: int) -> DataFrame:
    """key, cls: a row for each chunk and each choice of distance // chunks slots of it that may differ."""
    width, errors = slots // chunks, distance // chunks
    if slots % chunks or width - errors < 1:
        raise ValueError("chunks must have equal widths and keep a slot when the allowed errors are left out")
    kept = [(c * width + np.array(k)) for c in range(chunks) for k in combinations(range(width), width - errors)]
    seeds = mixed(np.arange(1, len(kept) + 1, dtype=np.uint64) * MIX_1)

    def start():
        def run(batch):
            rows = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, slots).astype(np.uint64)
            keys = np.empty((len(rows), len(kept)), np.uint64)
            for i, k in enumerate(kept):
                keys[:, i] = seeds[i]
                for x in k:
                    keys[:, i] = mixed(keys[:, i] * MIX_1 + rows[:, x])
            return {"key": signed(keys.ravel()), "cls": pa.array(np.repeat(batch.column("cls").to_numpy(), len(kept)))}

        return run

    return map_arrow(signed_rows.select("cls", "signature"), start, "key long, cls long")


def _near(pairs: DataFrame, classes: DataFrame, distance: int) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most distance slots."""

    def start():
        def run(batch):
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            ok = pa.array((x != y).sum(1) <= distance)
            return {c: batch.column(c).filter(ok) for c in ("a", "b")}

        return run

    sides = classes.select(F.col("cls").alias("a"), F.col("signature").alias("sa"))
    both = pairs.join(sides, "a").join(sides.withColumnsRenamed({"a": "b", "sa": "sb"}), "b")
    return map_arrow(both.select("a", "b", "sa", "sb"), start, "a long, b long")


def _compared(sides: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links (a, b) between the left and right rows (block, part, cls, is_left) of the same block and part."""
    num, den = share

    def compare(key, frame):
        import pandas as pd

        left, right = frame[frame.is_left], frame[~frame.is_left]
        ls, rs = ([np.frombuffer(x, np.uint64) for x in f.shingles] for f in (left, right))
        if not len(ls) or not len(rs):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        flat, owner = np.concatenate(ls), np.repeat(np.arange(len(ls)), [len(s) for s in ls])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        sizes = np.array([len(s) for s in ls])
        found = ([], [])
        lid, rid = left.cls.to_numpy(), right.cls.to_numpy()
        for j, s in enumerate(rs):
            lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            n = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(ls))
            for i in np.flatnonzero(den * both >= num * (sizes + len(s) - both)):
                if lid[i] != rid[j]:
                    found[0].append(lid[i])
                    found[1].append(rid[j])
        return pd.DataFrame({"a": found[0], "b": found[1]}, dtype="int64")

    return sides.join(sets, "cls").groupBy("block", "part").applyInPandas(compare, "a long, b long")


def _parts(side: DataFrame, most: int, n_shingles: DataFrame) -> DataFrame:
    """side (block, cls) with a column part that deals each block's rows into parts of about most shingles."""
    side = side.join(n_shingles, "cls")
    sized = written(side.groupBy("block").agg(F.ceil(F.sum("n_shingles") / most).alias("n_parts")))
    return side.join(sized, "block").select("block", "cls", F.pmod(F.xxhash64("cls"), F.col("n_parts")).alias("part"))


def _linked(pairs: DataFrame, most: int, n_shingles: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those of the pairs (a, b) that link, written; each a is compared with its b's in parts of about most shingles."""
    right = written(_parts(pairs.select(F.col("a").alias("block"), F.col("b").alias("cls")), most, n_shingles))
    left = right.select("block", "part").distinct().select("block", F.col("block").alias("cls"), "part")
    links = written(_compared(right.withColumn("is_left", F.lit(False)).union(left.withColumn("is_left", F.lit(True))), sets, share))
    dropped(right)
    return links


def _candidates(asked: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of asked (cls, component, asks) that may link: in different components, and one of them asks.

    All sets are put in one order of shingles, the rarest first. A shingle with
    `after` shingles from it on to the set's end can be the first common one of
    a pair only if both sets have as many after it as the link needs. So every
    pair that links is found by its first common shingle. Bitmaps that differ in
    more places than linked sets can rule a pair out.
    """
    num, den = share
    marks = [f"mark{i}" for i in range(MARKS)]

    def start_marks():
        def run(batch):
            odd = np.array([np.bincount(np.frombuffer(x, np.uint64).view(np.int64) & (64 * MARKS - 1), minlength=64 * MARKS) & 1 for x in batch.column("shingles").to_pylist()], np.uint8)
            parts = np.packbits(odd, axis=1).view(np.int64)
            return {"cls": batch.column("cls")} | {m: pa.array(parts[:, i]) for i, m in enumerate(marks)}

        return run

    def start():
        def run(batch):
            found = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
            sizes = [len(x) for x in found]
            return {"shingle": signed(np.concatenate(found)), "cls": pa.array(np.repeat(batch.column("cls").to_numpy(), sizes)), "size": pa.array(np.repeat(np.array(sizes, np.int64), sizes))}

        return run

    these = sets.join(asked, "cls", "left_semi").select("cls", "shingles")
    with small_batches(sets.sparkSession, 200):
        each = written(map_arrow(these, start, "shingle long, cls long, size long"))
        marked = written(map_arrow(these, start_marks, f"cls long, {' long, '.join(marks)} long").join(asked, "cls"))
    shared = written(each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"))
    from_end = Window.partitionBy("cls").orderBy(F.desc("n"), "shingle")
    ranked = each.join(shared, "shingle").withColumn("after", F.row_number().over(from_end).cast("long")).where(F.col("after") * den >= F.col("size") * num)
    firsts = written(ranked.drop("n").join(marked, "cls"))
    dropped(each, shared, marked)
    smaller = firsts.where(F.col("after") * (num + den) >= F.col("size") * (2 * num)).select("shingle", *(F.col(c).alias(f"{c}_b") for c in ("cls", "size", "after", "component", "asks", *marks)))
    larger = (F.col("size") > F.col("size_b")) | (F.col("size") == F.col("size_b")) & (F.col("cls") > F.col("cls_b"))
    enough = F.least("after", "after_b") * (num + den) >= (F.col("size") + F.col("size_b")) * num
    apart = (F.col("component") != F.col("component_b")) & (F.col("asks") | F.col("asks_b"))
    differing = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"{m}_b"))) for m in marks), F.lit(0))
    alike = differing * (num + den) <= (F.col("size") + F.col("size_b")) * (den - num)
    return firsts.join(smaller, "shingle").where(larger & enough & apart & alike).select(F.col("cls").alias("a"), F.col("cls_b").alias("b")).distinct()


def classes_of(rows: DataFrame) -> DataFrame:
    """cls, set_key, n_shingles, signature, least (doc_id), source (a row with that set): a row for each set that rows have."""
    source = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("source")
    each = rows.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("least"), source, F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    return written(each.withColumn("cls", F.monotonically_increasing_id()))


def _of_repeated_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes of rows with the same doc_id: they are one document."""
    ids = written(rows.groupBy("doc_id").agg(F.min("set_key").alias("one"), F.max("set_key").alias("other")).where("doc_id is not null and one <> other").select("doc_id", "one"))
    ends = rows.join(ids, "doc_id").where("set_key <> one").select("one", F.col("set_key").alias("other")).distinct()
    named = classes.select(F.col("set_key"), "cls")
    for c, name in (("one", "a"), ("other", "b")):
        ends = ends.join(named.withColumnsRenamed({"set_key": c, "cls": name}), c)
    return ends.select("a", "b")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, share: tuple[int, int] = (75, 100), slots: int = SLOTS, chunks: int = CHUNKS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents are linked if share[1] * |A ∩ B| >= share[0] * |A ∪ B| for their
    shingle sets. Null and empty texts have no set and link with nothing; a
    text with fewer words than size is one shingle. Rows that repeat a doc_id
    are one document: what links with one of its texts links with it, and all
    its rows that have a set get the same component. Rows without a doc_id link
    by their texts; component_id and kept are null where no linked row has
    one. Other columns are ignored.
    """
    rows = written(signed_sets(docs, size, slots), ROWS)
    classes = classes_of(rows)
    keys = index_keys(classes, slots, chunks, distance)
    # Written, so that the joins have shuffles of their own on both sides and a very common key can be split.
    sized = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = written(keys.join(sized, "key"))
    dropped(sized)
    weights = members.groupBy("cls").agg(F.sum("n").alias("weight"))
    hubs = written(members.join(weights, "cls").groupBy("key").agg(F.max(F.struct("weight", "cls")).alias("hub")))

    first = members.join(hubs, "key").where("cls <> hub.cls").select(F.col("hub.cls").alias("a"), F.col("cls").alias("b")).distinct()
    first = written(_near(first, classes, distance))
    wide = members.where("n > 2").join(hubs, "key").where("cls <> hub.cls").select("cls").distinct()
    wanted = first.select(F.col("a").alias("cls")).union(first.select("b")).union(wide).distinct()
    sets = written(_sets(docs, classes.join(wanted, "cls", "left_semi"), size), ROWS)

    n_shingles = classes.select("cls", "n_shingles")
    links = _linked(first, RIGHT, n_shingles, sets, share)
    groups = written(components(links.union(_of_repeated_ids(rows, classes))))
    dropped(first, links)

    # Second round: where a bucket's members besides its hub are still in different components.
    known = members.where("n > 2").join(hubs, "key").where("cls <> hub.cls").join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("component"))
    known = written(known)
    dropped(members, hubs)
    each = known.groupBy("key", "component").agg(F.count("*").alias("m"))
    split = written(each.groupBy("key").agg(F.count("*").alias("k"), F.max_by("component", F.struct("m", "component")).alias("most")).where("k > 1").select("key", "most"))
    if not split.isEmpty():
        asked = known.join(split, "key").groupBy("cls").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("most")).alias("asks"))
        asked = written(asked)
        pairs = written(_candidates(asked, sets, share))
        more = _linked(pairs, LEFT, n_shingles, sets, share)
        # The links' ends are components by now.
        ends = more
        for c in "ab":
            ends = ends.join(groups.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
        merged = written(components(ends.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))))
        dropped(asked, pairs, more)
        grown = classes.select(F.col("cls").alias("node")).join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        groups = grown.join(merged.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    dropped(sets, known)

    by_class = classes.select("set_key", "least", F.col("cls").alias("node")).join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by_class = written(by_class)
    least = by_class.groupBy("component").agg(F.min("least").alias("found"))
    found = by_class.join(least, "component").select("set_key", "found")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("found"))
    return rows.join(found, "set_key", "left").select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """cls, shingles for the wanted classes: each set's sorted numbers, 8 bytes each."""

    def start():

        def run(batch):
            found = [shingles(t, size) for t in texts(batch)]
            return {"set_key": pa.array([_key(s) if len(s) else None for s in found], pa.binary()), "wanted_key": batch.column("wanted_key"), "cls": batch.column("cls"), "shingles": pa.array([s.tobytes() for s in found], pa.binary())}

        return run

    sources = wanted.select("cls", F.col("set_key").alias("wanted_key"), F.col("source.doc_id").alias("of_id"), F.col("source.text_hash").alias("of_hash"))
    rows = _with_hash(docs).join(sources, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")))
    # Rows with the same id and text give the same set.
    read = map_arrow(rows.select("text", "wanted_key", "cls"), start, "set_key binary, wanted_key binary, cls long, shingles binary").where("set_key = wanted_key")
    return read.groupBy("cls").agg(F.first("shingles").alias("shingles"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """docs without the documents that aren't their component's least doc_id; the same columns.

    Of rows that repeat a doc_id, the one with the least hash of its text stays,
    then the one whose other columns come first as JSON. Rows without a doc_id
    all stay.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi")
    twice = written(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("of_id")).agg(F.count("*").alias("n_rows")).where("n_rows > 1").select("of_id"))
    if not twice.isEmpty():
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        key = F.struct(F.xxhash64("text"), F.to_json(F.struct(*others)) if others else F.lit(""))
        repeated = F.col("doc_id") == F.col("of_id")
        least = rows.join(twice, repeated, "left_semi").groupBy(F.col("doc_id").alias("of_id")).agg(F.min_by(F.struct(*docs.columns), key).alias("row")).select("row.*")
        rows = rows.join(twice, repeated, "left_anti").unionByName(least)
    return rows.unionByName(docs.where("doc_id is null"))
