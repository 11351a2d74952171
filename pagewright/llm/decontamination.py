"""Benchmark decontamination by template windows.

Words become templates: numbers, names and units are replaced by placeholders
of their type, and other words are lower-cased without the marks around them.
Runs with names are also read with the names as plain words.
Every run of WINDOW templates of a benchmark item is a key; a document's runs
meet them in a hash join. A run must also agree in its slots: the places that
hold equal values in the item hold equal values in the document, so that a
question with other numbers and names is caught and a chance meeting isn't.
Items of fewer than SHORTEST words say too little as templates; they match by
their words alone.
Matches at one offset of document and item are taken together: over all of
them each value of the item must stand for one value of the document and the
other way round.

Before the join, a document's runs pass a bitmap of the benchmark's keys. It
has BITMAP bits whatever the benchmark's size, and only saves work.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS, map_arrow, mixed, windows, written

#: Templates in a run, fewest templates of an item that can match by them, and templates that a match must cover (or the whole item).
WINDOW, SHORTEST, COVER = 8, 5, 13
#: Words in a run, in eighths, that mustn't be placeholders; a run with fewer is dense and matches by its values or beside another run.
PLAIN_EIGHTHS = 4
BITMAP = 1 << 24

# Units that stand for a placeholder of their own.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec min h hr hrs hour hours day days week weeks month months year years mph kmh km/h hz khz mhz ghz v w kw mw kwh j kj cal kcal pa kpa bar k c f usd eur gbp dollar dollars euro euros cent cents percent meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres second seconds minute minutes degree degrees".split())

_MARKS = "\"'`.,;:!?()[]{}<>«»“”‘’„…*_~|/\\#&%$€£+=-–—"
_NUMBER = re.compile(r"[$€£+\-]?\d[\d.,:/%\-]*\Z")
_NUMBER_UNIT = re.compile(r"([$€£+\-]?\d[\d.,]*)([^\W\d_]+)\Z")
_ENDS, _CLOSERS = frozenset(".!?…:"), "'\")]»”"

PLAIN, NUMBER, UNIT, NAME = 0, 1, 2, 3
_TYPE = mixed(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


ENDS, CAPITAL, EMPTY = 8, 16, 32


class Words(dict):
    """What each word stands for: its number here leads to a template, a value and flags (type, sentence end, capital, marks only). Up to REMEMBERED words are kept."""

    REMEMBERED = 600_000

    def __init__(self):
        super().__init__()
        self.templates: list[int] = []
        self.values: list[int] = []
        self.flags: list[int] = []
        self.arrays = tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.uint8))

    def __missing__(self, word: str) -> int:
        core = word.strip(_MARKS)
        flags = ENDS if word.rstrip(_CLOSERS)[-1:] in _ENDS else 0
        if not core:
            template = value = 0
            flags |= EMPTY
        else:
            low = core.lower()
            template = value = xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass"))
            if core[0].isdigit() and (_NUMBER.match(core) or _NUMBER_UNIT.match(core)):
                template, flags = int(_TYPE[NUMBER]), flags | NUMBER
            elif low in UNITS:
                template, flags = int(_TYPE[UNIT]), flags | UNIT
            elif core[0].isupper() and core[1:].islower():
                flags |= CAPITAL
        n = self[word] = len(self.flags)
        self.templates.append(template)
        self.values.append(value)
        self.flags.append(flags)
        return n

    def of(self, each: list[list[str]]):
        """Of several texts' words that have more than marks: templates; templates with names as plain words; all values, and where each word's is; types; plain words with a capital; and texts' numbers."""
        if len(self) > self.REMEMBERED:
            self.clear()
            self.__init__()
        sizes = np.array([len(ws) for ws in each], np.int64)
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(each)), np.int32, int(sizes.sum()))
        known = len(self.arrays[2])
        if known < len(self.flags):
            new = (np.array(x[known:], a.dtype) for x, a in zip((self.templates, self.values, self.flags), self.arrays, strict=True))
            self.arrays = tuple(np.concatenate(p) for p in zip(self.arrays, new, strict=True))
        templates, values, flags = self.arrays
        flags = flags[at]
        owner = np.repeat(np.arange(len(each), dtype=np.int32), sizes)
        begins = np.ones(len(at), bool)
        begins[1:] = (flags[:-1] & ENDS > 0) | (owner[1:] != owner[:-1])
        name = (flags & CAPITAL > 0) & ~begins
        kind = flags & 3
        kind[name] = NAME
        folded = templates[at]
        template = folded.copy() if name.any() else folded
        template[name] = _TYPE[NAME]
        capital = (flags & CAPITAL > 0) & begins
        empty = flags & EMPTY > 0
        if empty.any():
            keep = ~empty
            return template[keep], folded[keep], values, at[keep], kind[keep], capital[keep], owner[keep]
        return template, folded, values, at, kind, capital, owner


def _pattern(values: np.ndarray) -> bytes:
    """Which of the slots hold equal values: each slot's first equal one."""
    seen: dict[int, int] = {}
    return bytes([seen.setdefault(v, i % 256) for i, v in enumerate(values.tolist())])


def _runs(rows: DataFrame, key: str, sizes: list[int] | None, bitmap: np.ndarray | None) -> DataFrame:
    """key, n, size, window, place, pattern, slots, dense, fixed, same_first for the runs of each text; sizes None: of the size that the text itself asks for.

    Runs with names are read twice, with placeholders for them and as plain
    words (fixed has these names), so that letter case and where a sentence
    starts can't hide a copy. With sizes None a plain first word with a capital
    is also read as a name: as it may be anything but a name, it must be the
    same in the document (same_first), unless it is a name further on. Runs of
    fewer than SHORTEST words are read as values only: all of their words are
    slots, and equal values are needed. A single word is read only where it is
    the whole text.
    """
    shared = None if bitmap is None else rows.sparkSession.sparkContext.broadcast(bitmap)
    kinds = {key: pa.int64(), "n": pa.int32(), "size": pa.int32(), "window": pa.int64(), "place": pa.int32(), "pattern": pa.binary(), "slots": pa.list_(pa.int64()), "dense": pa.bool_(), "fixed": pa.list_(pa.int64()), "same_first": pa.bool_()}

    def start():
        words = Words()

        def run(batch):
            out = {k: [] for k in kinds}
            ids, all_texts = batch.column(key).to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(ids), 1000):
                template, folded, values, word, kind, capital, owner = words.of([(t or "").split() for t in all_texts[at : at + 1000]])
                counts = np.bincount(owner, minlength=len(ids[at : at + 1000]))
                first = np.cumsum(counts) - counts
                names = kind == NAME
                names_in = np.cumsum(np.r_[0, names])
                readings = [(template, kind, False, None)]
                if names_in[-1]:
                    readings.append((folded, np.where(names, PLAIN, kind), True, None))
                starts = first[counts > 0]
                starts = starts[capital[starts]] if sizes is None else starts[:0]
                if len(starts):
                    as_name, name_kind = template.copy(), kind.copy()
                    as_name[starts], name_kind[starts] = _TYPE[NAME], NAME
                    readings.append((as_name, name_kind, False, starts))
                for size in sizes or sorted(set(np.minimum(counts, WINDOW).tolist())):
                    if not size or len(template) < size:
                        continue
                    short = size < SHORTEST
                    for read, types, as_words, only in [(values[word], np.full(len(kind), NAME, np.uint8), False, None)] if short else readings:
                        found = windows(read, size)
                        ok = owner[size - 1 :] == owner[: len(found)]
                        if sizes is None:
                            ok &= np.minimum(counts, WINDOW)[owner[: len(found)]] == size
                        if size == 1:
                            ok &= counts[owner] == 1
                        if as_words:
                            ok &= names_in[size:] > names_in[:-size]
                        if only is not None:
                            ok &= np.isin(np.arange(len(found)), only)
                        if shared is not None:
                            bit = found % np.uint64(BITMAP)
                            ok &= (shared.value[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) > 0
                        for k in np.flatnonzero(ok).tolist():
                            here, doc = values[word[k : k + size]], int(owner[k])
                            slot = types[k : k + size] != PLAIN
                            mine = here[slot]
                            dense = int(slot.sum()) * 8 > size * (8 - PLAIN_EIGHTHS)
                            fixed = here[names[k : k + size]] if as_words else here[:0]
                            all_mine = slice(k, k + int(counts[doc]))
                            same_first = only is not None and not bool((names[all_mine] & (values[word[all_mine]] == here[0])).any())
                            for name, v in ((key, ids[at + doc]), ("n", int(counts[doc])), ("size", size), ("window", int(found[k : k + 1].view(np.int64)[0])), ("place", k - int(first[doc])), ("pattern", _pattern(mine)), ("slots", mine.view(np.int64).tolist()), ("dense", dense), ("fixed", fixed.view(np.int64).tolist()), ("same_first", same_first)):
                                out[name].append(v)
            return {k: pa.array(v, kinds[k]) for k, v in out.items()}

        return run

    return map_arrow(rows.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text")), start, f"{key} long, n int, size int, window long, place int, pattern binary, slots array<long>, dense boolean, fixed array<long>, same_first boolean")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, n_slots, reparameterised for each document and benchmark item that match.

    A match covers COVER words of the item or all of them: the union of the
    runs that match at one offset, adjacent or not. Runs that are mostly
    placeholders match with equal values; with others they count only where a
    run that isn't matches at the same offset. Names also match as plain words
    in any letter case. n_windows counts the
    matching runs at the best offset, n_slots the distinct values there;
    reparameterised says that some value differs. Items of
    fewer than SHORTEST words match where these words stand in their order in
    any letter case, an item of one word only a text that is this word. Null
    and empty texts match nothing. Rows that repeat an id count once for each
    pair. Other columns are ignored.
    """
    items = written(_runs(benchmark, "item_id", None, None))
    words = items.select(F.col("window").bitwiseAND(F.lit(BITMAP - 1)).alias("bit")).select(F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    bitmap = np.zeros(BITMAP // 64, np.int64)
    for r in words.toLocalIterator():  # at most BITMAP / 64 rows
        bitmap[r["word"]] = r["mask"]
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most WINDOW values
    if not sizes:
        return items.selectExpr("item_id as doc_id", "item_id", "cast(0 as long) as n_windows", "cast(0 as long) as n_slots", "false as reparameterised").where("false")
    by_values = F.when(F.col("dense"), F.xxhash64("slots")).otherwise(F.lit(0)).alias("by_values")
    runs = written(_runs(docs, "doc_id", sizes, bitmap.view(np.uint64)).drop("fixed", "same_first").select("*", by_values), ROWS)
    wanted = items.select("item_id", F.col("n").alias("item_n"), "size", "window", F.col("place").alias("item_place"), F.col("pattern").alias("item_pattern"), F.col("slots").alias("item_slots"), F.col("dense").alias("item_dense"), "fixed", "same_first", by_values)
    group = ["doc_id", "item_id", "offset"]
    found = [*group, "item_n", "size", "item_place", "item_slots", "slots", "dense", "fixed"]
    fits = "pattern = item_pattern and (not same_first or slots[0] = item_slots[0])"
    met = runs.join(wanted, ["window", "size", "by_values"]).where(f"{fits} and (not dense or slots = item_slots)").withColumn("offset", F.col("place") - F.col("item_place")).select(found)
    # Dense runs with other values count where a run that isn't dense matches at the same offset; they are looked up by their places.
    beside = met.where("not dense").select(group).distinct().join(wanted.where("item_dense").drop("by_values"), "item_id").withColumn("place", F.col("offset") + F.col("item_place"))
    beside = beside.join(runs.where("dense").drop("n", "by_values"), ["doc_id", "place", "size", "window"]).where(fits).select(found)
    met = met.union(beside).distinct()
    pairs = F.array_distinct(F.flatten(F.collect_list(F.concat(F.arrays_zip("item_slots", "slots"), F.transform("fixed", lambda v: F.struct(v.alias("item_slots"), v.alias("slots")))))))
    each = met.groupBy(*group).agg(F.first("item_n").alias("item_n"), F.first("size").alias("size"), F.sort_array(F.collect_set("item_place")).alias("places"), pairs.alias("pairs")).withColumn("n_windows", F.size("places").cast("long"))
    covered = F.expr("size + aggregate(zip_with(slice(places, 2, size(places)), slice(places, 1, size(places) - 1), (b, a) -> least(size, b - a)), 0, (n, x) -> n + x)")
    distinct = lambda name: F.size(F.array_distinct(F.col(f"pairs.{name}")))
    consistent = (distinct("item_slots") == F.size("pairs")) & (distinct("slots") == F.size("pairs"))
    enough = covered >= F.least(F.lit(COVER), F.col("item_n"))
    good = each.where(consistent & enough).withColumn("differ", F.exists("pairs", lambda p: p["item_slots"] != p["slots"]))
    best = F.max(F.struct("n_windows", F.size("pairs").cast("long").alias("n_slots"), (~F.col("differ")).alias("same")))
    return good.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.n_windows", "b.n_slots", (~F.col("b.same")).alias("reparameterised"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that match a benchmark item; the same columns."""
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")
