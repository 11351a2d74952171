"""Operators on words and bytes against brute force: near copies, passages, PPM, BPE."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from pagewright.llm import bpe, neardup, ppm, substrings
from pagewright.llm import components as module
from pagewright.llm.common import written
from pagewright.llm.components import components

VOCABULARY = P.path("byte_bpe_50k.tiktoken")


def prose(r, n, words=300):
    return " ".join(f"w{r.randint(0, words)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Random texts with exact copies, near copies, shared passages, repeats inside a text, empty, null and one very long text."""
    r = random.Random(7)
    base = [prose(r, r.randint(3, 120)) for _ in range(60)]
    passage = prose(r, 60)
    out = list(base)
    for t in base[:20]:
        w = t.split()
        for k in r.sample(range(len(w)), min(len(w), r.randint(0, 4))):
            w[k] = f"new{r.randint(0, 99)}"
        out += [" ".join(w), t.upper() if r.random() < 0.3 else t]
    out += [prose(r, 20) + " " + passage + " " + prose(r, 15) for _ in range(4)]
    out += [passage + " " + passage, "a b c " * 40, "same " * 36, "", None, "   ", "one", "One", "é ü \u00a0 ñ", prose(r, 4000) + " " + passage]
    return out


def frame(spark, texts):
    """Documents with columns whose names clash with the operators' own."""
    rows = [(i, t, "x", i, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_shingles string, anchors int, block string")


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, set_key string")


def shingle_sets(texts):
    out = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def linked(rows):
    """component of each row's (doc_id, place) by comparing all pairs; rows of one doc_id that have a set are one document."""
    sets, parent = shingle_sets([t for _, t in rows]), {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    node = {k: ("row", k) if rows[k][0] is None else rows[k][0] for k in sets if sets[k]}
    for a in node:
        for b in node:
            both = len(sets[a] & sets[b])
            if b < a and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(node[a]), top(node[b])
                parent[x] = y
    members = defaultdict(list)
    for k in node:
        if rows[k][0] is not None:
            members[top(node[k])].append(rows[k][0])
    least = {t: min(m) for t, m in members.items()}
    return [(i, len(sets[k]), least.get(top(node[k])) if k in node else i) for k, (i, _) in enumerate(rows)]


def check_near(spark, rows):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(rows_of(spark, rows)).collect())
    assert got == Counter((i, n, c, None if c is None or i is None else c == i) for i, n, c in linked(rows))


def test_near_duplicates(spark, texts):
    check_near(spark, list(enumerate(texts)))


def test_near_duplicates_with_repeated_and_null_ids(spark, texts):
    """A document with two texts joins what links with either, in any order of the rows."""
    r = random.Random(11)
    a, b = prose(r, 40, 10_000), prose(r, 40, 10_000)
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, a), (4, "other text"), (None, a), (None, b + " y"), (None, "alone"), (5, "other text"), (6, None), (6, a), (7, None), (7, "")]
    for _ in range(2):
        check_near(spark, rows)
        rows = rows[::-1]
    check_near(spark, [(i // 3, t) for i, t in enumerate(texts)])


def hot_group(n):
    """Many near copies of one text, most of which don't link with each other."""
    r, rows = random.Random(3), []
    base = prose(r, 60, 10_000).split()
    for _ in range(n):
        w = list(base)
        for k in r.sample(range(60), r.choice([0, 1, 2, 3, 5, 8])):
            w[k] = f"z{r.randint(0, 10**6)}"
        rows.append(" ".join(w))
    return rows


def test_near_duplicates_of_a_hot_group(spark):
    check_near(spark, list(enumerate(hot_group(300))))


def test_a_group_of_thousands_is_compared_in_parts(spark, monkeypatch):
    """Parts of few shingles give the same components as one."""
    docs = frame(spark, hot_group(3000))
    one = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    monkeypatch.setattr(neardup, "LEFT", 5000)
    monkeypatch.setattr(neardup, "RIGHT", 3000)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == one and 1 < len(set(one.values())) < 2000


def lone_copies(n):
    """Near copies of one text, which isn't among them; only every tenth has a copy that links with it."""
    r, rows = random.Random(13), []
    base = prose(r, 100, 10_000).split()
    for i in range(n):
        w = list(base)
        for k in r.sample(range(100), r.choice([2, 3, 4])):
            w[k] = f"z{r.randint(0, 10**9)}"
        rows.append(" ".join(w))
        if i % 10 == 0:
            w[r.randint(0, 99)] = f"z{r.randint(0, 10**9)}"
            rows.append(" ".join(w))
    return rows


def test_copies_that_do_not_link_are_not_compared_in_pairs(spark, monkeypatch):
    """The second round compares about as many pairs as link, not all pairs of a group."""
    rounds, compared = [], neardup._compared

    def counted(sides, *more):
        rounds.append(Counter((r.block, r.part, r.is_left) for r in sides.collect()))
        return compared(sides, *more)

    monkeypatch.setattr(neardup, "_compared", counted)
    rows = list(enumerate(lone_copies(300)))
    check_near(spark, rows)
    first, second = (sum(n * sides[block, part, False] for (block, part, is_left), n in sides.items() if is_left) for sides in rounds)
    assert second < len(rows)


def test_bitmaps_and_beginnings_keep_every_link(spark):
    """All linked pairs of random sets of any size are candidates, those at the threshold included."""
    r = random.Random(17)
    numbers = [r.getrandbits(63) for _ in range(4000)]
    found = []
    for _ in range(150):
        one = set(r.sample(numbers, r.choice([1, 2, 3, 7, 14, 35, 70, 400, 2000])))
        # Of 7 k numbers 6 k are kept and k are new: 6 k of 8 k are in both.
        gone = set(r.sample(sorted(one), r.choice([len(one) // 7, len(one) // 8, len(one) // 5, 0])))
        found += [one, one - gone, one - gone | set(r.sample(numbers, len(gone)))]
    sets = spark.createDataFrame([(i, bytearray(np.array(sorted(x), np.uint64).tobytes())) for i, x in enumerate(found)], "cls long, shingles binary")
    asked = spark.createDataFrame([(i, i, i % 2 == 0) for i in range(len(found))], "cls long, component long, asks boolean")
    got = {frozenset(p) for p in neardup._candidates(asked, sets, (75, 100)).collect()}
    links = {frozenset((a, b)) for a in range(len(found)) for b in range(a) if (a % 2 == 0 or b % 2 == 0) and 100 * len(found[a] & found[b]) >= 75 * len(found[a] | found[b])}
    assert len(links) > 150 and any(4 * len(found[a] & found[b]) == 3 * len(found[a] | found[b]) for a, b in links) and links <= got


def test_near_duplicates_of_nothing(spark):
    empty = frame(spark, ["x"]).where("false")
    assert neardup.near_duplicates(empty).count() == 0 and neardup.without_near_copies(empty).count() == 0
    assert [r.kept for r in neardup.near_duplicates(frame(spark, [None, ""])).collect()] == [True, True]


def test_without_near_copies_keeps_columns(spark):
    docs = frame(spark, ["a b c d e f g h", "a b c d e f g h", "other words here", None])
    out = neardup.without_near_copies(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 2, 3]


def test_pigeonhole_finds_all_pairs_within_distance(spark):
    """Signatures at every distance up to the threshold meet in the index."""
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 32, neardup.SLOTS, dtype=np.uint32)
    rows = [(0, bytearray(base.tobytes()))]
    for k in range(1, 60):
        s = base.copy()
        at = r.choice(neardup.SLOTS, min(neardup.DISTANCE, k), replace=False)
        s[at] ^= np.uint32(1) + r.integers(0, 1 << 31, len(at), dtype=np.uint32)
        rows.append((k, bytearray(s.tobytes())))
    df = spark.createDataFrame(rows, "cls long, signature binary")
    keys = neardup.index_keys(df, neardup.SLOTS, neardup.CHUNKS, neardup.DISTANCE)
    met = keys.join(keys.where("cls = 0").select("key"), "key").select("cls").distinct().count()
    assert met == 60


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in parent}


def test_components_of_a_chain_take_logarithmic_rounds(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(module, "written", lambda df: tables.append(1) or written(df))
    got = components(spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r.component for r in got.collect()} == {0} and got.count() == 1001
    assert len(tables) <= 1 + 2 * 16 + 4  # two a round


def cut(texts, window=35):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("window, short", [(35, 8), (6, 3)])
def test_substring_dedup(spark, texts, window, short):
    got = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept_sha256)) for r in substrings.without_repeats(frame(spark, texts), window, short).collect()}
    assert got == {i: (n, k, hashlib.sha256(t).digest()) for i, (n, k, t) in enumerate(cut(texts, window))}


def test_substring_dedup_with_repeated_and_null_ids(spark):
    """Every row is a text of its own, in any order of the rows."""
    r = random.Random(12)
    a, b = prose(r, 40, 10_000), prose(r, 40, 10_000)
    rows = [(1, a), (1, b), (2, f"x {a} y"), (3, f"x2 {b} y2"), (4, a + " z"), (4, a + " z"), (None, b), (None, "alone " + prose(r, 50, 10_000)), (5, None), (5, f"p {b}")]
    for _ in range(2):
        got = Counter((x.doc_id, x.n_words, x.n_removed, bytes(x.kept_sha256)) for x in substrings.without_repeats(rows_of(spark, rows)).collect())
        want = cut([t for _, t in rows])
        assert got == Counter((i, n, k, hashlib.sha256(t).digest()) for (i, _), (n, k, t) in zip(rows, want, strict=True))
        out = Counter((x.doc_id, x.text) for x in substrings.deduplicated(rows_of(spark, rows)).collect())
        assert out == Counter((i, kept.decode() if k else t) for (i, t), (_, k, kept) in zip(rows, want, strict=True))
        rows = rows[::-1]


def test_deduplicated_texts(spark, texts):
    docs = frame(spark, texts).withColumn("n_chars", F.length("text"))
    out = substrings.deduplicated(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and len(got) == len(texts)
    for i, (_, k, kept) in enumerate(cut(texts)):
        assert got[i].text == (kept.decode() if k else texts[i]) and (got[i].text is None or got[i].n_chars == len(got[i].text))
    assert substrings.deduplicated(docs.where("false")).count() == 0


class Ppm:
    """The model spelt out with dictionaries."""

    def __init__(self, training, order):
        self.order, self.seen = order, defaultdict(Counter)
        for t in training:
            s = [ppm.BEFORE] * order + list(t) + [ppm.END]
            for k in range(order, len(s)):
                for n in range(order + 1):
                    self.seen[tuple(s[k - n : k])][s[k]] += 1

    def cost(self, context, symbol):
        out, left_out = 0.0, set()
        for n in range(self.order, -1, -1):
            found = {s: c for s, c in self.seen.get(tuple(context[self.order - n :]), {}).items() if s not in left_out}
            if not found:
                continue
            total = sum(found.values())
            if symbol in found:
                return out + math.log10((2 * found[symbol] - 1) / (2 * total))
            out += math.log10(len(found) / (2 * total))
            left_out |= set(self.seen[tuple(context[self.order - n :])])
        return out + math.log10(1 / (ppm.SYMBOLS - len(self.seen.get((), {}))))

    def score(self, text):
        s = [ppm.BEFORE] * self.order + list(text) + [ppm.END]
        return sum(self.cost(s[k - self.order : k], s[k]) for k in range(self.order, len(s)))


def test_ppm_equals_the_model_spelt_out(spark):
    r = random.Random(2)
    rows = [prose(r, r.randint(0, 30), 20) for _ in range(25)] + ["", None, "éèé zz", "aaaaaaaa", "w1 w2", "w1 w2"]
    docs = frame(spark, rows)
    learns = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    for order in (2, 5):
        model = Ppm([(t or "").encode() for i, t in enumerate(rows) if learns(i)], order)
        got = {x.doc_id: x for x in ppm.scored(docs, ~F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 7) = 2"), order, block_bytes=300).collect()}
        for i, t in enumerate(rows):
            assert got[i].score == pytest.approx(model.score((t or "").encode()), rel=1e-11, abs=1e-9)
    counts = Counter(w for i, t in enumerate(rows) if learns(i) for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(rows):
        words = [*(t or "").encode().lower().split(), None]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words), sum(w in counts for w in words), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel=1e-11, abs=1e-9)


@pytest.mark.parametrize("at_a_time", [1, 7, 10_000])
def test_counts_are_merged_range_by_range(monkeypatch, at_a_time):
    monkeypatch.setattr(ppm, "MERGED", at_a_time)
    r = random.Random(17)
    want, parts = Counter(), []
    for size in (0, 1, 40, 300, 300):
        mine = {r.randint(-200, 200): r.randint(0, 9) for _ in range(size)}
        want.update(mine)
        parts.append((np.array(sorted(mine), np.int64), np.array([mine[k] for k in sorted(mine)], np.int32)))
    keys, n = ppm._merged(parts)
    assert keys.tolist() == sorted({int(k) for p in parts for k in p[0]})
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == {int(k): want[int(k)] for p in parts for k in p[0]}
    assert all(len(x) == 0 for x in ppm._merged(parts[:1]))


def test_ppm_of_a_long_text_is_exact(spark):
    """A text of a million bytes, repeated and null ids, and columns with clashing names."""
    r = random.Random(21)
    rows = [(1, prose(r, 220_000)), (1, prose(r, 30)), (1, prose(r, 30)), (None, "w1 w2"), (None, None), (2, "w3 w4"), (2, "w3 w4")]
    model = Ppm([(t or "").encode() for i, t in rows if i != 1], 2)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, block string, value string")
    got = sorted((x.n_symbols, x.score) for x in ppm.scored(docs, F.expr("doc_id is null or doc_id <> 1"), 2).collect())
    want = sorted((len((t or "").encode()) + 1, model.score((t or "").encode())) for _, t in rows)
    assert len(rows[0][1]) > 900_000 and [g[0] for g in got] == [w[0] for w in want] and all(g[1] == pytest.approx(w[1], rel=1e-11) for g, w in zip(got, want, strict=True))


def test_ppm_probabilities_sum_to_one(spark):
    model = Ppm([b"abab", b"abc"], 2)
    for context in ([ppm.BEFORE, ppm.BEFORE], [97, 98], [122, 122]):
        assert sum(10 ** model.cost(context, s) for s in range(ppm.SYMBOLS)) == pytest.approx(1)


def test_ppm_without_training_or_rows(spark):
    docs = frame(spark, ["ab", None])
    got = {r.doc_id: r for r in ppm.scored(docs, F.lit(False)).collect()}
    assert got[0].score == pytest.approx(-3 * math.log10(257)) and got[1].score == pytest.approx(-math.log10(257)) and got[0].train_tokens == 0
    assert ppm.scored(docs.where("false"), F.lit(True)).count() == 0


def test_bpe_equals_the_library(spark):
    ranks = bpe.ranks_of(open(VOCABULARY, "rb").read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    rows = ["".join(r.choice(" \n\t\u3000\x85aBéẞsl.1२!'日<|>") for _ in range(r.randint(0, 60))) for _ in range(200)]
    rows += ["", None, "  x  ", "<|endoftext|> it's we'll", "a" * 3000, "lorem ipsum " * 500, "b" * 900 + "ab" * 60, "tail \n ", "\x1f\x1c a\x00b"]
    docs = frame(spark, rows)
    ids = {x.doc_id: x.ids for x in bpe.encode(docs, VOCABULARY, P.PATTERN).collect()}
    assert all(ids[i] == library.encode_ordinary(t or "") for i, t in enumerate(rows))
    back = {x.doc_id: bytes(x.decoded).decode() for x in bpe.decode(bpe.encode(docs, VOCABULARY, P.PATTERN), VOCABULARY).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(rows))
    for x in bpe.digests(docs, VOCABULARY, P.PATTERN).collect():
        t = rows[x.doc_id] or ""
        want = library.encode_ordinary(t)
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert bpe.digests(docs.where("false"), VOCABULARY, P.PATTERN).count() == 0
    twice = docs.union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert Counter(x.ids_sha256 for x in bpe.digests(twice, VOCABULARY, P.PATTERN).collect()) == Counter({k: 2 * n for k, n in Counter(x.ids_sha256 for x in bpe.digests(docs, VOCABULARY, P.PATTERN).collect()).items()})


@pytest.mark.parametrize("word", [b" the", b"zqxj vk", b"a" * 2000])
def test_a_wrong_id_shows_in_the_decoded_bytes(word):
    """Words that are tokens, that aren't, and long ones are all decoded from their ids."""
    ranks = bpe.ranks_of(open(VOCABULARY, "rb").read())
    encoder = bpe.Encoder(ranks)
    ((_, ids, text),) = encoder.encode([word])
    assert text == word
    first = np.frombuffer(ids, "<u4")[0]
    other = next(t for t, n in ranks.items() if n != first and len(t) == len(encoder.tokens[first]))
    encoder.tokens[first] = other
    encoder.db.execute("UPDATE vocabulary SET bytes = ? WHERE id = ?", [other, int(first)])
    ((_, again, text),) = encoder.encode([word])
    assert again == ids and text != word
