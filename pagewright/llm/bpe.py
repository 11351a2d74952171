"""Byte-level BPE by recursive DuckDB queries in each partition.

A partition's distinct words become lists of tokens, one a byte. A recursive
query unnests them to rows (word, place, token, following token), joins these
with the merge table and contracts each word's leftmost pair of least rank,
until no word has such a pair left.
Ordered aggregation gives a word's ids, and its bytes again from the ids.
Documents are then put together from their words.

A word of over LONG_WORD bytes would take as many rounds as it has bytes; it
gets the same contractions from a heap of its pairs instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices, texts_of, trimmed

LONG_WORD = 1000
#: Text taken at a time, and words that are remembered; both bound a task's memory.
BATCH_CHARS, REMEMBERED = 6_000_000, 800_000
#: Words in one recursive query.
QUERY_WORDS = 50_000

# The characters that \s stands for in the tokenizers' patterns.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

ENCODE = """
WITH RECURSIVE t(w, toks, done) AS (
  SELECT w, toks, false FROM start_words
  UNION ALL
  SELECT t.w,
    CASE WHEN b.least IS NULL THEN t.toks ELSE t.toks[1:(b.least & 1048575) - 1] || [CAST(b.least >> 20 AS INTEGER)] || t.toks[(b.least & 1048575) + 2:] END,
    b.least IS NULL
  FROM t LEFT JOIN (
    SELECT x.w, min((CAST(m.made AS BIGINT) << 20) | x.p) AS least
    FROM (SELECT w, unnest(range(1, len(toks))) AS p, unnest(toks[:-2]) AS tok, unnest(toks[2:]) AS following FROM t WHERE NOT done) x
    JOIN merges m ON m.first = x.tok AND m.second = x.following
    GROUP BY x.w) b ON b.w = t.w
  WHERE NOT t.done
), final AS (SELECT w, toks FROM t WHERE done),
texts AS (
  SELECT w, unhex(string_agg(hex(bytes), '' ORDER BY p)) AS decoded
  FROM (SELECT w, unnest(toks) AS id, unnest(range(1, len(toks) + 1)) AS p FROM final) JOIN vocabulary USING (id) GROUP BY w)
SELECT w, toks AS ids, decoded FROM final JOIN texts USING (w)
"""


def ranks_of(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and a rank a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Encoder:
    """Encodes and decodes distinct words; one for each task."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = {(a, b): r for a, b, r in merges}
        self.tokens = {r: t for t, r in ranks.items()}
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        first, second, made = (pa.array([m[k] for m in merges], pa.int32()) for k in range(3))
        merges = pa.table({"first": first, "second": second, "made": made})
        vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def encode(self, words: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
        """For each of the distinct words its place in the list, its ids as little-endian unsigned 32-bit integers, and the bytes decoded from them."""
        rest, ranks, tokens = [], self.ranks, self.tokens
        for i, w in enumerate(words):
            r = ranks.get(w)
            if r is not None:
                # A word that is a token is a fixpoint from the start, as in the library; its one id is looked up again.
                yield i, r.to_bytes(4, "little"), tokens[r]
            elif len(w) > LONG_WORD:
                ids = self.by_heap(w)
                yield i, np.array(ids, "<u4").tobytes(), b"".join(map(tokens.__getitem__, ids))
            else:
                rest.append(i)
        for at in range(0, len(rest), QUERY_WORDS):
            places = rest[at : at + QUERY_WORDS]
            part = [words[i] for i in places]
            ends = np.cumsum([0, *map(len, part)]).astype(np.int32)
            toks = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.of_byte[np.frombuffer(b"".join(part), np.uint8)]))
            start_words = pa.table({"w": pa.array(places, pa.int32()), "toks": toks})  # noqa: F841  read by the query
            found = self.db.sql(ENCODE).to_arrow_table()
            ids = found.column("ids").combine_chunks()
            flat, ends = ids.values.to_numpy().astype("<u4").tobytes(), (4 * ids.offsets.to_numpy()).tolist()
            yield from zip(found.column("w").to_pylist(), map(flat.__getitem__, map(slice, ends[:-1], ends[1:])), found.column("decoded").to_pylist(), strict=True)

    def by_heap(self, word: bytes) -> list[int]:
        """The same contractions for one long word: a heap of (rank, place), and links between neighbours."""
        toks = [self.ranks[bytes([b])] for b in word]
        n = len(toks)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, toks[i], toks[i + 1]) for i in range(n - 1) if (r := self.pairs.get((toks[i], toks[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if toks[i] != a or j >= n or toks[j] != b:
                continue
            toks[i], toks[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := self.pairs.get((toks[x], toks[y]))) is not None:
                    heapq.heappush(heap, (s, x, toks[x], toks[y]))
        return [t for t in toks if t >= 0]


class TextCoder:
    """Texts to ids and back; remembers pieces of text (from a space to the next) between batches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder, self.pattern = Encoder(ranks), regex.compile(pattern)
        # The patterns never take a space that a word follows together with what is before it, nor a lone line end or tab with the word behind it.
        self.pieces = re.compile(f"(?= [^{WHITE}])|(?<=[^{WHITE}][\\n\\r\\t])(?=[^{WHITE}])")
        self.known_ids: dict[str, bytes] = {}
        self.known_text: dict[str, bytes] = {}

    def code(self, batch: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """The ids' bytes and the decoded bytes of each text."""
        if len(self.known_ids) > REMEMBERED:
            self.known_ids, self.known_text = {}, {}
        ids, text = self.known_ids, self.known_text
        # Equal pieces share one string.
        same: dict[str, str] = {}
        cut = [list(map(same.setdefault, ps, ps)) for ps in map(self.pieces.split, batch)]
        new = same.keys() - ids.keys()
        del same
        # A space and letters, or letters alone, are one word in any of the patterns; so is each word by itself.
        single = {p for p in new if p.isalpha() or p[1:].isalpha() and p[0] == " "}
        split = {p: self.pattern.findall(p) for p in new - single}
        words = list((single | set(chain.from_iterable(split.values()))) - ids.keys())
        for i, coded, decoded in self.encoder.encode([w.encode() for w in words]):
            ids[words[i]], text[words[i]] = coded, decoded
        for piece, ws in split.items():
            if len(ws) != 1:
                ids[piece], text[piece] = b"".join(map(ids.__getitem__, ws)), b"".join(map(text.__getitem__, ws))
        for parts in cut:
            yield b"".join(map(ids.__getitem__, parts)), b"".join(map(text.__getitem__, parts))


def batches(texts: Iterable[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size > BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _coded(docs: DataFrame, vocabulary: str, pattern: str, make: Callable, schema: str) -> DataFrame:
    data = docs.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())  # a vocabulary's size doesn't depend on the corpus

    def each(found):
        coder = None
        try:
            for batch in found:
                if not batch.num_rows:
                    continue
                if coder is None:
                    coder = TextCoder(ranks_of(data.value), pattern)
                    trimmed()
                ids, at = batch.column("doc_id"), 0
                texts = (x or "" for piece in slices([batch]) for x in piece.column("text").to_pylist())
                for part in batches(texts):
                    yield make(ids.slice(at, len(part)), list(coder.code(part)))
                    at += len(part)
        finally:
            coder = batch = ids = texts = part = None
            trimmed()

    return docs.mapInArrow(each, schema)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) for every row of docs; null and empty texts have no ids. Special tokens' strings are ordinary text."""

    def make(ids, coded):
        flat = np.frombuffer(b"".join(c[0] for c in coded), "<u4").astype(np.int32)
        ends = np.cumsum([0, *(len(c[0]) // 4 for c in coded)], dtype=np.int32)
        return pa.RecordBatch.from_pydict({"doc_id": ids, "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))})

    return _coded(texts_of(docs), vocabulary, pattern, make, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, decoded (binary) of rows (doc_id, ids), by ordered aggregation of the ids' bytes; null and empty ids decode to nothing."""
    data = encoded.sparkSession.sparkContext.broadcast(open(vocabulary, "rb").read())

    def each(found):
        db = None
        for batch in found:
            if not batch.num_rows:
                continue
            if db is None:
                ranks = ranks_of(data.value)
                db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
                vocabulary = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})
                db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
            for at in range(0, batch.num_rows, 500):
                given = pa.table({"r": pa.array(range(len(batch.slice(at, 500)))), "ids": batch.column("ids").slice(at, 500)})  # noqa: F841  read by the query
                rows = db.execute("SELECT r, unhex(string_agg(hex(bytes), '' ORDER BY p)) FROM (SELECT r, unnest(ids) AS id, generate_subscripts(ids, 1) AS p FROM given) JOIN vocabulary USING (id) GROUP BY r").fetchall()
                out = dict(rows)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, 500), "decoded": pa.array([out.get(r, b"") for r in range(given.num_rows)], pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(each, "doc_id long, decoded binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs: what encode and then decode give, as digests."""

    def make(ids, coded):
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": ids,
                "n_tokens": pa.array([len(c[0]) // 4 for c in coded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(c[0]).hexdigest() for c in coded]),
                "decoded_sha256": pa.array([hashlib.sha256(c[1]).hexdigest() for c in coded]),
            }
        )

    return _coded(texts_of(docs), vocabulary, pattern, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
