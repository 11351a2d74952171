"""The pipeline's stages, each against brute force over what the stage before it left."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import tiktoken
from test_filters import contaminated_by_hand, quality_by_hand
from test_words import VOCABULARY, cut, linked

from pagewright.llm import bpe


def corpus():
    """(id, text, label or None): prose, copies, near copies, shared passages, benchmark items word for word and with other numbers, junk, null and empty texts; and the items."""
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [" ".join(w for _ in range(r.randint(3, 6)) for w in (word(), word(), str(r.randint(2, 9)), "kg")) for _ in range(6)]
    texts = [prose(r.randint(40, 120)) for _ in range(40)]
    for t in texts[:12]:
        w = t.split()
        for k in r.sample(range(len(w)), r.choice([0, 0, 1, 2, 8])):
            w[k] = word()
        texts.append(" ".join(w))
    passage = prose(50)
    texts += [f"{prose(20)} {passage} {prose(30)}" for _ in range(4)] + [passage]
    for item in items:
        swap = dict(zip("23456789", r.sample("23456789", 8), strict=True))
        texts += [f"{prose(30)} {item} {prose(20)}", f"{prose(9)} {' '.join(swap.get(w, w) for w in item.split())} {prose(5)}", f"{prose(9)} {' '.join(item.split()[:5])} {prose(5)}"]
    junk = ["$$$ ".join(word().upper() for _ in range(40)) for _ in range(20)]
    rows = [(i, t, 1 if i % 2 else None) for i, t in enumerate(texts)] + [(500 + i, t, 0 if i % 2 else None) for i, t in enumerate(junk)]
    return rows + [(900, None, None), (901, "", None), (902, prose(5000), None)], items


def test_stages_by_brute_force(spark, tmp_path):
    rows, items = corpus()
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in rows if q is not None], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    score = quality_by_hand([(i, t, q) for i, t, q in rows if q is not None])
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(open(VOCABULARY, "rb").read()), special_tokens={})
    assert all(abs(score(t) - 0.5) > 1e-3 for _, t, _ in rows)

    by_hand = {
        "quality classifier": lambda rs: [(i, t) for i, t in rs if score(t) >= 0.5],
        "minhash near-dedup": lambda rs: [x for x, (i, _, least) in zip(rs, linked(rs), strict=True) if i == least],
        "substring dedup": lambda rs: [(i, kept.decode() if gone else t) for (i, t), (_, gone, kept) in zip(rs, cut([t for _, t in rs]), strict=True)],
        "benchmark decontamination": lambda rs: [(i, t) for i, t in rs if not any(contaminated_by_hand(t or "", item) for item in items)],
    }
    now, docs, sizes = [(i, t) for i, t, _ in rows], spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        before, now = now, by_hand[name](now)
        assert sorted(tuple(x) for x in docs.collect()) == sorted((i, t, "en", f"s{i % 3}", len(t or "")) for i, t in now), name
        sizes.append((len(before), len(now), sum(dict(before)[i] != t for i, t in now)))
    assert sizes[0][1] < sizes[0][0] and sizes[1][1] < sizes[1][0] and sizes[2][2] > 0 and sizes[3][1] < sizes[3][0]
    want = {(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in now for ids in [library.encode_ordinary(t or "")]}
    assert {(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
