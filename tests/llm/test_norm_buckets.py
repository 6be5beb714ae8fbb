"""Ranked lexical search against a brute-force ranking."""

import math
import random
import re
from collections import Counter

from mailsieve.llm import norm_buckets

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    held = [(i, Counter(t)) for i, t in ((i, TERM.findall((x or "").translate(LOWER))) for i, x in docs) if t]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted(items, key=str):
        terms, ranked = set(TERM.findall((text or "").translate(LOWER))), []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                ranked.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n int, item int").repartition(3)
    return sorted((tuple(r) for r in norm_buckets.search(d, spark.createDataFrame(items, "item_id long, text string"), **how).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: f"{rng.choice('abcdeÀß')}{min(int(rng.paretovariate(0.7)), 400)}"
    return [(i, " ".join(word() for _ in range(rng.randint(1, 80)))) for i in range(n)], [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(25)]


def test_ranking_equals_brute_force(spark):
    docs, items = corpus(1, 400)
    docs += [(1000 + i, docs[3][1]) for i in range(200)]  # a third are copies
    docs += [(None, docs[3][1]), (2000, None), (2001, ""), (2002, " .,; \x00"), (2003, "A1 a1-A1" * 20_000), (2004, "Été ÉTÉ é\x7fb1"), (3, docs[3][1])]
    items += [(100, docs[3][1]), (101, None), (102, "..."), (103, "unheard"), (None, "a1 b2 été ÉTÉ")]
    want = brute(docs, items)
    assert len(want) > 150 and run(spark, docs, items) == want
    assert run(spark, docs, items, block_bytes=60) == want  # many blocks of items


def test_small_buckets_lose_nothing():
    """The bounds alone, bucket by bucket, with a rising floor."""
    import numpy as np

    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 30, 3000)
    terms = np.concatenate([np.sort(rng.choice(200, s, replace=False)) for s in sizes])
    tfs = rng.integers(1, 9, len(terms))
    m, weight = rng.integers(10, 300, len(sizes)), rng.integers(0, 9000, 200)
    chunk = norm_buckets.Buckets(terms, tfs, sizes, m, weight)
    of = np.repeat(np.arange(len(sizes)), sizes)
    impact = weight[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[of]))
    for _ in range(20):
        item = rng.choice(200, 12, replace=False)
        asked = np.isin(np.arange(200), item)
        score = np.bincount(of, np.where(asked[terms], impact, 0), len(sizes)).astype(np.int64)
        floor = int(np.sort(score)[-10])
        got = {}
        for b in chunk:
            if math.sqrt(len(item)) * b.longest * (1 + 1e-9) + 1 >= floor:
                at, s = b.search(sorted(item.tolist(), key=lambda t: -weight[t]), floor, asked)
                got |= dict(zip(chunk.order[at + b.low].tolist(), s.tolist(), strict=True))
        assert got == {i: s for i, s in enumerate(score.tolist()) if s >= max(1, floor)}


def test_repeated_item_and_empty(spark):
    docs = [(1, "a b c"), (2, "b c d"), (3, "x y z")]
    assert run(spark, docs, [(1, "c d"), (1, "a")]) == brute(docs, [(1, "a")])
    assert run(spark, [], [(1, "a")]) == run(spark, docs, []) == run(spark, [(1, None)], [(1, "a")]) == []
