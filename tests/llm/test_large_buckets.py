"""Buckets of many texts that are alike but not alike enough are cut into cells, and pairs that are alike enough stay
linked."""

import random

from mailsieve.llm import near_copies


def shingle_set(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_pairs_survive_the_cutting(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "HALF", 6)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    texts = []
    for i in range(60):
        w = list(base)
        for k in rng.sample(range(300), 9):
            w[k] = f"x{i}_{k}"
        texts.append(" ".join(w))
        if i % 4 == 0:
            w[rng.randrange(300)] = f"y{i}"
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        for i in range(len(texts)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert {r.doc_id for r in near_copies.keep_one(df).collect()} == {i for i in range(len(texts)) if root[i] == i}
