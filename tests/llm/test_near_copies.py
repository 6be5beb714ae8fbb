"""Near copies of the pipeline against brute force."""

import itertools
import random

import numpy as np
import pytest

from mailsieve.llm import near_copies
from mailsieve.llm.common import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def brute_set(text):
    w = words(text, lower=True)
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return w


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(8), [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, "one three")]
    for k in range(60):
        w = prose(rng, rng.randint(30, 300))
        out.append((2 * k, " ".join(w)))
        for e in range(rng.randint(0, 3)):
            out.append((1000 + 10 * k + e, " ".join(edited(rng, w, rng.randint(1, max(1, len(w) // 40))))))
    hot = prose(rng, 120)  # a large group, each row near to most others
    return out + [(3000 + k, " ".join(edited(rng, hot, k % 4))) for k in range(80)]


def test_near_dedup_equals_brute_force(spark, rows):
    import corpus_pipeline

    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if similar(sets[a], sets[b]):
            root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    assert len(groups) < len(rows) - 60
    got = corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(min(g) for g in groups.values())


@pytest.mark.parametrize("half", [4, near_copies.HALF])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, half):
    """Texts that share most of their words, most pairs of them alike below 0.8; cells of all sizes give the same."""
    monkeypatch.setattr(near_copies, "HALF", half)
    rng, texts = random.Random(1), []
    base = [f"w{rng.randrange(4000)}" for _ in range(60)]
    for k in range(60):
        w = edited(rng, base, 5)
        texts += [(3 * k + e, " ".join(edited(rng, w, e and 1))) for e in range(3)]
    sets, root = [brute_set(t) for _, t in texts], list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        if similar(sets[a], sets[b]) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
    assert 40 < len(set(root)) < 80
    got = near_copies.keep_one(frame(spark, texts)).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(root))


def test_links_of_a_cell_equal_brute_force():
    rng = np.random.default_rng(6)
    sets = [np.sort(rng.choice(60, rng.integers(1, 40), replace=False)) for _ in range(120)] + [np.arange(50)] * 2
    roots = [bytes([k % 97]) for k in range(len(sets))]
    for side in ([-1] * len(sets), [k % 2 for k in range(len(sets))]):
        top = {r: r for r in roots}
        for a, b in itertools.combinations(range(len(sets)), 2):
            n = len(np.intersect1d(sets[a], sets[b]))
            if (side[a] < 0 or side[a] != side[b]) and 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n):
                old, new = top[roots[b]], top[roots[a]]
                top = {r: new if t == old else t for r, t in top.items()}
        got = {r: r for r in roots}
        for a, b in near_copies.local_links(sets, roots, side):
            assert got[a] != got[b]
            old, new = got[b], got[a]
            got = {r: new if t == old else t for r, t in got.items()}
        parts = lambda of: sorted(sorted(r for r in of if of[r] == t) for t in set(of.values()))
        assert parts(got) == parts(top)


def test_recall_of_bands_at_the_threshold():
    rng, near, found = np.random.default_rng(3), 0, 0
    for _ in range(400):
        both = rng.integers(0, 1 << 64, 900, np.uint64)
        a, b = np.sort(both[:810]), np.sort(both[90:])  # 720 of 900: 0.8
        x, y = near_copies.bands([a, b])
        near, found = near + 1, found + bool((x == y).any())
    assert found >= near - 1


def test_near_dedup_empty(spark):
    assert near_copies.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
