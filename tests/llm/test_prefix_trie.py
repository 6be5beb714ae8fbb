"""The prefix trie against a brute-force one."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

from mailsieve.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, words string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    turns, nodes, kids, leaves, saved = defaultdict(list), defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:])
        for d in range(len(made[c]) + 1):
            nodes[made[c][:d]].append(c)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
            leaves[p[:d]] += not kids[p]
    digest = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest(p, m)) for p, m in nodes.items())


def run(df):
    own = prefix_trie.positions(df)
    out = prefix_trie.trie(prefix_trie.rebuilt(own), own.select("conv_id")).drop("path")
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in out.collect())


def chats(seed, n, longest=9):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b c", " d\te \nf", "g"])))
    return rows


def test_trie_equals_brute_force(spark):
    rows = chats(1, 150) + [(1000 + c, t, "user", "hot opening") for c in range(150) for t in range(1 + c % 3)]  # half of all
    rows += [(-7, 0, "user", "x"), (-25, 3, None, "y"), (-20, 1, "user", None), (-40, None, "user", "first"), (-40, 0, "user", "later")]
    rows += [(None, 0, "user", "left out"), (5000, 2, "user", "tie"), (5000, 2, "assistant", "tie"), (5000, 2, "assistant", "tie"), (5001, 0, "user", "z " * 40_000), (5002, 0, "", "")]
    assert run(frame(spark, rows)) == brute(rows)


def test_many_shards_and_bands(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 40)
    rows = chats(2, 60) + [(c, t, "user", f"turn {t}") for c in (300, 301, 302) for t in range(200 + 10 * (c - 300))]  # over several bands
    assert run(frame(spark, rows)) == brute(rows)


def test_empty_and_turnless(spark):
    assert run(frame(spark, [])) == []
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)  # its first turns come from an absent one
    rows = [(lone, 0, "user", "a"), (lone, 1, "user", "b")]
    assert run(frame(spark, rows)) == brute(rows) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
