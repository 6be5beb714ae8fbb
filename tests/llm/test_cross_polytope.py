"""Nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsieve.llm import cross_polytope as cp

SCHEMA = "vec_id long, embedding array<float>, label int, score double, q long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 7) for i, v in rows], SCHEMA).repartition(3)


def asked():
    return F.col("vec_id") % 50 == 0


def brute(rows, k=5):
    """query -> [(vec_id, cosine)], nearest first, over rows that may take part."""
    width = max((len(v) for _, v in rows if v), default=0)
    ok = {i: np.array([*v, *[0.0] * (width - len(v))], np.float32).astype(float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = {}
    for q in (i for i in ok if i % 50 == 0):
        cos = {i: float(ok[q] @ x / (np.linalg.norm(ok[q]) * np.linalg.norm(x))) for i, x in ok.items() if i != q}
        out[q] = sorted(((i, c) for i, c in cos.items()), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def held(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [v[x] for x in sorted(v)] for q, v in out.items() if sorted(v) == list(range(1, len(v) + 1))}


def clustered(n, d=24, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, d))
    return [(i, (centres[i % 30] + 0.15 * rng.normal(size=d)).astype(np.float32).tolist()) for i in range(n)]


def test_hadamard_keeps_lengths_and_angles():
    x = np.random.default_rng(0).normal(size=(5, 16))
    y = cp.hadamard(x)
    assert np.allclose(x @ x.T, y @ y.T) and np.allclose(cp.hadamard(y), x)


def test_probes_go_by_distance_over_all_polytopes():
    rng = np.random.default_rng(1)
    tables = cp.Tables.for_rows(8, 4000)
    assert len(tables.axes) > 1 and 4000 / 64 < tables.buckets() <= 4000 / 8
    x = cp.units(rng.normal(size=(6, 8)))
    for t in range(2):
        every = tables.probes(x, t, tables.buckets())
        assert (np.sort(every, 1) == np.arange(tables.buckets())).all() and (every[:, 0] == tables.keys(x, t)).all()
        assert (tables.probes(x, t, 9) == every[:, :9]).all()


def test_clustered_vectors_and_odd_rows(spark):
    rows = clustered(900)
    rng = random.Random(5)
    hot = [0.5, -1.0, 2.0, *[0.25] * 21]
    rows += [(2000 + i, hot) for i in range(300)]  # copies: a quarter of all rows
    rows += [(3000 + i, [x + 1e-4 * rng.random() for x in hot]) for i in range(120)]
    rows += [(4000, None), (4050, []), (4100, [0.0] * 24), (4150, [float("nan")] * 24), (4200, [1.0, None]), (4250, [float("inf")] + [1.0] * 23), (None, hot), (4300, [1.0, 2.0]), (4301, [2.0, 4.0])]
    rows += [(0, rows[0][1])]  # a repeated row
    got, want = held(cp.nearest(frame(spark, rows), asked())), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    near = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert near >= 0.9 * 5 * len(want)
    for q in want:  # what is found has the right score and order
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))
        if 2000 <= q < 2300:
            assert [i for i, _ in got[q]] == [i for i in range(2000, 2007) if i != q][:5]
    assert abs(dict(got[4300])[4301] - 1.0) < 1e-12


def test_cells_lose_no_pair(spark, monkeypatch):
    rows = clustered(600, 16, 3)
    whole = held(cp.nearest(frame(spark, rows), asked()))
    monkeypatch.setattr(cp, "BLOCK", 3)
    assert held(cp.nearest(frame(spark, rows), asked())) == whole


def test_few_candidates_are_scanned(spark, monkeypatch):
    rows = [(i, [1.0 if j == i // 10 else 0.001 * i for j in range(8)]) for i in range(0, 80, 10)]
    monkeypatch.setattr(cp, "fitted", lambda *a: (cp.Tables(8, (8, 8), 1), 1))  # tables that find next to nothing
    got, want = held(cp.nearest(frame(spark, rows), asked())), brute(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for few in ([(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (7, [2.0, 1.0])]):
        assert {q: len(v) for q, v in held(cp.nearest(frame(spark, few), asked())).items()} == ({0: 1} if len(few) == 2 else {})


def test_empty(spark):
    assert cp.nearest(frame(spark, []), asked()).count() == 0


@pytest.mark.parametrize("dir_", ["sf0.001", "sf0.1"])
def test_recall_on_given_tables(spark, dir_):
    from mailsieve.llm import queries

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{dir_}/embeddings.parquet").collect()]
    out = queries.QUERIES["op11_nearest_neighbours"](spark, f"/root/testdata/{dir_}")
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got, want = held(out), brute(rows)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
