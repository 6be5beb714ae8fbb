"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking.

A table hashes a vector by pseudo-rotations: three rounds of random signs and a fast Hadamard transform take a unit vector
to one that looks random, and its nearest signed axis (of the first few coordinates, where fewer buckets are wanted) is its
hash; a table joins several of them, so that a bucket holds some LOAD vectors whatever their number. A query probes in each
table the buckets of least distance to its rotated vector, and candidates are reranked exactly, in double precision.

The number of probes, and of tables where probes would be more than MOST_PROBES, is fitted: for at most SAMPLE queries, the
smallest hashes of their ids, the true neighbours are found by a scan in which every row takes part, and the probes are set
so that a share TARGET of them is reached. The index holds every vector. On vectors without any structure that means many
candidates, on clustered ones few.

Equal vectors are searched as one, and as candidates stand for their ``k`` + 1 smallest ids, which is all that can be among
the nearest of any query; so a large group of copies costs little. Buckets of more than BLOCK queries or candidates are cut
into cells of at most about BLOCK of each, and every query cell meets every candidate cell: no pair of a bucket is left out.
A query for which the tables give fewer than ``k`` neighbours is scanned against all rows, in blocks of queries.

Defined results: rows with a null id, and vectors that are null, empty, zero or hold null or non-finite components, take no
part; shorter vectors count as padded with zeros; of rows that repeat an id, the least vector counts; ties go to the smaller id;
fewer candidates than ``k`` are all returned; no queries or an empty table give no rows. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _arrow_schema, begin_task, end_task, hash_sample, saved, small_batches

TABLES, MOST_TABLES, MOST_PROBES = 8, 64, 512
LOAD = 32
SAMPLE = 256
TARGET = 0.95
BLOCK = 8192
#: Queries of a scan that are broadcast at a time.
SCAN_BLOCK = 2048
#: Scores this close to the k-th are kept until they are compared exactly.
SLACK = 1e-9
FOUND = "q long, c long, score double"
HASHED = "part int, key long, kind int, gid long"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of every row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        pairs = x.reshape(n, -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


@dataclass(frozen=True)
class Tables:
    """How vectors are hashed: ``axes`` has the coordinates that each polytope of a table looks at."""

    width: int
    axes: tuple[int, ...]
    count: int

    @classmethod
    def for_rows(cls, dim: int, n: int, count: int = TABLES) -> Tables:
        width = 1 << max(0, dim - 1).bit_length()
        axes, buckets = [], max(2.0, n / LOAD)
        while buckets > 1.5 or not axes:
            axes.append(min(width, max(1, 1 << max(0, round(np.log2(buckets)) - 1))))
            buckets /= 2 * axes[-1]
        return cls(width, tuple(axes), count)

    def buckets(self) -> int:
        return int(np.prod([2 * a for a in self.axes]))

    def signed(self, unit: np.ndarray, table: int) -> list[np.ndarray]:
        """The rotated vectors' products with the signed axes, one array a polytope."""
        out = []
        for p, axes in enumerate(self.axes):
            signs = np.random.default_rng([11, table, p]).choice([-1.0, 1.0], (3, self.width))
            x = unit
            for s in signs:
                x = hadamard(x * s)
            out.append(np.concatenate([x[:, :axes], -x[:, :axes]], 1))
        return out

    def keys(self, unit: np.ndarray, table: int) -> np.ndarray:
        key = np.zeros(len(unit), np.int64)
        for y in self.signed(unit, table):
            key = key * y.shape[1] + y.argmax(1)
        return key

    def probes(self, unit: np.ndarray, table: int, most: int) -> np.ndarray:
        """The ``most`` nearest buckets of every row (all, if there are fewer), nearest first.

        Distances of a bucket add up over its polytopes, so the best buckets extend the best of fewer polytopes.
        """
        n = len(unit)
        key, cost = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for y in self.signed(unit, table):
            far = (y.max(1, keepdims=True) - y) ** 2
            cost = (cost[:, :, None] + far[:, None, :]).reshape(n, -1)
            key = (key[:, :, None] * y.shape[1] + np.arange(y.shape[1])).reshape(n, -1)
            order = np.argsort(cost, 1, kind="stable")[:, :most]
            cost, key = np.take_along_axis(cost, order, 1), np.take_along_axis(key, order, 1)
        return key


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` doubles, padded with zeros."""
    size = np.asarray(column.value_lengths(), np.int64)
    flat = np.asarray(column.flatten(), np.float64)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = flat
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors whose squares would leave the range of doubles, divided by their largest component."""
    top = np.abs(x).max(1, initial=0.0)
    odd = (top > 1e100) | (top < 1e-100)
    return np.where(odd[:, None], x / np.where(odd, top, 1.0)[:, None], x)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row products summed from the first component on: equal pairs give equal bits wherever they meet."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return dots(a, b) / (np.sqrt(dots(a, a)) * np.sqrt(dots(b, b)))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Best:
    """The nearest candidates of every query met so far; rows are merged when they are many."""

    def __init__(self, k: int):
        self.k, self.rows, self.held, self.limit = k, [], 0, 200_000

    def meet(self, q: np.ndarray, a: np.ndarray, c: np.ndarray, b: np.ndarray) -> None:
        near = units(a) @ units(b).T
        if len(c) > self.k:
            cut = np.partition(near, len(c) - self.k, 1)[:, len(c) - self.k]
            i, j = np.nonzero(near >= cut[:, None] - SLACK)
        else:
            i, j = np.divmod(np.arange(near.size), len(c))
        self.rows.append((q[i], c[j], cosines(a[i], b[j])))
        self.held += len(i)
        if self.held > self.limit:
            self.merge()
            self.limit = max(200_000, 2 * self.held)

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, c, s = (np.concatenate([r[x] for r in self.rows]) for x in range(3)) if self.rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
        q, c, s = q[new], c[new], s[new]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.rows, self.held = [(q[keep], c[keep], s[keep])], int(keep.sum())
        return self.rows[0]


def _over_batches(df: DataFrame, schema: str, run) -> DataFrame:
    """mapInArrow of a generator function of batches that yields dicts of arrays."""
    small_batches(df.sparkSession)
    arrow, owner = _arrow_schema(df.sparkSession, schema), uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(owner)
        for out in run(batches):
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)
        end_task()

    return df.mapInArrow(task, schema)


def _hashed(df: DataFrame, tables: Tables, probes: int, kind: int, vectors: bool) -> DataFrame:
    """A row (part, key, kind, gid) for every bucket in which a vector is filed (kind 1) or that it probes (kind 0)."""
    v_type = dict(df.dtypes)["v"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x, gid, n = units(scaled(matrix(part.column("v"), tables.width))), part.column("gid"), part.num_rows
                for t in range(tables.count):
                    key = tables.keys(x, t)[:, None] if kind else tables.probes(x, t, probes)
                    for rows in np.array_split(np.arange(n), max(1, n * key.shape[1] // 16_384)):
                        row = np.repeat(rows, key.shape[1])
                        out = {"part": np.full(len(row), t), "key": key[rows].ravel(), "kind": np.full(len(row), kind), "gid": gid.take(pa.array(row))}
                        yield out | ({"v": part.column("v").take(pa.array(row))} if vectors else {})

    return _over_batches(df.select("gid", "v"), HASHED + (f", v {v_type}" if vectors else ""), run)


def _searched(dealt: DataFrame, width: int, k: int) -> DataFrame:
    """Nearest candidates (q, c, score) within the cells of sorted partitions, at most ``k`` a query and task."""

    def run(batches):
        best, cell, q, a = Best(k), None, [], []
        for batch in batches:
            place = np.stack([np.asarray(batch.column(c), np.int64) for c in ("part", "key", "cell", "kind")], 1)
            gid, x = np.asarray(batch.column("gid"), np.int64), scaled(matrix(batch.column("v"), width))
            ends = [*(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            at = 0
            for end in ends if len(place) else []:
                here, kind = tuple(place[at, :3].tolist()), place[at, 3]
                if here != cell:
                    cell, q, a = here, [], []
                if kind == 0:
                    q.append(gid[at:end])
                    a.append(x[at:end])
                elif q:
                    if len(q) > 1:
                        q, a = [np.concatenate(q)], [np.concatenate(a)]
                    for i in range(0, len(q[0]), 256):
                        for j in range(at, end, 4096):
                            best.meet(q[0][i : i + 256], a[0][i : i + 256], gid[j : min(end, j + 4096)], x[j : min(end, j + 4096)])
                at = end
        yield dict(zip(("q", "c", "score"), best.merge(), strict=True))

    return _over_batches(dealt, FOUND, run)


def _scanned(groups: DataFrame, ids: np.ndarray, x: np.ndarray, width: int, k: int) -> DataFrame:
    """Nearest of all groups to the given vectors, at most ``k`` a query and task."""
    sent = groups.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches):
        best, (q, a) = Best(k), sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                c, b = np.asarray(part.column("gid"), np.int64), scaled(matrix(part.column("v"), width))
                for i in range(0, len(q), 256):
                    best.meet(q[i : i + 256], a[i : i + 256], c, b)
        yield dict(zip(("q", "c", "score"), best.merge(), strict=True))

    return _over_batches(groups.select("gid", "v"), FOUND, run)


def _top(found: DataFrame, k: int) -> DataFrame:
    near = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    return found.groupBy("q", "c").agg(F.max("score").alias("score")).withColumn("rn", F.row_number().over(near)).where(F.col("rn") <= k).drop("rn")


def _blocks(rows: DataFrame, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, vs = [], []

    def done():
        return np.array(ids, np.int64), scaled(matrix(pa.array(vs, pa.list_(pa.float64())), width))

    for r in rows.toLocalIterator():
        ids.append(r["gid"])
        vs.append(list(r["v"]))
        if len(ids) == SCAN_BLOCK:
            yield done()
            ids, vs = [], []
    if ids:
        yield done()


def fitted(groups: DataFrame, queries: DataFrame, dim: int, n: int, k: int) -> tuple[Tables, int]:
    """Tables and probes by which a share TARGET of the true neighbours of sample queries is found."""
    tables = Tables.for_rows(dim, n)
    sample = list(_blocks(hash_sample(queries, F.xxhash64("gid", F.lit(11)), SAMPLE), tables.width))
    if not sample:
        return tables, 1
    ids, x = sample[0]
    true = _top(_scanned(groups, ids, x, tables.width, k + 1), k + 1).where("q <> c")
    got = true.join(groups.withColumnRenamed("gid", "c"), "c").select("q", "v").collect()  # at most SAMPLE * (k + 1) rows
    if not got:
        return tables, 1
    at = {q: i for i, q in enumerate(ids.tolist())}
    of = np.array([at[r["q"]] for r in got])
    near = units(scaled(matrix(pa.array([list(r["v"]) for r in got], pa.list_(pa.float64())), tables.width)))
    unit, most = units(x), min(MOST_PROBES, tables.buckets())
    first, t = np.full(len(got), most), 0
    for count in (TABLES * 2**i for i in range(1 + (MOST_TABLES // TABLES).bit_length())):
        for t in range(t, min(count, MOST_TABLES)):
            hit = tables.probes(unit, t, most)[of] == tables.keys(near, t)[:, None]
            first = np.minimum(first, np.where(hit.any(1), hit.argmax(1), most))
        t += 1
        needed = int(np.sort(first)[min(len(first) - 1, int(np.ceil(TARGET * len(first))) - 1)]) + 1
        if needed <= most or t >= MOST_TABLES:
            break
    return Tables(tables.width, tables.axes, t), min(needed, most)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` found of the largest cosine to every row for which ``is_query`` holds."""
    element = dict(vectors.dtypes)[vec_col].removeprefix("array<").removesuffix(">")
    v = F.col(vec_col) if element in ("float", "double") else F.col(vec_col).cast("array<double>")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0)
    one = given.where(F.col("id").isNotNull() & some).groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    in_group = Window.partitionBy("v").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = one.withColumns({"rn": F.row_number().over(in_group), "gid": F.first("id").over(in_group)}).where(F.col("rn") <= k + 1)
    members = saved(ranked.select("gid", "id", F.when(F.col("rn") == 1, F.col("v")).alias("v")))
    groups = members.where("v IS NOT NULL").select("gid", "v")
    asked = saved(one.where("asks").select(F.col("id").alias("query_id"), "v").join(groups, "v").select("query_id", "gid"))
    queries = saved(asked.select("gid").distinct().join(groups, "gid"))
    n, dim = groups.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    tables, probes = fitted(groups, queries, dim, n, k)
    found = saved(_top(_searched(_cells(groups, queries, tables, probes), tables.width, k + 1), k + 1))
    out = _answers(found, members, asked, k)
    total = members.limit(k + 1).count()
    few = asked.join(out.groupBy("query_id").count(), "query_id", "left").where(F.coalesce("count", F.lit(0)) < min(k, total - 1)).select("gid").distinct()
    short = saved(few.join(queries, "gid"))
    for ids, x in _blocks(short, tables.width):
        found = found.union(saved(_top(_scanned(groups, ids, x, tables.width, k + 1), k + 1)))
        out = _answers(_top(found, k + 1), members, asked, k)
    return out


def _cells(groups: DataFrame, queries: DataFrame, tables: Tables, probes: int) -> DataFrame:
    """Filed and probing vectors dealt out by bucket, and by cell within large ones; probing ones come first."""
    both = lambda vectors: _hashed(queries, tables, probes, 0, vectors).union(_hashed(groups, tables, probes, 1, vectors))
    load = both(False).groupBy("part", "key").agg(F.sum("kind").alias("filed"), F.count("*").alias("rows")).where(F.col("filed") > 0)
    load = load.select("part", "key", F.ceil(F.col("filed") / BLOCK).alias("cuts"), F.ceil((F.col("rows") - F.col("filed")) / BLOCK).alias("rounds"))
    large = saved(load.where("cuts > 1 OR rounds > 1"))
    cut = both(True).join(F.broadcast(large) if large.count() <= 100_000 else large, ["part", "key"], "left")
    cuts, rounds, own = F.coalesce("cuts", F.lit(1)), F.greatest(F.coalesce("rounds", F.lit(1)), F.lit(1)), F.xxhash64("gid")
    cells = F.when(F.col("kind") == 0, F.transform(F.sequence(F.lit(0).cast("long"), cuts - 1), lambda x: F.pmod(own, rounds) * cuts + x))
    cells = cells.otherwise(F.transform(F.sequence(F.lit(0).cast("long"), rounds - 1), lambda x: x * cuts + F.pmod(own, cuts)))
    dealt = cut.select("part", "key", F.explode(cells).alias("cell"), "kind", "gid", "v")
    return dealt.repartition("part", "key", "cell").sortWithinPartitions("part", "key", "cell", "kind")


def _answers(found: DataFrame, members: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Groups to ids, and the rank of each among those of its query."""
    ids = found.join(members.select(F.col("gid").alias("c"), "id"), "c").select(F.col("q").alias("gid"), F.col("id").alias("vec_id"), "score")
    best = Window.partitionBy("gid").orderBy(F.desc("score"), "vec_id")
    ids = ids.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).drop("rn")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = asked.join(ids, "gid").where("query_id <> vec_id").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
