"""SimHash near-dedup of documents whose distinct five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two searches. Fingerprints over five-word shingles are linked by the pigeonhole search of
:mod:`simhash_gph`. At similarity 0.8 fingerprints differ in some 10 of 64 bits, which no pigeonhole radius reaches at
a bearable cost (at 3 bits, one such pair in a hundred is found), so documents that share a band of shingle minima are
candidates too: BANDS bands of ROWS minima each. A pair at similarity s shares one with probability
1 - (1 - s^ROWS)^BANDS, 0.99993 at 0.8. Every link is verified by the exact similarity of the sets of 64-bit shingle
hashes, so no pair below 0.8 is linked.

Documents of equal sets collapse to one node first. In each bucket all nodes are verified against the least one, and
components are found. Then every pair of a bucket is compared whose nodes are left in different components, however large the
bucket is: its sets go to cells of at most 2 * HALF, where overlaps are counted through an index of the cell's shingles.
Members of the bucket's largest component meet the others, never each other. A cell emits fewer links than it has
members, and they join components, so the second search for components is over few roots.

Words are as in SimHash. Defined results: null and empty texts have no shingles and are copies of each other; fewer
than five words make one shingle; null ids are kept apart by row; an empty table gives an empty result. Sets and rows
are named by 128-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash_gph
from .common import _arrow_schema, begin_task, end_task, keep_first, keyed, map_batches, saved, small_batches, words
from .components import components, rerooted
from .decontaminate import hashes

WIDTH = 5
ROWS, BANDS = 5, 24
#: Buckets of more than 2 * HALF nodes are cut into blocks of some HALF, which meet in cells.
HALF = 256
_random = np.random.default_rng(5)
FLIP = _random.integers(0, 1 << 64, (BANDS, ROWS), np.uint64)
ODD = _random.integers(0, 1 << 64, (BANDS, ROWS), np.uint64) | np.uint64(1)
#: Similarity of 0.8 or more of sets of sizes x and y that share n, in whole numbers.
SIMILAR = "5 * n >= 4 * (x + y - n)"


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, sorted."""
    w = words(text, lower=True)
    return np.unique(hashes(w, min(WIDTH, len(w)))) if w else np.zeros(0, np.uint64)


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """One key a band of every set; the sets are not empty."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for flip, odd in zip(FLIP[b], ODD[b], strict=True):
            key = (key ^ np.minimum.reduceat((flat ^ flip) * odd, starts)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[:, b] = key
    return out.view(np.int64)


def _sketch(row: list, doc_id: list, t: list) -> dict:
    sets = [shingles(x) for x in t]
    fp = [simhash_gph.majority(np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8)) for s in sets]
    some = [s for s in sets if len(s)]
    made = iter(bands(some).tolist() if some else [])
    node = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
    return {"__row": row, "doc_id": doc_id, "node": node, "fp": fp, "keys": [next(made) if len(s) else [] for s in sets]}


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, s) are similar."""
    left, right = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumns({"x": F.size("sa"), "y": F.size("sb")}).where("5 * least(x, y) >= 4 * greatest(x, y)")
    return both.withColumn("n", F.size(F.array_intersect("sa", "sb"))).where(SIMILAR).select("a", "b")


def _sets(distinct: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, s) of the given nodes, from the text of one row of each."""
    rows = distinct.join(nodes.distinct(), "node", "left_semi").select("node", "__row")
    texts = docs.select("__row", "text").join(rows, "__row").groupBy("__row").agg(F.first("node").alias("node"), F.first("text").alias("t")).select("node", "t")
    return saved(map_batches(texts, lambda node, t: {"node": node, "s": [shingles(x).view(np.int64) for x in t]}, "node binary, s array<long>", at_most=64))


def local_links(sets: list[np.ndarray], roots: list[bytes], side: list[int]) -> list[tuple[bytes, bytes]]:
    """Pairs of roots joined by similar sets of one cell, without loops. Sets of equal ``side`` are not compared,
    unless it is negative."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], np.diff(flat[order]) != 0])
    token = np.empty(len(flat), np.int64)
    token[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(flat)))
    owner_by_token, n = owner[order], np.array([len(s) for s in sets])
    ends = np.cumsum(n)
    top = {r: r for r in roots}

    def find(r: bytes) -> bytes:
        while top[r] != r:
            top[r] = r = top[top[r]]
        return r

    out = []
    for x in range(len(sets)):
        own = find(roots[x])
        others = [y for y in range(x + 1, len(sets)) if (side[x] < 0 or side[y] != side[x]) and find(roots[y]) != own]
        if not others:
            continue
        held = token[ends[x] - n[x] : ends[x]]
        held = held[many[held] > 1]
        if not len(held):
            continue
        at = np.repeat(first[held] - np.concatenate([[0], np.cumsum(many[held])[:-1]]), many[held]) + np.arange(many[held].sum())
        both = np.bincount(owner_by_token[at], minlength=len(sets))
        for y in others:
            if 5 * both[y] >= 4 * (n[x] + n[y] - both[y]) and (a := find(roots[x])) != (b := find(roots[y])):
                top[b] = a
                out.append((a, b))
    return out


def _in_cells(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between the roots of ``members`` (key, node, root), by all pairs of a bucket whose roots differ."""
    spark = members.sparkSession
    small_batches(spark)
    per = members.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("many"), F.max("c").alias("main"), F.max_by("root", "c").alias("main_root"), F.count("*").alias("roots"))
    left = members.join(per.where("roots > 1").drop("roots"), "key")
    cut = lambda n: F.greatest(F.ceil(n / HALF), F.lit(1)).cast("int")
    left = left.withColumns({"a": cut(F.col("main")), "b": cut(F.col("many") - F.col("main")), "of_main": F.col("root") == F.col("main_root"), "h": F.xxhash64("node")})
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    zero, own_a, own_b = F.lit(0), F.pmod(F.col("h"), F.col("a")), F.pmod(F.col("h"), F.col("b"))
    upto = lambda n: F.sequence(zero, F.col(n) - 1)
    of_main = F.transform(upto("b"), lambda j: cell(0, own_a, j, zero))
    of_rest = F.concat(F.transform(upto("a"), lambda i: cell(0, i, own_b, F.lit(1))), F.transform(upto("b"), lambda j: cell(1, F.least(own_b, j), F.greatest(own_b, j), F.when(own_b == j, F.lit(-1)).when(own_b < j, zero).otherwise(F.lit(1)))))
    cells = F.when(F.col("many") <= 2 * HALF, F.array(cell(2, zero, zero, F.lit(-1)))).when(F.col("of_main"), of_main).otherwise(of_rest)
    dealt = left.select("key", "node", "root", F.explode(cells).alias("cell")).join(sets, "node").select("key", "cell.kind", "cell.i", "cell.j", "cell.side", "root", "s")
    arrow, owner = _arrow_schema(spark, "a binary, b binary"), uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(owner)
        now, roots, side, own = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(roots) > 1 and (found := local_links(own, roots, side)):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, arrow[0].type), pa.array(b, arrow[1].type)], schema=arrow)

        for batch in batches:
            sizes = np.asarray(batch.column("s").value_lengths(), np.int64)
            flat, ends = np.asarray(batch.column("s").flatten()), np.cumsum(sizes)
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "kind", "i", "j", "side", "root")), strict=True)
            for k, (key, kind, i, j, on, root) in enumerate(rows):
                if (key, kind, i, j) != now:
                    yield from done()
                    now, roots, side, own = (key, kind, i, j), [], [], []
                roots.append(root)
                side.append(on)
                own.append(flat[ends[k] - sizes[k] : ends[k]].copy())
        yield from done()
        end_task()

    return dealt.repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j").mapInArrow(task, "a binary, b binary")


def classes(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of every node linked to a smaller one; ``rows`` are sketches of the keyed ``docs``."""
    distinct = saved(rows.groupBy("node").agg(F.min("__row").alias("__row"), F.min("fp").alias("fp"), F.first("keys").alias("keys")))
    dealt = distinct.select("node", F.explode("keys").alias("key"))
    hubs = dealt.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("many")).where("many > 1").drop("many")
    members = saved(dealt.join(hubs, "key"))
    prints = saved(distinct.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("many")))
    same = distinct.join(prints.where("many > 1").select("fp", "first"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near, shared, planned = simhash_gph.hub_links(prints.select("fp"))
    of_print = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"n{c}"))
    as_nodes = lambda df: df.join(of_print("a"), "a").join(of_print("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    stars = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).union(same).union(as_nodes(near))
    stars = saved(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sets = _sets(distinct, docs, stars.select(F.col("a").alias("node")).union(stars.select("b")))
    of = components(verified(stars, sets)).select(F.col("node").alias("__node"), "root")
    named = lambda df: df.join(of, df["node"] == of["__node"], "left").drop("__node").withColumn("root", F.coalesce("root", "node"))
    nodes = saved(named(distinct.select("node", "fp")))
    by_print = nodes.join(prints.select(F.col("first").alias("node")), "node", "left_semi").select("fp", "root")
    rest = saved(as_nodes(simhash_gph.other_links(by_print, shared, planned).select("a", "b").distinct()))
    links = _in_cells(named(members.select("key", "node")), sets)
    if not rest.isEmpty():
        close = verified(rest, _sets(distinct, docs, rest.select(F.col("a").alias("node")).union(rest.select("b"))))
        root_of = lambda c: nodes.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        links = links.union(close.join(root_of("a"), "a").join(root_of("b"), "b").select("ra", "rb"))
    return rerooted(nodes.select("node", "root"), links)


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, one row of each component: the smallest id (null last), then the smallest row hash."""
    own = keyed(docs)
    kind = dict(docs.dtypes)["doc_id"]
    rows = saved(map_batches(own.select("__row", "doc_id", "text"), _sketch, f"__row binary, doc_id {kind}, node binary, fp long, keys array<long>", at_most=64))
    of = classes(rows, own).withColumnRenamed("node", "__node")
    return keep_first(own, rows.join(of, rows["node"] == of["__node"], "left").select("__row", "doc_id", F.coalesce("root", "node").alias("component")))
