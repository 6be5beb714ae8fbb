"""SimHash near-duplicates found by the general pigeonhole principle.

Fingerprints are taken over word shingles in one narrow pass. Distinct fingerprints are linked at a small
Hamming distance: the 64 bits are grouped into parts so that correlated bits share a part, each part gets a
threshold of its own (they sum to distance - parts + 1; -1 means the part is not probed) by dynamic
programming on estimated candidate counts, and a fingerprint probes a part with every value within that
part's threshold. Any pair within the distance agrees with some part's threshold, whatever the estimates
were, so they steer cost and never results. Pairs are verified inside the join. Copies collapse to one
fingerprint before it, and components need only some of a cluster's pairs, so a large group of copies or of near
copies emits few.

Defined results: null and empty texts have fingerprint zero; fewer words than the shingle width make one
shingle; null ids are kept and take the smallest id of their component (null if it has none); repeated rows
are linked; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample, keep_first, keyed, map_batches, saved, words
from .components import components, rerooted

SEED = 42
#: Fingerprints from which costs are estimated, at most.
ESTIMATE_ROWS = 1024
BYTE_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)])


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 of all shingles, as a signed 64-bit integer."""
    w = words(text, lower=True)
    if not w:
        return 0
    if len(w) <= width:
        digests = xxhash.xxh64_digest(b" ".join(w), SEED)
    else:
        line, digest = b" ".join(w), xxhash.xxh64_digest
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(w) - width + 1].tolist()
        digests = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)])
    return majority(np.frombuffer(digests, np.uint8).reshape(-1, 8)[:, ::-1])  # digests are big-endian


def majority(octets: np.ndarray) -> int:
    """Bits set in over half the 64-bit hashes, given as little-endian bytes; zero for none."""
    hist = np.bincount((octets + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256)
    ones = (2 * (hist @ BYTE_BITS).ravel() > len(octets)).astype(np.uint8)
    return int(np.packbits(ones, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), lambda i, t: {"doc_id": i, "fp": [fingerprint(x, width) for x in t]}, f"doc_id {kind}, fp long")


def _bits(sample: np.ndarray) -> np.ndarray:
    return np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of near-equal width; each grows by the bit most correlated with those it has."""
    seen = np.abs(np.nan_to_num(np.corrcoef(bits.T.astype(float)))) if len(bits) > 1 else np.eye(64)
    left, out = set(range(64)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        part = [max(left, key=lambda b: (seen[b, list(left)].sum(), -b))]
        left.discard(part[0])
        while len(part) < width:
            best = max(left, key=lambda b: (seen[b, part].sum(), -b))
            part.append(best)
            left.discard(best)
        out.append(sorted(part))
    return out


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one a part, that sum to ``total`` at the least cost; ``costs[i][e + 1]`` is the cost of e."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for so_far, (cost, chosen) in best.items():
            for e in range(-1, len(part) - 1):
                if (key := so_far + e) not in step or cost + part[e + 1] < step[key][0]:
                    step[key] = (cost + part[e + 1], [*chosen, e])
        best = step
    return best[total]


def plan(sample: np.ndarray, n: int, distance: int) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds for ``n`` fingerprints; a probe row is taken to cost 30 candidate checks."""
    bits, choices = _bits(sample), []
    scale = (n / max(1, len(sample))) ** 2 / 2
    for parts in range(1, distance + 2):
        groups, costs = group_bits(bits, parts), []
        for g in groups:
            sub = bits[:, g].astype(np.float32)
            ones = sub.sum(1)
            apart = ones[:, None] + ones[None, :] - 2 * (sub @ sub.T)
            costs.append([0.0] + [30.0 * n * sum(comb(len(g), k) for k in range(e + 1)) + scale * max(0.0, float((apart <= e).sum() - len(sub))) + n * n * sum(comb(len(g), k) for k in range(e + 1)) / 2.0 ** len(g) for e in range(distance + 1)])
        cost, thresholds = allocate(costs, distance - parts + 1)
        choices.append((cost, parts, groups, thresholds))
    return min(choices, key=lambda c: c[:2])[2:]


def _within(distance: int):
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance


def probe_tables(distinct: DataFrame, distance: int, keep: tuple[str, ...] = (), planned: tuple | None = None) -> tuple[DataFrame, DataFrame, tuple]:
    """What every fingerprint probes (part, key, a) and where it is filed (part, key, b), with the columns in ``keep``;
    and the plan, by which another call deals out the same buckets."""
    if planned is None:
        n = distinct.count()
        got = [r["fp"] for r in hash_sample(distinct, F.xxhash64("fp"), ESTIMATE_ROWS).collect()]
        planned = plan(np.array(got, np.int64), n, distance)
    probes = index = None
    signed = lambda bits: int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])
    for part, (group, e) in enumerate(zip(*planned, strict=True)):
        if e < 0:
            continue
        value = F.col("fp").bitwiseAND(F.lit(signed(group)))
        ball = [signed(c) for k in range(e + 1) for c in combinations(group, k)]
        filed = distinct.select(F.lit(part).alias("part"), value.alias("key"), F.col("fp").alias("b"), *keep)
        asked = distinct.select(F.lit(part).alias("part"), value.alias("own"), F.col("fp").alias("a"), *keep).withColumn("flip", F.explode(F.lit(ball)))
        asked = asked.select("part", F.col("own").bitwiseXOR(F.col("flip")).alias("key"), "a", *keep)
        probes, index = (asked, filed) if probes is None else (probes.union(asked), index.union(filed))
    return probes, index, planned


def links(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints (column fp) at ``distance`` differing bits or fewer."""
    probes, index, _ = probe_tables(distinct, distance)
    return probes.join(index, ["part", "key"]).where((F.col("a") < F.col("b")) & _within(distance)).select("a", "b").distinct()


def hub_links(distinct: DataFrame, distance: int = 3) -> tuple[DataFrame, DataFrame, tuple]:
    """Links (a, b) of every bucket's least fingerprint; the buckets (part, key) that file several; and the plan."""
    probes, index, planned = probe_tables(distinct, distance)
    hubs = saved(index.groupBy("part", "key").agg(F.min("b").alias("b"), F.count("*").alias("many")))
    members = probes.union(index.select("part", "key", F.col("b").alias("a")))
    near = members.join(hubs.drop("many"), ["part", "key"]).where((F.col("a") != F.col("b")) & _within(distance))
    return saved(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), hubs.where("many > 1").select("part", "key"), planned


def other_links(named: DataFrame, shared: DataFrame, planned: tuple, distance: int = 3) -> DataFrame:
    """Links (a, b, root, other) within the ``shared`` buckets between fingerprints (fp, root) of different roots."""
    probes, index, _ = probe_tables(named, distance, ("root",), planned)
    met = probes.join(shared, ["part", "key"]).withColumnRenamed("root", "other").join(index, ["part", "key"])
    return met.where((F.col("root") != F.col("other")) & _within(distance)).select("a", "b", "root", "other")


def roots(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """(node, root) of every distinct fingerprint (column fp), by links at ``distance`` differing bits or fewer.

    First every probe and every fingerprint of a bucket is compared with the bucket's least one only. Then, in buckets
    that file several fingerprints, those are compared that the first links left in different components; what they link are
    roots, mostly few. So a large cluster of close fingerprints emits few pairs.
    """
    first, shared, planned = hub_links(distinct, distance)
    of = components(first).withColumnRenamed("node", "fp")
    named = saved(distinct.join(of, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    return rerooted(named.withColumnRenamed("fp", "node"), other_links(named, shared, planned, distance).select(F.col("root").alias("a"), F.col("other").alias("b")))


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp, component_id, one row an input row; component_id is the smallest id reachable over links."""
    rows = saved(fingerprints(docs, text_col, id_col, width))
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    joined = roots(distinct.select("fp"), distance)
    of = distinct.join(joined, distinct["fp"] == joined["node"]).select("fp", "low", "root")
    lowest = of.groupBy("root").agg(F.min("low").alias("component_id"))
    named = of.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: str):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, one row of each component of close fingerprints: the smallest id (null last), then the smallest row hash."""
    own = keyed(docs)
    of = classes(own, id_col="__row").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("component")).distinct()
    return keep_first(own, own.select("__row", "doc_id").distinct().join(of, "__row"))
