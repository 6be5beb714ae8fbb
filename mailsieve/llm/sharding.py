"""Sharding: longest-processing-time scheduling of groups of equal texts.

Groups are sorted by size, largest first, and each goes to the least-loaded shard through a heap. To stay
distributed the pass has two levels. Groups of at least 1/HEAD_SHARE of the total (so at most HEAD_SHARE of
them) are placed first, on the driver. All others are dealt by hash into bins of about BIN_GROUPS groups;
each bin runs the same heap in its own task, starting from the head loads scaled to the bin's share of the
bytes, so the bins together fill up what the heads left uneven. Slots come from counts of (shard, block)
and a rank inside the block, so no task sorts a whole shard.

Defined results: a null text has size 1 (no bytes, plus 1) and forms a group of its own, apart from empty
texts; null ids are kept; repeated rows stay together and get slots of their own; ties in size are broken by
the text's hash; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

HEAD_SHARE = 1024
BIN_GROUPS = 100_000
BLOCK_ROWS = 50_000


def lpt(sizes, loads: list[float]) -> list[int]:
    """Shards of items already sorted by falling size; ``loads`` are the loads to start from."""
    heap = [(load, s) for s, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for size in sizes:
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
        out.append(s)
    return out


def assign(docs: DataFrame, shards: int = 16, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row an input row, law ``bytes``."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.coalesce(F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)), F.lit(b""))
    rows = saved(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"), key.alias("key")))
    groups = saved(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total, n_groups, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = max(1, -(-total // HEAD_SHARE))
    heads = groups.where(F.col("bytes") >= least).orderBy(F.desc("bytes"), "key").collect()  # HEAD_SHARE at most
    placed = lpt([g["bytes"] for g in heads], [0.0] * shards)
    loads = [0.0] * shards
    for g, s in zip(heads, placed, strict=True):
        loads[s] += g["bytes"]
    tail_bytes = max(1, total - sum(g["bytes"] for g in heads))
    bins = max(1, -(-n_groups // BIN_GROUPS))
    tail = groups.where(F.col("bytes") < least).select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(bins)).cast("int").alias("bin"))

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True])
        share = pdf["bytes"].sum() / tail_bytes
        return pd.DataFrame({"key": pdf["key"], "shard": lpt(pdf["bytes"], [x * share for x in loads])})

    dealt = tail.groupBy("bin").applyInPandas(deal, "key binary, shard int")
    if heads:
        dealt = dealt.union(spark.createDataFrame([(bytes(g["key"]), s) for g, s in zip(heads, placed, strict=True)], "key binary, shard int"))
    blocks = max(1, -(-n_rows // BLOCK_ROWS))
    placed_rows = saved(rows.join(dealt, "key").withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(7)), F.lit(blocks)).cast("int")))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed_rows.groupBy("shard", "block").agg(F.count("*").alias("n")).select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "key")
    return placed_rows.withColumn("at", F.row_number().over(inside) - 1).join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
