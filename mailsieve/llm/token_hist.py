"""Token counts: an exact histogram of encoded lengths, and suffix sums over it.

Documents are encoded whole with a public byte-level vocabulary (a path parameter; the file of fixed size is
sent to the workers) and counted by length. For every length that occurs, suffix sums give how many documents
and tokens lie at or above it, the total when all documents are cut at it, and the quantiles it spans. Sums
run in two levels, blocks of lengths and lengths inside a block, so no task sees the whole histogram.

Defined results: null and empty texts have length 0; repeated rows count each; an empty table gives no rows.
"""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cache, map_batches, saved

BLOCK = 1024


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_encodings: dict = cache("encodings")


def encoding(raw: bytes, pattern: str):
    import tiktoken

    if (raw, pattern) not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _encodings[raw, pattern] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[raw, pattern]


def lengths(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and the exact encoded length of every document."""
    import public_tokenizers

    with open(vocabulary or default_vocabulary(), "rb") as f:
        shared, pattern = docs.sparkSession.sparkContext.broadcast(f.read()), public_tokenizers.PATTERN
    kind = dict(docs.dtypes)[id_col]

    def run(i, t):
        e = encoding(shared.value, pattern)
        return {"doc_id": i, "length": [len(e.encode_ordinary(x)) if x else 0 for x in t]}

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), run, f"doc_id {kind}, length long")


def histogram(lengths_: DataFrame) -> DataFrame:
    return lengths_.groupBy("length").agg(F.count("*").alias("n_docs"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, docs_cut, truncated_tokens, total_tokens for any limits: what :func:`suffix_sums` gives at the next
    length that occurs, as no document ends between the two. Without documents there are no rows."""
    asked = sorted({int(n) for n in limits})
    longer = lambda n: F.min(F.when(F.col("context_limit") > n, F.struct("context_limit", "docs_at_least", "tokens_at_least")))
    one = sums.agg(F.max("total_tokens").alias("total"), F.array(*(F.struct(F.lit(n).cast("long").alias("limit"), longer(n).alias("x")) for n in asked)).alias("found")).where("total IS NOT NULL")
    cut, left = F.coalesce("f.x.docs_at_least", F.lit(0)), F.coalesce("f.x.tokens_at_least", F.lit(0))
    found = one.select("total", F.explode("found").alias("f"))
    return found.select(F.col("f.limit").alias("context_limit"), cut.cast("long").alias("docs_cut"), (F.col("total") - left + F.col("f.limit") * cut).cast("long").alias("truncated_tokens"), F.col("total").alias("total_tokens"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length: docs and tokens at or above it, totals, the total truncated at it, and the quantiles it spans."""
    h = saved(hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block")))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"))
    total = h.agg(F.sum("n_docs").alias("total_docs"), F.sum("tokens").alias("total_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length"))
    out = h.join(blocks, "block").withColumn("docs_at_least", F.col("d_after") + F.sum("n_docs").over(inside)).withColumn("tokens_at_least", F.col("t_after") + F.sum("tokens").over(inside))
    return out.join(F.broadcast(total)).select(
        F.col("length").alias("context_limit"),
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"),
        (F.col("docs_at_least") - F.col("n_docs")).alias("docs_cut"),
        ((F.col("total_docs") - F.col("docs_at_least")) / F.col("total_docs")).alias("quantile_from"),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile_to"),
    )
