"""Ranked lexical search over impact vectors in buckets of like length.

A document is a vector of impacts, one for each term of the items that it holds; an item is a vector of ones, and the score
their product. Items come in blocks of bounded size, and a block is one narrow pass over the texts, which leaves the
block's terms and their counts, and one over these. In the second, each task puts its vectors, some CHUNK_ENTRIES impacts
at a time, in order of length and cuts them into buckets of BUCKET, longest first. With the tenth best score that an item
has so far, the Cauchy-Schwarz inequality passes over whole buckets (the item's length times that of the bucket's longest
vector is too small). Inside a bucket the item's first FOCUS coordinates in it, the heaviest terms, are added up, and the
inequality bounds the rest of each vector by the length that is left to it. Survivors are scored anew, exactly, in integers.
Bounds are never below the score, so nothing is missed. Only each task's ten best documents of an item leave it.

Defined results: null and empty texts, and texts without a term, are not documents and match nothing; an item without terms has
no rows; of rows that repeat an item id, the least text counts; repeated documents are ranked each; documents of equal
score go by ascending id, null last; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, _arrow_schema, begin_task, end_task, map_batches, saved, small_batches

BLOCK_BYTES = 1_000_000
CHUNK_ENTRIES, BUCKET, FOCUS = 1_000_000, 1024, 4
#: Letters and digits of ASCII, A-Z lower-cased, and all bytes of other characters stay; the rest separates terms.
LETTERS = bytes(ASCII_LOWER[b] if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    block, size = [], 0
    for r in items.groupBy("item_id").agg(F.min("text").alias("text")).toLocalIterator():
        if terms := sorted(set(terms_of(r["text"]))):
            block.append((r["item_id"], terms))
            size += sum(map(len, terms))
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def counted(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (its terms), terms and tfs (those of the broadcast vocabulary), of every text that has a term."""

    def run(ids, texts):
        out = {"doc_id": [], "n": [], "terms": [], "tfs": []}
        number = vocabulary.value.get
        for doc_id, text in zip(ids, texts, strict=True):
            words = terms_of(text)
            if not words:
                continue
            known = np.array([x for x in map(number, words) if x is not None], np.int32)
            terms, tfs = np.unique(known, return_counts=True)
            for k, v in (("doc_id", doc_id), ("n", len(words)), ("terms", terms), ("tfs", tfs.astype(np.int32))):
                out[k].append(v)
        return out

    return map_batches(docs, run, "doc_id long, n long, terms array<int>, tfs array<int>", at_most=512)


class Buckets:
    """Impact vectors of one chunk, longest first."""

    def __init__(self, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, m: np.ndarray, weight: np.ndarray):
        of = np.repeat(np.arange(len(sizes)), sizes)
        tf = tfs.astype(np.int64)
        impact = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[of]))
        square = np.bincount(of, impact.astype(np.float64) ** 2, len(sizes))
        self.order = np.argsort(-square, kind="stable")
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        by_doc = np.argsort(rank[of], kind="stable")
        self.terms, self.impact, self.square = terms[by_doc], impact[by_doc], square[self.order]
        self.starts = np.concatenate([[0], np.cumsum(sizes[self.order])])

    def __iter__(self) -> Iterator[Bucket]:
        for low in range(0, len(self.order), BUCKET):
            yield Bucket(self, low, min(len(self.order), low + BUCKET))


class Bucket:
    def __init__(self, chunk: Buckets, low: int, high: int):
        self.low, self.square = low, chunk.square[low:high]
        self.starts = chunk.starts[low : high + 1] - chunk.starts[low]
        at = slice(chunk.starts[low], chunk.starts[high])
        self.terms, self.impact = chunk.terms[at], chunk.impact[at]
        self.longest = math.sqrt(self.square[0])
        self.postings: dict[int, tuple[np.ndarray, np.ndarray]] | None = None

    def posting(self, term: int) -> tuple[np.ndarray, np.ndarray] | None:
        if self.postings is None:
            by_term = np.argsort(self.terms, kind="stable")
            of = np.repeat(np.arange(len(self.square)), np.diff(self.starts))[by_term]
            terms, first = np.unique(self.terms[by_term], return_index=True)
            ends = np.append(first[1:], len(by_term))
            impact = self.impact[by_term]
            self.postings = {t: (of[a:b], impact[a:b]) for t, a, b in zip(terms.tolist(), first.tolist(), ends.tolist(), strict=True)}
        return self.postings.get(term)

    def search(self, terms: list[int], floor: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the bucket that score ``floor`` or more, and above 0; ``terms`` come heaviest first."""
        seen, part, square, left = 0, np.zeros(len(self.square), np.int64), self.square.copy(), len(terms)
        for t in terms:
            left -= 1
            if (found := self.posting(t)) is None:
                continue  # a coordinate that is zero in all of the bucket
            of, impact = found
            part[of] += impact
            square[of] -= impact.astype(np.float64) ** 2
            seen += 1
            if seen == FOCUS:
                break
        bound = part + np.sqrt(left * np.maximum(square, 0.0)) * (1 + 1e-9) + 1
        at = np.flatnonzero(bound >= max(1, floor))
        if not len(at):
            return at, at
        size = self.starts[at + 1] - self.starts[at]
        entry = np.repeat(self.starts[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        held = np.where(asked[self.terms[entry]], self.impact[entry], 0)
        score = np.add.reduceat(np.append(held, 0), np.concatenate([[0], np.cumsum(size)[:-1]]))  # every vector here has an entry
        keep = score >= max(1, floor)
        return at[keep], score[keep]


def _scored(rows: DataFrame, sent, k: int) -> DataFrame:
    """item (its number in the block), doc_id, score: the ``k`` best of every task; ``sent`` has weights, items, N and L."""
    schema = "item int, doc_id long, score long"
    spark = rows.sparkSession
    small_batches(spark)
    arrow, owner = _arrow_schema(spark, schema), uuid.uuid4().hex

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(owner)
        weight, items, n_docs, n_terms = sent.value
        best: list[list[tuple]] = [[] for _ in items]
        floor = np.zeros(len(items), np.int64)
        length = np.sqrt([len(t) for t in items])
        asked = np.zeros(len(weight), bool)
        held, entries = [], 0

        def chunk() -> None:
            ids = [x for b in held for x in b.column("doc_id").to_pylist()]
            sizes = np.concatenate([np.asarray(b.column("terms").value_lengths(), np.int64) for b in held])
            terms, tfs = (np.concatenate([np.asarray(b.column(c).flatten()) for b in held]) for c in ("terms", "tfs"))
            m = np.array([10 + 90 * n * n_docs // n_terms for b in held for n in b.column("n").to_pylist()], np.int64)
            some = sizes > 0
            if not some.any():
                return
            chunk = Buckets(terms, tfs, sizes[some], m[some], weight)
            ids = [ids[x] for x in np.flatnonzero(some)[chunk.order].tolist()]
            for bucket in chunk:
                for i in np.flatnonzero(length * bucket.longest * (1 + 1e-9) + 1 >= np.maximum(1, floor)).tolist():
                    asked[items[i]] = True
                    at, score = bucket.search(items[i], int(floor[i]), asked)
                    asked[items[i]] = False
                    if len(at):
                        if len(at) > k:  # ids break ties, so all that tie with the k-th stay
                            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                            at, score = at[keep], score[keep]
                        new = [(-s, ids[x] is None, ids[x] or 0) for s, x in zip(score.tolist(), (at + bucket.low).tolist(), strict=True)]
                        best[i] = sorted(best[i] + new)[:k]
                        floor[i] = -best[i][-1][0] if len(best[i]) == k else 0

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                held.append(batch.slice(at, 4096))
                entries += len(held[-1].column("terms").flatten())
                if entries >= CHUNK_ENTRIES:
                    chunk()
                    held, entries = [], 0
        if held:
            chunk()
        rows = [(i, None if none else doc_id, -s) for i, found in enumerate(best) for s, none, doc_id in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
        end_task()

    return rows.mapInArrow(task, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents (doc_id, text) of every item (item_id, text)."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    for block in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), block_bytes):
        names = sorted({t for _, terms in block for t in terms})
        numbers = {t: i for i, t in enumerate(names)}
        vocabulary = spark.sparkContext.broadcast(numbers)
        rows = saved(counted(given, vocabulary))
        vocabulary.destroy()
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        weight = np.full(len(names), math.floor(1000 * math.log(2 * n_docs + 2)), np.int64)
        for term, df in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the block's terms
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        asks = [sorted((numbers[t] for t in terms), key=lambda t: (-weight[t], t)) for _, terms in block]
        sent = spark.sparkContext.broadcast((weight, asks, n_docs, n_terms))
        best = _scored(rows, sent, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
        out = out.union(saved(best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")))
        sent.destroy()
    return out
