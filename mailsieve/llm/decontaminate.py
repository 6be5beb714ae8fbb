"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document when at least 80 % of its distinct five-word shingles occur anywhere in
it. Items are partitioned by size; an item of q shingles is indexed by the k = q - ceil(0.8 q) + 1 smallest
hashes of its shingles (a bottom-k MinHash sketch). A document that contains the item can lack at most k - 1
of its shingles, so it must hold one of the k: no contained item is missed, however long the document is.
Documents probe only the partitions whose items they are large enough to contain, and candidates are
verified by exact containment of the shingle strings.

Items are read in blocks of bounded size; each block is one narrow pass over all documents, whose hits are written
and whose index is released before the next block is read.

Words are lower-cased and ASCII punctuation counts as space. Defined results: null and empty texts match
nothing; an item shorter than five words is one shingle of its own length; repeated items and documents
match each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cache, keyed, map_batches, saved

WIDTH = 5
CONTAINED = 0.8
BLOCK_BYTES = 8_000_000
MARKS = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b for b in range(256))
MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(1, WIDTH + 1)], np.uint64)
FILTER = 1 << 20
_numbers: dict[bytes, int] = cache("numbers")


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(MARKS).split()


def hashes(w: list[bytes], width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` words, from cached word hashes."""
    if len(w) < width:
        return np.zeros(0, np.uint64)
    if len(_numbers) > 150_000:
        _numbers.clear()
    get, fresh = _numbers.get, xxhash.xxh3_64_intdigest
    at = []
    for x in w:
        h = get(x)
        if h is None:
            h = _numbers[x] = fresh(x)
        at.append(h)
    a = np.array(at, np.uint64)
    n = len(w) - width + 1
    out = a[:n] * MIX[0]
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * MIX[k] + a[k : n + k]
    return out * MIX[0]


class Index:
    """Sketches of one block of items, for one shingle width."""

    def __init__(self, items: list[tuple[int, list[bytes]]], width: int):
        self.width, self.ids, self.grams, self.need, entries = width, [], [], [], []
        for item_id, w in items:
            grams = {b" ".join(w[i : i + width]): h for i, h in enumerate(hashes(w, width).tolist())}
            q = len(grams)
            need = ceil(CONTAINED * q - 1e-9)
            for h in sorted(set(grams.values()))[: q - need + 1]:
                entries.append((h, len(self.ids)))
            self.ids.append(item_id)
            self.grams.append(grams)
            self.need.append(need)
        #: Sketches by size partition: items that need 2^(p-1) to 2^p - 1 shingles of a document.
        self.parts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: Which partitions have a hash in a slot, a bit for each; numbers above 63 share the last bit.
        self.seen = np.zeros(FILTER, np.uint64)
        for p in sorted({self._size(i) for _, i in entries}):
            own = sorted(e for e in entries if self._size(e[1]) == p)
            keys = np.array([h for h, _ in own], np.uint64)
            self.parts[p] = keys, np.array([i for _, i in own], np.int64)
            slots = np.unique((keys >> np.uint64(44)).astype(np.int64))
            self.seen[slots] |= np.uint64(1 << min(p, 63))

    def _size(self, item: int) -> int:
        return max(1, self.need[item]).bit_length()

    def search(self, w: list[bytes]) -> Iterator[tuple[int, int, int]]:
        h = hashes(w, self.width)
        fits = len(h).bit_length()  # items of larger partitions need more shingles than the document has
        held = self.seen[(h >> np.uint64(44)).astype(np.int64)] & np.uint64((1 << min(fits + 1, 64)) - 1)
        maybe = np.flatnonzero(held)
        if not len(maybe):
            return
        h_maybe, held, found = h[maybe], held[maybe], set()
        for p, (keys, of) in self.parts.items():
            if p > fits:
                break
            some = h_maybe[held & np.uint64(1 << min(p, 63)) != 0]
            lo, hi = np.searchsorted(keys, some, "left"), np.searchsorted(keys, some, "right")
            found.update(int(i) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True) for i in of[a:b])
        for i in sorted(found):
            own = np.fromiter(self.grams[i].values(), np.uint64, len(self.grams[i]))
            at = np.flatnonzero(np.isin(h, own)).tolist()
            shared = len({b" ".join(w[k : k + self.width]) for k in at} & self.grams[i].keys())
            if shared >= self.need[i]:
                yield self.ids[i], shared, len(self.grams[i])


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        if w := tokens(r["text"]):
            block.append((r["item_id"], w))
            size += len(r["text"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def contained(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment: every item contained in every document."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, item_id long, shared long, item_shingles long"
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    out = None
    for block in _blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), block_bytes):
        widths = sorted({min(WIDTH, len(w)) for _, w in block})
        shared = docs.sparkSession.sparkContext.broadcast([Index([x for x in block if min(WIDTH, len(x[1])) == width], width) for width in widths])

        def run(i, t, shared=shared):
            rows = []
            for doc_id, text in zip(i, t, strict=True):
                w = tokens(text)
                rows += [(doc_id, *hit) for index in shared.value for hit in index.search(w)]
            return dict(zip(("doc_id", "item_id", "shared", "item_shingles"), zip(*rows, strict=True) if rows else ([],) * 4, strict=True))

        part = saved(map_batches(given, run, schema))
        shared.destroy()
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that contain no item, all columns kept; rows of a null or repeated id are judged each by its own text."""
    own = keyed(docs)
    hit = contained(own, items, id_col="__row").select(F.col("doc_id").alias("__row")).distinct()
    return own.join(hit, "__row", "left_anti").select(*docs.columns)
