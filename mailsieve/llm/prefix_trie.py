"""Trie of conversation prefixes from vertical bitmaps.

Conversations are dealt by id range into shards of some SHARD_TURNS turns. A shard is kept vertically: for every position,
a posting of each turn that stands there, as a bitset over the shard's conversations. Children of a node are the non-empty
intersections of its bitset with postings of the next position, taken depth first; population counts give members, and
members that are no longer than the node end there. A node of one member is a chain, written without intersections. Turns
are read position by position in bands of BAND, so a long conversation holds no more than a band of its turns in memory.

A node is named by a 128-bit hash of its turns, and its parts from different shards are summed by name, so a prefix that
many conversations share costs a row a shard. Sums over subtrees need no walk over the tree: a node is owned by its
smallest member, and a conversation owns the nodes of a suffix of its path. So leaves below a node are the members that own a leaf,
and the words of distinct nodes below it are those that its members own, less those its smallest member owns above it.
Both are sums over members, found in a second pass over the shards' bitsets.

Defined results: null role and text are empty; turns are ordered by turn (null first), then by role, the first 64
characters of the text and its hash, so that texts need not be shuffled; repeated rows are turns of their own; rows of a null conversation id are left out; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, _arrow_schema, begin_task, end_task, saved, small_batches

SHARD_TURNS = 20_000
BAND = 64
ROOT = hashlib.md5(b"").digest()
PART = "path binary, parent binary, depth int, words long, above long, conv long, n long, longest int, total long, leaves long, owned long, owner_above long, ends binary"


def positions(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key (128-bit hash of role and text), words of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.left(text, F.lit(64)).alias("head"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "head", "key")
    return rows.withColumn("pos", F.row_number().over(order)).select("conv_id", "pos", "key", "words")


def rebuilt(own: DataFrame, block: int = 20, longest: int = 4) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation c - c % block; h is crc32(c as text) % longest."""
    share = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % block
    first = own.where((F.col("pos") < longest) & (F.col("conv_id") % block == 0))
    lent = first.withColumn("of", F.col("conv_id")).withColumn("conv_id", F.explode(F.sequence(F.col("of") - (block - 1), F.col("of") + (block - 1))))
    lent = lent.where((base == F.col("of")) & (F.col("pos") <= share)).drop("of")
    lent = lent.join(own.select("conv_id").distinct(), "conv_id", "left_semi")
    got = lent.groupBy("conv_id").agg(F.count("*").cast("int").alias("got"))
    kept = own.where(F.col("pos") > share).join(got, "conv_id", "left")
    return lent.union(kept.select("conv_id", F.col("pos") - share + F.coalesce("got", F.lit(0)), "key", "words"))


def _sized(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """A row of position 0 for every id: its number of turns and words."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").cast("int").alias("longest"), F.sum("words").alias("total"))
    return ids.join(sizes, "conv_id", "left").select("conv_id", F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("total", F.lit(0)).alias("total"))


class _Shard:
    """Bitsets of one shard, band by band; bit i stands for the i-th smallest id."""

    def __init__(self):
        self.ids: list[int] = []
        self.facts: list[tuple] = []  # longest, total, leaves, owned, owner_above of every conversation
        self.live: list[tuple] = []  # nodes to go on from: depth, path, parent, words, above, bitset
        self.out: list[tuple] = []
        self.low = 0

    def conversation(self, conv_id: int, facts: tuple) -> None:
        self.ids.append(conv_id)
        self.facts.append(facts)

    def begin(self) -> None:
        self.rank = {c: i for i, c in enumerate(self.ids)}
        if self.ids:
            self.live = [(0, ROOT, None, 0, 0, (1 << len(self.ids)) - 1)]

    def band(self, rows: list[tuple]) -> None:
        """Descends through the positions low + 1 to low + BAND; ``rows`` has their turns (conv_id, pos, key, words)."""
        low = self.low
        self.postings: dict[tuple[int, bytes], int] = {}
        self.words: dict[tuple[int, bytes], int] = {}
        self.turns: dict[int, list[bytes]] = {}
        for conv_id, pos, key, words in rows:
            at = self.rank[conv_id]
            self.postings[pos, key] = self.postings.get((pos, key), 0) | 1 << at
            self.words[pos, key] = words
            self.turns.setdefault(at, []).append(key)
        stack, self.live = self.live, []
        while stack:
            node = stack.pop()
            self.note(node)
            depth, path, _, words, above, members = node
            rest = members & ~self.ended(members, depth)
            if rest and depth == low + BAND:
                self.live.append((*node[:5], rest))
            while rest and depth < low + BAND:
                at = (rest & -rest).bit_length() - 1
                turn = depth + 1, self.turns[at][depth - low]
                child = rest & self.postings[turn]
                stack.append((depth + 1, hashlib.md5(path + turn[1]).digest(), path, self.words[turn], above + words, child))
                rest ^= child
        self.low += BAND

    def ended(self, members: int, depth: int) -> int:
        return sum(1 << i for i in bits(members) if self.facts[i][0] == depth)

    def note(self, node: tuple) -> None:
        """Writes a node; one that was met at the end of the last band has been written then."""
        depth, path, parent, words, above, members = node
        if depth == self.low and depth:
            return
        own = bits(members)
        facts = [self.facts[i] for i in own]
        ends = ",".join(str(self.ids[i]) for i, f in zip(own, facts, strict=True) if f[0] == depth)
        sums = [sum(f[x] for f in facts) for x in (1, 2, 3)]
        self.out.append((path, parent, depth, words, above, self.ids[own[0]], members.bit_count(), max(f[0] for f in facts), *sums, facts[0][4], ends.encode() if ends else None))


def bits(members: int) -> list[int]:
    """Numbers of the bits set, ascending."""
    out = []
    while members:
        low = members & -members
        out.append(low.bit_length() - 1)
        members ^= low
    return out


def _parts(rows: DataFrame, sizes: DataFrame, n_turns: int) -> DataFrame:
    """Every shard's nodes, with sums over the members that it has."""
    spark = rows.sparkSession
    small_batches(spark)
    arrow, owner = _arrow_schema(spark, PART), uuid.uuid4().hex
    columns = ("conv_id", "pos", "key", "words", "longest", "total", "leaves", "owned", "owner_above")
    none = [F.lit(0).cast("long").alias(c) for c in columns[4:]]
    turns = rows.select("conv_id", "pos", "key", "words", *none)
    heads = sizes.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words"), *(F.col(c).cast("long") for c in columns[4:]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(owner)
        shard, rows, begun = _Shard(), [], False

        def written(least: int) -> Iterator[pa.RecordBatch]:
            while len(shard.out) >= least:
                now, shard.out = shard.out[:4096], shard.out[4096:]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*now, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for conv_id, pos, key, words, *facts in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if pos == 0:
                    shard.conversation(conv_id, tuple(facts))
                    continue
                if not begun:
                    shard.begin()
                    begun = True
                while pos > shard.low + BAND:
                    shard.band(rows)
                    rows = []
                    yield from written(4096)
                rows.append((conv_id, pos, key, words))
        if not begun:
            shard.begin()
        while shard.live:
            shard.band(rows)
            rows = []
        yield from written(1)
        end_task()

    shards = max(1, -(-n_turns // SHARD_TURNS))
    return turns.union(heads).repartitionByRange(shards, "conv_id").sortWithinPartitions("pos", "conv_id").mapInArrow(task, PART)


def _ends(parts: DataFrame) -> DataFrame:
    """path, ends_sha256 of the nodes at which a conversation ends; their lists are streamed shard by shard."""
    arrow = _arrow_schema(parts.sparkSession, "path binary, ends_sha256 string")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, digest = None, None
        for batch in batches:
            out = []
            for now, ends in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if now == path:
                    digest.update(b"," + ends)
                    continue
                if path is not None:
                    out.append((path, digest.hexdigest()))
                path, digest = now, hashlib.sha256(ends)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path], arrow[0].type), pa.array([digest.hexdigest()])], schema=arrow)

    return parts.where("ends IS NOT NULL").select("path", "conv", "ends").repartition("path").sortWithinPartitions("path", "conv").select("path", "ends").mapInArrow(task, "path binary, ends_sha256 string")


def trie(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of the prefixes of conversations ``ids`` (conv_id) whose turns are ``rows`` (conv_id, pos from 1, key, words).

    path, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows, ids = saved(rows.select("conv_id", F.col("pos").cast("int").alias("pos"), "key", "words")), saved(ids.distinct())
    sizes = saved(_sized(ids, rows))
    n_turns = rows.count() + sizes.count()
    zero = [F.lit(0).alias(c) for c in ("leaves", "owned", "owner_above")]
    seen = _parts(rows, sizes.select("*", *zero), n_turns)
    whole = seen.groupBy("path").agg(F.min("conv").alias("conv_id"), F.max("longest").alias("longest"), F.max("depth").alias("depth"), F.max("words").alias("words"), F.max("above").alias("above"))
    owners = whole.groupBy("conv_id").agg(F.max((F.col("longest") == F.col("depth")).cast("int")).alias("leaves"), F.sum("words").alias("owned"), F.min("above").alias("owner_above"))
    weighed = sizes.join(owners, "conv_id", "left").select("conv_id", "longest", "total", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("leaves", "owned", "owner_above")))
    parts = saved(_parts(rows, weighed, n_turns))
    sums = [F.sum(c).alias(c) for c in ("n", "total", "leaves", "owned")]
    nodes = saved(parts.groupBy("path").agg(F.min("conv").alias("conv_id"), F.min_by("owner_above", "conv").alias("owner_above"), F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.max("above").alias("above"), *sums))
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "path")
    below = F.col("total") - F.col("n") * F.col("above") - (F.col("owned") - (F.col("above") - F.col("owner_above")))
    full = nodes.join(children, "path", "left").join(_ends(parts), "path", "left")
    full = full.select("path", "parent", "conv_id", F.col("depth").cast("long").alias("depth"), F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"), below.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
    of = nodes.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(of, "parent", "left").select("path", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
