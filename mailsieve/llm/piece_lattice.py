"""SentencePiece encoding and decoding over a relational lattice.

Texts are cut into units at every place that no piece of the model spans, so units can be encoded apart and
a distinct unit only once. For the distinct units, substrings of bounded length are exploded and equi-joined
to the piece table (of the model's fixed size), which gives the lattice's edges; edges are grouped by unit
and folded by a Spark ``aggregate`` that keeps the best path to every position, and a second ``aggregate``
walks it back.

The public model is of the merging (BPE) type, for which the path of the highest total score is not what the
model's own library returns. The fold's transition weight is therefore 0 for two pieces that merging leaves
apart and minus infinity for all others; the one path of finite weight is the library's encoding. Whether a
pair stays apart is decided per batch of edges, by undoing merges on both sides of the boundary.

Workers hold a table of the most frequent units, at most COMMON of them and some 20 bytes each, keyed by a
64-bit hash and a 32-bit check. Only if there are more distinct units than that, the others are joined by a
shuffle, and documents then meet their parts by key.

Defined results: null and empty texts give no ids; characters outside the model become byte pieces; repeated
rows get equal ids; an empty table gives an empty result. U+2581 in a text decodes to a space, as in the
model's own library.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, begin_task, cache, end_task, map_arrays, map_batches, most_frequent, saved, slices, small_batches, strings

SPACE = "▁"
COMMON = 4_000_000
FLUSH = 300_000
CACHE = 220_000
HOLE = 0xFFFF
BPE = 2
#: Characters of a piece, at most, that a packed edge has room for.
LONGEST = 0x7FF


@dataclass
class Pieces:
    """The model's pieces with their order of merging, and what undoing merges needs."""

    ids: dict[str, int]
    bytes_: dict[int, int]  # byte -> id
    order: np.ndarray  # id -> order: single characters first, then by falling score
    left: np.ndarray  # order -> order of the two parts last merged; itself for single characters
    right: np.ndarray
    pair_keys: np.ndarray  # packed orders of two pieces that make a piece
    pair_made: np.ndarray
    chars: np.ndarray  # code points of pieces, sorted
    joins: np.ndarray  # flags of (character class, character class): next to each other inside a piece
    longest: int


def _merge(symbols: list[str], rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """Merge the best neighbours until none is left; also the last two that were merged."""
    last = None
    while True:
        best = min(((rank[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in rank), default=None)
        if best is None:
            return symbols, last
        k = best[1]
        last = (symbols[k], symbols[k + 1])
        symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2 :]]


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value, shift, at = value | (raw[at] & 0x7F) << shift, shift + 7, at + 1
        if raw[at - 1] < 0x80:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Numbers and values of the fields of a serialised model."""
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        if tag & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def model_type(model: bytes) -> int:
    """What the trainer's part of the model (field 2) says of its type (field 3); a model that says nothing is a unigram model."""
    for number, part in _fields(model):
        if number == 2:
            return next((value for k, value in _fields(part) if k == 3), 1)
    return 1


def load(model: bytes) -> Pieces:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    if model_type(model) != BPE or sp.get_piece_size() > HOLE:
        raise ValueError(f"the model is not of the merging (BPE) type with at most {HOLE} pieces")
    plain = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    bytes_ = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}
    rank = {p: k for k, p in enumerate(sorted((p for p in plain if len(p) > 1), key=lambda p: (-sp.get_score(plain[p]), plain[p])))}
    parts = {p: _merge(list(p), rank) for p in rank}
    rank = {p: r for p, r in rank.items() if len(parts[p][0]) == 1}  # the others are never made
    singles = sorted({c for p in plain for c in p})
    order = {c: k for k, c in enumerate(singles)} | {p: len(singles) + k for k, p in enumerate(sorted(rank, key=rank.get))}
    left, right = np.arange(len(order), dtype=np.int64), np.arange(len(order), dtype=np.int64)
    for p in rank:
        left[order[p]], right[order[p]] = (order[x] for x in parts[p][1])
    pairs = sorted((order[p[:k]] << 32 | order[p[k:]], order[p]) for p in rank for k in range(1, len(p)) if p[:k] in order and p[k:] in order)
    of_id = np.full(sp.get_piece_size(), -1, np.int64)
    for p, i in plain.items():
        if p in order:
            of_id[i] = order[p]
    chars = np.array([ord(c) for c in singles])
    joins = np.zeros((len(singles) + 1, len(singles) + 1), bool)
    number = {c: k for k, c in enumerate(singles)}
    for p in rank:
        for a, b in zip(p, p[1:], strict=False):
            joins[number[a], number[b]] = True
    return Pieces({p: i for p, i in plain.items() if p in order}, bytes_, of_id, left, right, np.array([k for k, _ in pairs], np.int64), np.array([m for _, m in pairs], np.int64), chars, joins, max(map(len, rank)))


def stay_apart(p: Pieces, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging leaves pieces a and b (ids) apart when they stand side by side.

    Merges next to the boundary are undone, the latest first; the pair is refused when the two sides as they
    then stand would have been merged before the merge that was last undone.
    """
    a, b = p.order[a].copy(), p.order[b].copy()
    out = np.ones(len(a), bool)
    limit = np.full(len(a), 1 << 40, np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live], b[live]
        at = np.minimum(np.searchsorted(p.pair_keys, key := x << 32 | y), len(p.pair_keys) - 1)
        refused = (p.pair_keys[at] == key) & (p.pair_made[at] < limit[live])
        out[live[refused]] = False
        live, x, y = live[~refused], x[~refused], y[~refused]
        split_x, split_y = p.left[x] != x, p.left[y] != y
        undo_x = split_x & (~split_y | (x > y))
        undo_y = split_y & ~undo_x
        limit[live[undo_x]], limit[live[undo_y]] = x[undo_x], y[undo_y] + 1
        a[live[undo_x]], b[live[undo_y]] = p.right[x[undo_x]], p.left[y[undo_y]]
        live = live[undo_x | undo_y]
    return out


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> Pieces:
    return load(model)


def _edges(t: str, p: Pieces) -> np.ndarray:
    """0, the places to cut, and the length of a marked text."""
    code = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = _classes(p)[np.minimum(code, (1 << 16) - 1)]
    if (code >= 1 << 16).any():
        far = np.searchsorted(p.chars, code)
        hit = p.chars[np.minimum(far, len(p.chars) - 1)] == code
        at = np.where(code >= 1 << 16, np.where(hit, far, len(p.chars)), at).astype(np.int32)
    cut = np.flatnonzero(~p.joins.ravel()[at[:-1] * p.joins.shape[1] + at[1:]]) + 1
    return np.concatenate([[0], cut, [len(t)]])


def units(text: str | None, p: Pieces) -> list[str]:
    """The text with its leading mark, cut wherever no piece spans."""
    if not text:
        return []
    t = SPACE + text.replace(" ", SPACE)
    edges = _edges(t, p).tolist()
    return [t[x:y] for x, y in zip(edges, edges[1:], strict=False)]


def _irregular(t: pa.Array) -> pa.Array:
    """Whether spaces meet, lead or trail in a text, or it holds the mark itself; other texts are words between single
    spaces, which can be cut apart from each other."""
    tests = (pc.starts_with(t, " "), pc.ends_with(t, " "), pc.match_substring(t, "  "), pc.match_substring(t, SPACE))
    return reduce(pc.or_, tests)


def units_of_words(w: list[str], p: Pieces) -> tuple[list[str], list[int]]:
    """Units of all words, cut in one pass, and where each word's units begin; one more place ends the list."""
    if not w:
        return [], [0]
    t = SPACE + SPACE.join(w)
    edges = _edges(t, p)
    begins = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    at = np.searchsorted(edges, np.concatenate([[0], begins]))
    edges = edges.tolist()
    return [t[x:y] for x, y in zip(edges, edges[1:], strict=False)], at.tolist()


_class_tables: dict[int, np.ndarray] = cache("classes")


def _classes(p: Pieces) -> np.ndarray:
    got = _class_tables.get(id(p))
    if got is None:
        got = np.full(1 << 16, len(p.chars), np.int32)
        low = p.chars[p.chars < (1 << 16) - 1]
        got[low] = np.arange(len(low))
        _class_tables.clear()
        _class_tables[id(p)] = got
    return got


def count_units(docs: DataFrame, model) -> DataFrame:
    """Distinct units of column t; n is in how many blocks of text (of FLUSH distinct words or so) a unit occurs."""
    arrow = _arrow_schema(docs.sparkSession, "unit string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(owner)
        p, whole, some = model.value, set(), set()

        def flush() -> pa.RecordBatch:
            w = list(whole)
            for at in range(0, len(w), 50_000):
                some.update(units_of_words(w[at : at + 50_000], p)[0])
            out = pa.RecordBatch.from_arrays([pa.array(list(some))], schema=arrow)
            whole.clear()
            some.clear()
            return out

        for batch in batches:
            for part in slices(batch, 2048, 4_000_000):
                t = pc.fill_null(part.column(0), "")
                odd = _irregular(t)
                for x in t.filter(odd).to_pylist():
                    some.update(units(x, p))
                whole.update(strings(pc.unique(pc.split_pattern(t.filter(pc.invert(odd)), " ").flatten())))
                whole.discard("")
                if len(whole) + len(some) > FLUSH:
                    yield flush()
        if whole or some:
            yield flush()
        end_task()

    owner = uuid.uuid4().hex
    return docs.select("t").mapInArrow(run, "unit string").groupBy("unit").agg(F.count("*").alias("n"))


def _transitions(edges: DataFrame, model) -> DataFrame:
    """uid, edges: to every edge (e, s, pid), the pieces that may stand before it."""
    schema = "uid long, edges array<struct<e:int,s:int,pid:int,ok:array<int>>>"
    arrow = _arrow_schema(edges.sparkSession, schema)
    inner = arrow.field("edges").type.value_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = model.value
        for batch in batches:
            col = batch.column("edges")
            offsets = np.asarray(col.offsets)
            flat = np.asarray(col.values)[offsets[0] : offsets[-1]].astype(np.int64)
            e, pid = flat >> 31, flat & 0xFFFFF
            s = e - (LONGEST - (flat >> 20 & LONGEST))
            size = np.diff(offsets)
            whose = np.repeat(np.arange(len(size)), size)
            stride = int(e.max()) + 2 if len(e) else 1
            ends = whose * stride + e  # sorted: by unit, then by end
            lo, hi = np.searchsorted(ends, whose * stride + s, "left"), np.searchsorted(ends, whose * stride + s, "right")
            n = np.where(s > 0, hi - lo, 0)
            second = np.repeat(np.arange(len(e)), n)
            before = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            distinct, back = np.unique(pid[before] << 32 | pid[second], return_inverse=True)
            good = stay_apart(p, distinct >> 32, distinct & 0xFFFFFFFF)[back]
            kept = np.bincount(second[good], minlength=len(e))
            ok = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(pid[before][good], pa.int32()))
            rows = pa.StructArray.from_arrays([pa.array(e, pa.int32()), pa.array(s, pa.int32()), pa.array(pid, pa.int32()), ok], fields=list(inner))
            out = pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), out.cast(arrow.field("edges").type)], schema=arrow)

    return edges.select("uid", "edges").mapInArrow(run, schema)


FOLD = """
aggregate(edges, array(named_struct('s', -1, 'pid', -1)),
  (best, x) -> if(size(best) = x.e AND (x.s = 0 OR array_contains(x.ok, element_at(best, x.s + 1).pid)),
                  concat(best, array(named_struct('s', x.s, 'pid', x.pid))), best))
"""
WALK = """
aggregate(sequence(1, size(best) - 1), named_struct('at', size(best) - 1, 'ids', cast(array() as array<int>)),
  (b, k) -> if(b.at = 0, b, named_struct('at', element_at(best, b.at + 1).s, 'ids', concat(array(element_at(best, b.at + 1).pid), b.ids))),
  b -> b.ids)
"""


def packed(s: Column, l: Column) -> Column:  # noqa: E741
    """The end and length of an edge, with room for its piece."""
    return F.shiftleft((s + l).cast("long"), 31) + F.shiftleft((LONGEST - l).cast("long"), 20)


def encode_units(distinct: DataFrame, model) -> DataFrame:
    """unit, n, ids of distinct units (unit, n): substrings, equi-join, grouping and the fold.

    Units are dealt out by number before they are exploded, so that the edges are grouped where they arise.
    An edge is packed as end (32 bits), LONGEST less its length (11) and piece (20) in one long, which sorts by end, then start.
    """
    spark, p = distinct.sparkSession, model.value
    table = F.broadcast(spark.createDataFrame(list(p.ids.items()), "piece string, pid long"))  # the model's fixed size
    numbered = saved(distinct.withColumn("uid", F.monotonically_increasing_id()))  # written, so numbers are fixed
    # a stated number of partitions: the rows are few and small here, and become many once exploded
    dealt = numbered.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "uid")
    starts = dealt.select("uid", "unit", F.explode(F.sequence(F.lit(0), F.char_length("unit") - 1)).alias("s"))
    cuts = starts.select("uid", "unit", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(p.longest), F.char_length("unit") - F.col("s")))).alias("l"))
    edges = cuts.select("uid", F.substr("unit", F.col("s") + 1, F.col("l")).alias("piece"), packed(F.col("s"), F.col("l")).alias("at"))
    grouped = edges.join(table, "piece").select("uid", (F.col("at") + F.col("pid")).alias("edge")).groupBy("uid").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    folded = _transitions(grouped, model).withColumn("best", F.expr(FOLD)).select("uid", F.expr(WALK).alias("ids"))
    return numbered.join(folded, "uid").select("unit", "n", "ids")


def _hashes(names: list[str]) -> np.ndarray:
    """128-bit hashes as two columns."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(u) for u in names]), ">u8").reshape(-1, 2)


@dataclass
class Known:
    """Frequent units: sorted hashes with checks, and where their ids lie in one long string."""

    hashes: np.ndarray
    checks: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    flat: bytes

    @staticmethod
    def of(coded: DataFrame) -> Known:
        """Hashed by the tasks; the driver receives some 20 bytes a unit, block by block."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h, ids = _hashes(strings(batch.column("unit"))), batch.column("ids")
                ends = np.asarray(ids.offsets)
                arrays = (h[:, 0].astype(np.uint64), (h[:, 1] >> 32).astype(np.uint32), np.diff(ends).astype(np.uint32), np.asarray(ids.values)[ends[0] : ends[-1]].astype(np.uint16))
                yield pa.RecordBatch.from_pydict({k: pa.array([a.tobytes()], pa.binary()) for k, a in zip("hcnf", arrays, strict=True)})

        blocks = [tuple(r) for r in coded.select("unit", "ids").mapInArrow(pack, "h binary, c binary, n binary, f binary").toLocalIterator(prefetchPartitions=True)]
        h, c, n = (np.frombuffer(b"".join(b[k] for b in blocks), t) for k, t in enumerate((np.uint64, np.uint32, np.uint32)))
        flat = b"".join(b[3] for b in blocks)
        del blocks
        starts = np.zeros(len(n), np.uint32 if len(flat) // 2 < 1 << 32 else np.uint64)
        np.cumsum(n[:-1], dtype=starts.dtype, out=starts[1:])
        if not len(n) or n.max() < 1 << 16:  # as nearly always: half the memory
            n = n.astype(np.uint16)
        order = np.argsort(h)
        return Known(h[order], c[order], starts[order], n[order], flat)

    def find(self, names: list[str]) -> list[bytes | None]:
        if not len(self.hashes) or not names:
            return [None] * len(names)
        h = _hashes(names)
        first = h[:, 0].astype(np.uint64)
        at = np.minimum(np.searchsorted(self.hashes, first), len(self.hashes) - 1)
        hit = (self.hashes[at] == first) & (self.checks[at] == (h[:, 1] >> 32).astype(np.uint32))
        begin = self.starts[at].astype(np.int64) * 2
        end, flat = begin + self.lengths[at].astype(np.int64) * 2, self.flat
        if hit.all():
            return [flat[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        return [flat[a:b] if y else None for a, b, y in zip(begin.tolist(), end.tolist(), hit.tolist(), strict=True)]


@dataclass
class Streams:
    """Ids of texts end to end, how many each text has, and the units that stand at its holes, in order."""

    ids: np.ndarray
    sizes: np.ndarray
    rare: dict[int, list[str]]

    def ends(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)])


class Coder:
    """Ids of units and words, from the shared table, with a bounded cache; units it lacks become holes."""

    def __init__(self, p: Pieces, known: Known):
        self.p, self.known = p, known
        self.words: dict[str, bytes] = {"": b""}
        self.rare: dict[str, tuple[str, ...]] = {}
        spelt = [b""] * (max(*p.ids.values(), *p.bytes_.values()) + 1)
        for piece, i in p.ids.items():
            spelt[i] = piece.replace(SPACE, " ").encode()
        for b, i in p.bytes_.items():
            spelt[i] = bytes([b])
        self.spelt = pa.array(spelt, pa.binary())

    def ids(self, names: list[str]) -> list[bytes | None]:
        """Ids of every unit; lone characters without a piece become byte pieces, other unknown units None."""
        out = self.known.find(names)
        if None in out:
            for k, (u, got) in enumerate(zip(names, out, strict=True)):
                if got is None and len(u) == 1 and u not in self.p.ids:
                    out[k] = np.array([self.p.bytes_[b] for b in u.encode("utf-8", "surrogatepass")], np.uint16).tobytes()
        return out

    def learn(self, fresh: list[str]) -> None:
        """Put words into the cache, with their holes."""
        flat, begin = units_of_words(fresh, self.p)
        coded, hole = self.ids(flat), np.uint16(HOLE).tobytes()
        if None in coded:
            for w, a, b in zip(fresh, begin, begin[1:], strict=False):
                if None in coded[a:b]:
                    self.rare[w] = tuple(u for u, x in zip(flat[a:b], coded[a:b], strict=True) if x is None)
            coded = [hole if x is None else x for x in coded]
        self.words.update((w, coded[a] if b - a == 1 else b"".join(coded[a:b])) for w, a, b in zip(fresh, begin, begin[1:], strict=False))

    def texts(self, t: pa.Array) -> Streams:
        """Streams of a slice of texts. Its words are numbered by Arrow; only distinct words are looked up one by one."""
        t = pc.fill_null(t, "")
        odd = np.asarray(_irregular(t))
        words = pc.split_pattern(pc.if_else(pa.array(odd), "", t), " ")
        coded = words.flatten().dictionary_encode()
        names, at, offsets = strings(coded.dictionary), np.asarray(coded.indices), np.asarray(words.offsets) - words.offsets[0].as_py()
        if len(self.words) > CACHE:
            known = self.words
            self.words = {w: known[w] for w in names if w in known} | {"": b""}  # what this slice needs stays
            self.rare = {w: u for w, u in self.rare.items() if w in self.words}
        self.learn([w for w in names if w not in self.words])
        parts = pa.array(list(map(self.words.__getitem__, names)), pa.binary()).take(coded.indices)
        ends = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1] // 2
        ids, sizes = np.frombuffer(parts.buffers()[2] or b"", np.uint16)[: ends[-1]], np.diff(ends[offsets]).astype(np.int64)
        rare: dict[int, list[str]] = {}
        if self.rare:
            for k in np.flatnonzero(np.array([w in self.rare for w in names], bool)[at]).tolist():
                rare.setdefault(int(np.searchsorted(offsets, k, "right")) - 1, []).extend(self.rare[names[at[k]]])
        if odd.any():
            pieces, last, doc_ends = [], 0, np.cumsum(sizes)
            for d in np.flatnonzero(odd).tolist():
                own = self.ids(g := units(t[d].as_py(), self.p))
                if None in own:
                    rare[d] = [u for u, x in zip(g, own, strict=True) if x is None]
                coded_ = np.frombuffer(b"".join([np.uint16(HOLE).tobytes() if x is None else x for x in own]), np.uint16)
                pieces += [ids[last : doc_ends[d]], coded_]
                last, sizes[d] = doc_ends[d], len(coded_)
            ids = np.concatenate([*pieces, ids[last:]])
        return Streams(ids, sizes, rare)

    def decode(self, s: Streams) -> pa.Array:
        """Bytes of every stream, with the leading mark as a space."""
        spelt = self.spelt.take(pa.array(s.ids.astype(np.int32)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(s.ends(), pa.int32()), spelt), b"")


_coders: dict[int, Coder] = cache("coders")


def _coder(model, known) -> Coder:
    got = _coders.get(id(known.value))
    if got is None:
        _coders.clear()
        got = _coders[id(known.value)] = Coder(model.value, known.value)
    return got


@contextmanager
def _grouped_by_hash(spark) -> Iterator[None]:
    """Let a task hold 100,000 units' edges (some 70 MB) before it falls back to sorting all edges; Spark's own limit is 128."""
    key = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "100000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def encode(docs: DataFrame, model_path: str | None = None, text_col: str = "text", id_col: str = "doc_id", common: int = COMMON) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (decoding gives the text back): one row an input row."""
    import public_tokenizers

    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = spark.sparkContext.broadcast(_loaded(f.read()))  # the model's pieces, of a fixed size
    kind = dict(docs.dtypes)[id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("t"))
    with _grouped_by_hash(spark):
        coded = saved(encode_units(count_units(given, model), model))
    n_units = coded.count()
    everything = n_units <= common
    known = spark.sparkContext.broadcast(Known.of(coded if everything else most_frequent(coded, "n", common)))
    schema = f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean"

    def lists(ids: np.ndarray, ends: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))

    def whole(doc_id, t):
        c = _coder(model, known)
        s = c.texts(t)
        marked = pc.binary_join_element_wise(pa.array([b" "] * len(t), pa.binary()), t.cast(pa.binary()), pa.array([b""] * len(t), pa.binary()))
        return {"doc_id": doc_id, "n_tokens": pa.array(s.sizes), "ids": lists(s.ids, s.ends()), "round_trip": pc.equal(c.decode(s), pc.if_else(pc.equal(t, ""), pa.scalar(b"", pa.binary()), marked))}

    if everything:
        return map_arrays(given.select("doc_id", "t"), whole, schema)

    def streams(doc_id, th, t):
        s = _coder(model, known).texts(t)
        ends = (2 * s.ends()).tolist()
        raw = s.ids.tobytes()
        return {"doc_id": doc_id, "th": th, "stream": [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]}

    def holes(doc_id, th, t):
        out = {"doc_id": [], "th": [], "k": [], "unit": []}
        for d, rare in sorted(_coder(model, known).texts(t).rare.items()):
            for name, v in (("doc_id", [doc_id[d].as_py()] * len(rare)), ("th", [th[d].as_py()] * len(rare)), ("k", range(len(rare))), ("unit", rare)):
                out[name] += v
        return out

    def finish(doc_id, th, stream, parts):
        p, ids, same = model.value, [], []
        for h, s, x in zip(th, stream, parts, strict=True):
            a = np.frombuffer(s, np.uint16).astype(np.int32)
            if x:
                pieces = [np.array(y["ids"], np.int32) for y in sorted(x, key=lambda y: y["k"])]
                cuts = np.split(a, np.flatnonzero(a == HOLE))
                a = np.concatenate([cuts[0], *(z for piece, c in zip(pieces, cuts[1:], strict=True) for z in (piece, c[1:]))])
            ids.append(a)
            same.append(xxhash.xxh64_intdigest(decode(a.tolist(), p).encode("utf-8", "surrogatepass"), 42) == h % (1 << 64))
        sizes = [len(a) for a in ids]
        return {"doc_id": doc_id, "n_tokens": sizes, "ids": lists(np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum(sizes)])), "round_trip": same}

    main = map_arrays(given, streams, f"doc_id {kind}, th long, stream binary")
    rare = map_arrays(given, holes, f"doc_id {kind}, th long, k int, unit string")
    filled = rare.join(coded.select("unit", "ids"), "unit").groupBy(F.col("doc_id").alias("i"), F.col("th").alias("h")).agg(F.collect_set(F.struct("k", "ids")).alias("parts"))
    joined = main.join(filled, main["doc_id"].eqNullSafe(filled["i"]) & main["th"].eqNullSafe(filled["h"]), "left").select("doc_id", "th", "stream", "parts")
    return map_batches(joined, finish, schema, at_most=256)


_spelt: dict[int, list[bytes]] = cache("spelt")


def spell(ids: list[int], p: Pieces) -> bytes:
    """Bytes of a sequence of ids: pieces with marks as spaces, and byte pieces."""
    spelt = _spelt.get(id(p))
    if spelt is None:
        spelt = [b""] * (max(*p.ids.values(), *p.bytes_.values()) + 1)
        for piece, i in p.ids.items():
            spelt[i] = piece.replace(SPACE, " ").encode()
        for b, i in p.bytes_.items():
            spelt[i] = bytes([b])
        _spelt.clear()
        _spelt[id(p)] = spelt
    return b"".join([spelt[i] for i in ids])


def decode(ids: list[int], p: Pieces) -> str:
    """Text of a sequence of ids; the leading mark is dropped."""
    text = spell(ids, p).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text
