"""Suffix-array dedup: removal of every byte inside a string of 200 bytes that also starts elsewhere.

Sorting all suffixes of a corpus in one order is replaced by sorting inside buckets. Every 200-byte window
names an anchor, the 32-byte gram of the least hash inside it, so equal windows name equal anchors at equal
offsets. A run of windows with one anchor is a *context* of under 400 bytes.

1. A narrow pass over whole documents takes contexts with their prefix polynomial hashes.
2. Anchors that occur once are dropped after partial aggregation. Contexts whose hashes agree over their whole
   extension (the first probe of the comparison) are repeated in full; a digest of other make verifies this.
3. Distinct contexts of buckets that hold several go to a bucketed suffix sort. Suffixes are ordered by
   mergesort; a comparison finds the common extension by binary search over prefix hashes, in about eight
   probes. Neighbours that share 200 bytes are repeated, and this is verified byte by byte. Buckets of more
   than SPLIT contexts take another exact way: their windows are counted by two hashes, aggregated on the map
   side, so that no task gets a whole bucket.
4. Spans are gathered by document and taken out.

Defined results: null texts are empty; texts under 200 bytes lose nothing; repeated rows repeat each other;
null ids are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, cache, map_batches, reserve, saved, slices

LENGTH = 200
GRAM = 32
REACH = LENGTH - GRAM + 1
PIECE = 1 << 20
SPLIT = 4096  # contexts of a bucket that one task sorts
CHUNK = 2048  # contexts sorted together, at least
LOW = np.uint64(PIECE - 1)
FILTER_BITS = 24


BASE = 0x9E3779B97F4A7C15
#: Random odd codes for bytes.
CODES = np.random.default_rng(11).integers(1, 1 << 63, 256).astype(np.uint64) | np.uint64(1)


_kept: dict[int, tuple[np.ndarray, np.ndarray]] = cache("powers")


def _tables(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """2^bits powers of an odd base, and of its inverse, modulo 2^64."""
    if bits not in _kept:
        _kept[bits] = _powers(bits)
    return _kept[bits]


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full((1 << bits) - 1, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _tables(max(20, int(n).bit_length()))


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(CODES[raw] * powers(len(raw))[0][: len(raw)], out=out[1:])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def contexts(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of documents laid end to end in at most PIECE bytes: first and last window start, anchor, its hash."""
    n = len(raw)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = prefix_hashes(raw)
    grams = _mix((h[GRAM:] - h[:-GRAM]) * powers(n)[1][: n - GRAM + 1])
    at = np.arange(len(grams), dtype=np.uint64)
    keys = (grams & ~LOW) | (LOW - at)  # least hash first, the rightmost of equals
    pad = -len(keys) % REACH
    blocks = np.concatenate([keys, np.full(pad, ~np.uint64(0))]).reshape(-1, REACH)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - LENGTH + 1
    anchors = (LOW - (np.minimum(tail[:count], head[REACH - 1 : REACH - 1 + count]) & LOW)).astype(np.int64)
    edge = np.zeros(n + 2, np.int32)
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= LENGTH
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - LENGTH + 1, -1)
    s = np.flatnonzero(np.cumsum(edge)[:count] > 0)
    if not len(s):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    p = anchors[s]
    new = np.flatnonzero((np.diff(p) != 0) | (np.diff(s) != 1))
    first, last = np.concatenate([[0], new + 1]), np.concatenate([new, [len(s) - 1]])
    return s[first], s[last], p[first], grams[p[first]]


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, list[tuple[int, int]]]]:
    """Documents packed into buffers of at most PIECE bytes: buffer, ends, and (document, offset) of each part."""
    parts, where, size = [], [], 0
    for k, t in enumerate(texts):
        for off in range(0, max(1, len(t) - LENGTH + 1), PIECE - LENGTH - 1):
            part = t[off : off + PIECE - 2]
            if size + len(part) > PIECE - 2 and parts:
                yield b"".join(parts), np.cumsum([len(x) for x in parts]), where
                parts, where, size = [], [], 0
            parts.append(part)
            where.append((k, off))
            size += len(part)
    if parts:
        yield b"".join(parts), np.cumsum([len(x) for x in parts]), where


def _scan(texts: list[str | None]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Contexts by buffer: the buffer, document, offset in it, s1, s2, anchor (in the buffer), hash, digest of the whole context."""
    for buf, ends, where in _pieces([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        s1, s2, p, ha = contexts(np.frombuffer(buf, np.uint8), ends)
        if not len(s1):
            continue
        part = np.searchsorted(ends, s1, "right")
        starts = np.concatenate([[0], ends[:-1]])
        doc, off = (np.array([w[i] for w in where], np.int64) for i in (0, 1))
        view, digest = memoryview(buf), xxhash.xxh3_64_intdigest
        hi = np.array([digest(view[a:b], c) for a, b, c in zip(s1.tolist(), (s2 + LENGTH).tolist(), (p - s1).tolist(), strict=True)], np.uint64)
        yield buf, doc[part], off[part] - starts[part], s1, s2, p, ha, hi


SCAN = "did long, th long, s1 int, s2 int, ha long, hi long"


def scan(docs: DataFrame) -> DataFrame:
    def run(did, th, t):
        out: dict[str, list] = {k: [] for k in ("did", "th", "s1", "s2", "ha", "hi")}
        for _, doc, shift, s1, s2, _, ha, hi in _scan(t):
            for k, v in (("did", np.array(did)[doc]), ("th", np.array(th)[doc]), ("s1", s1 + shift), ("s2", s2 + shift), ("ha", ha.view(np.int64)), ("hi", hi.view(np.int64))):
                out[k].append(v)
        return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}

    return map_batches(docs, run, SCAN, at_most=512)


def _filter_of(anchors: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the low bits of anchor hashes; false hits only cost work."""
    slot = F.col("ha").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    got = anchors.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((ha & {(1 << FILTER_BITS) - 1}) % 64 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def scan_bytes(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Contexts with their bytes, of anchors that ``wanted`` admits."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(did, th, t):
        out: dict[str, list] = {k: [] for k in ("did", "th", "s1", "ha", "hi", "d", "body")}
        for buf, doc, shift, s1, s2, p, ha, hi in _scan(t):
            for i in np.flatnonzero(shared.value[(ha & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]).tolist():
                for k, v in (("did", did[doc[i]]), ("th", th[doc[i]]), ("s1", int(s1[i] + shift[i])), ("ha", int(ha[i].view(np.int64))), ("hi", int(hi[i].view(np.int64))), ("d", int(p[i] - s1[i])), ("body", buf[s1[i] : s2[i] + LENGTH])):
                    out[k].append(v)
        return out

    return map_batches(docs, run, "did long, th long, s1 int, ha long, hi long, d int, body binary", at_most=512)


class Suffixes:
    """Suffixes of byte strings laid end to end, compared by prefix hashes up to LENGTH bytes."""

    def __init__(self, raw: np.ndarray):
        self.raw = np.concatenate([raw, np.zeros(LENGTH, np.uint8)])
        self.h = prefix_hashes(self.raw)
        self.inverse = powers(len(self.raw))[1]

    def extend(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common extensions of suffixes x and y, LENGTH at most, by binary search over prefix hashes."""
        lo, hi = np.zeros(len(x), np.int64), np.full(len(x), LENGTH, np.int64)
        hx, hy, ix, iy = self.h[x], self.h[y], self.inverse[x], self.inverse[y]
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_] + 1) >> 1
            same = (self.h[x[open_] + mid] - hx[open_]) * ix[open_] == (self.h[y[open_] + mid] - hy[open_]) * iy[open_]
            lo[open_] = np.where(same, mid, lo[open_])
            hi[open_] = np.where(same, hi[open_], mid - 1)

    def before(self, x: np.ndarray, y: np.ndarray, or_equal: bool) -> np.ndarray:
        n = self.extend(x, y)
        a, b = self.raw[np.minimum(x + n, len(self.raw) - 1)], self.raw[np.minimum(y + n, len(self.raw) - 1)]
        return np.where(n >= LENGTH, or_equal, a < b)

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Mergesort inside groups (runs of equal ``group``): each element's place in a merge is its own index plus its rank in the sister run, found by binary search for all elements at once."""
        n = len(at)
        start = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
        size = np.diff(np.concatenate([start, [n]]))
        base, count = np.repeat(start, size), np.repeat(size, size)
        local = np.arange(n) - base
        at, width = at.copy(), 1
        while width < (size.max() if n else 0):
            run = local // width
            left = run % 2 == 0
            sister = base + np.where(left, run + 1, run - 1) * width
            end = np.minimum(sister + width, base + count)
            lo, hi = np.minimum(sister, end), end.copy()
            first = lo.copy()
            while len(open_ := np.flatnonzero(lo < hi)):
                mid = (lo[open_] + hi[open_]) >> 1
                # elements of the left run go before equal ones of the right run
                low = np.empty(len(open_), bool)
                is_left = left[open_]
                low[is_left] = self.before(at[mid[is_left]], at[open_[is_left]], False)
                low[~is_left] = self.before(at[mid[~is_left]], at[open_[~is_left]], True)
                lo[open_] = np.where(low, mid + 1, lo[open_])
                hi[open_] = np.where(low, hi[open_], mid)
            place = base + (run // 2) * 2 * width + (local - run * width) + (lo - first)
            merged = np.empty_like(at)
            merged[place] = at
            at, width = merged, width * 2
        return at


def repeated_windows(bodies: list[bytes], bucket: np.ndarray, d: np.ndarray) -> list[list[tuple[int, int]]]:
    """Per context, ranges (first, last window) that a context of the same bucket repeats."""
    size = np.array([len(b) for b in bodies], np.int64)
    begin = np.cumsum(size) - size
    sa = Suffixes(np.frombuffer(b"".join(bodies), np.uint8))
    n_windows = size - LENGTH + 1
    owner = np.repeat(np.arange(len(bodies)), n_windows)
    w = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    at = begin[owner] + w
    offset = d[owner] - w + LENGTH  # equal windows hold the anchor at equal offsets
    order = np.lexsort((offset, bucket[owner]))
    owner, w, at, offset = owner[order], w[order], at[order], offset[order]
    group = np.cumsum(np.concatenate([[0], (np.diff(bucket[owner]) != 0) | (np.diff(offset) != 0)])) if len(at) else at
    ranked = sa.sort(at, group)
    same = np.zeros(len(at) + 1, bool)
    if len(at) > 1:
        cand = np.flatnonzero(group[1:] == group[:-1])
        cand = cand[sa.extend(ranked[cand], ranked[cand + 1]) >= LENGTH]
        raw = sa.raw.tobytes()
        true = [i for i in cand.tolist() if raw[(a := ranked[i]) : a + LENGTH] == raw[(b := ranked[i + 1]) : b + LENGTH]]
        same[np.array(true, np.int64) + 1] = True  # i + 1 repeats its left neighbour
    hit = np.sort(ranked[same[:-1] | same[1:]])
    out: list[list[tuple[int, int]]] = [[] for _ in bodies]
    whose = np.searchsorted(begin, hit, "right") - 1
    cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(whose) != 0))
    for a, b in zip(np.concatenate([[0], cut + 1]).tolist(), np.concatenate([cut, [len(hit) - 1]]).tolist(), strict=True) if len(hit) else ():
        k = int(whose[a])
        out[k].append((int(hit[a] - begin[k]), int(hit[b] - begin[k])))
    return out


def _count_windows(ctx: DataFrame) -> DataFrame:
    """Spans of contexts that stand alone in large buckets: windows counted by a prefix hash and a digest."""

    def run(did, th, s1, d, body, alone):
        out: dict[str, list] = {c: [] for c in ("did", "th", "a", "h", "v", "alone")}
        for i, text, start, off, raw, lone in zip(did, th, s1, d, body, alone, strict=True):
            h, n = prefix_hashes(np.frombuffer(raw, np.uint8)), len(raw) - LENGTH + 1
            full = _mix((h[LENGTH:] - h[:n]) * powers(n)[1][:n]).view(np.int64)
            digest = np.array([xxhash.xxh3_64_intdigest(raw[w : w + LENGTH]) for w in range(n)], np.uint64).view(np.int64)
            for c, v in (("did", np.full(n, i)), ("th", np.full(n, text)), ("a", start + np.arange(n)), ("h", full), ("v", digest), ("alone", np.full(n, lone))):
                out[c].append(v)
        return {c: np.concatenate(v) if v else np.zeros(0, bool if c == "alone" else np.int64) for c, v in out.items()}

    rows = saved(map_batches(ctx.select("did", "th", "s1", "d", "body", "alone"), run, "did long, th long, a int, h long, v long, alone boolean", at_most=256))
    twice = rows.groupBy("h", "v").agg(F.count("*").alias("n")).where("n > 1").select("h", "v")
    return rows.where("alone").join(twice, ["h", "v"]).select("did", "th", "a", (F.col("a") + LENGTH).alias("b"))


def _solve(rows: DataFrame) -> DataFrame:
    """Spans of contexts that stand alone, by suffix sorts over whole buckets."""
    schema = "did long, th long, a int, b int"
    arrow = _arrow_schema(rows.sparkSession, schema)

    def answer(rows_: list[dict]) -> pa.RecordBatch:
        got = repeated_windows([r["body"] for r in rows_], np.array([r["ha"] for r in rows_]), np.array([r["d"] for r in rows_]))
        out = [{"did": r["did"], "th": r["th"], "a": r["s1"] + a, "b": r["s1"] + b + LENGTH} for r, spans in zip(rows_, got, strict=True) if r["alone"] for a, b in spans]
        return pa.RecordBatch.from_pylist(out, arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                # only whole buckets are solved; one bucket is SPLIT contexts at most
                if len(held) >= CHUNK and r["ha"] != held[-1]["ha"]:
                    yield answer(held)
                    held = []
                held.append(r)
        if held:
            yield answer(held)

    return rows.repartition("ha").sortWithinPartitions("ha").mapInArrow(run, schema)


def keyed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents with a key of id and text (__did, __th), by which spans find them again."""
    reserve(docs, "__did", "__th", "__spans")
    return docs.withColumns({"__did": F.coalesce(F.expr(f"try_cast(`{id_col}` AS BIGINT)"), F.lit(-(1 << 63))), "__th": F.xxhash64(F.col(text_col))})


HOT = 1024


def _hot(counts: DataFrame, n: str, key: Column, flag: Column) -> tuple[int, dict]:
    """Keys with more than 1/HOT of all rows, HOT of them at most, with a flag; and that number of rows."""
    least = max(1, (counts.agg(F.sum(n)).first()[0] or 0) // HOT)
    return least, {r["k"]: r["f"] for r in counts.where(F.col(n) > least).select(key.alias("k"), flag.alias("f")).collect()}


def _among(key: Column, values) -> Column:
    return key.isin(list(values)) if values else F.lit(False)


def _anchored(found: DataFrame) -> DataFrame:
    """The contexts whose anchor occurs more than once, with mixed: whether its contexts differ. Rows of the hottest
    anchors stay where they are; all others are shuffled to their anchor's counts."""
    anchors = saved(found.groupBy("ha").agg(F.count("*").alias("m"), (F.min("hi") != F.max("hi")).alias("mixed")))
    least, hot = _hot(anchors, "m", F.col("ha"), F.col("mixed"))
    cold = saved(anchors.where((F.col("m") > 1) & (F.col("m") <= least)).select("ha", "mixed"))
    here = _among(F.col("ha"), hot)
    return found.where(here).withColumn("mixed", _among(F.col("ha"), [k for k, mixed in hot.items() if mixed])).unionByName(found.where(~here).join(cold, "ha"))


def _repeated(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """The rows whose context (ha, hi) occurs more than once by its count n in ``kinds``, the hottest again in place."""
    name = F.concat_ws(":", "ha", "hi")
    least, hot = _hot(kinds, "n", name, F.lit(True))
    cold, here = kinds.where((F.col("n") > 1) & (F.col("n") <= least)).select("ha", "hi"), _among(name, hot)
    # the join puts its keys first
    return rows.where(here).unionByName(rows.where(~here).join(cold, ["ha", "hi"], "left_semi"))


def spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", split: int = SPLIT) -> DataFrame:
    """__did, __th and __spans, an array of repeated byte ranges (a, b), for documents that have any."""
    given = keyed(docs, text_col, id_col).select(F.col("__did").alias("did"), F.col("__th").alias("th"), F.col(text_col).alias("t"))
    found = saved(scan(given))
    rows = saved(_anchored(found))
    mixed = rows.where("mixed").groupBy("ha", "hi").agg(F.count("*").alias("n"))
    kinds = saved(mixed)
    full = rows.where("not mixed").select("did", "th", "s1", "s2").unionAll(_repeated(rows.where("mixed"), kinds).select("did", "th", "s1", "s2"))
    buckets = saved(kinds.groupBy("ha").agg(F.count("*").alias("k")))
    known = kinds.join(buckets, "ha").select("ha", "hi", "k", (F.col("n") == 1).alias("alone"))
    bodies = scan_bytes(given, _filter_of(buckets)).groupBy("ha", "hi").agg(F.min(F.struct("did", "th", "s1", "d", "body")).alias("r"))
    ctx = bodies.join(known, ["ha", "hi"]).select("ha", "k", "alone", "r.*")
    if (most := buckets.agg(F.max("k")).first()[0] or 0) > split:
        ctx = saved(ctx)
    partial = _solve(ctx.where(F.col("k") <= split))
    if most > split:
        partial = partial.unionAll(_count_windows(ctx.where(F.col("k") > split)))
    every = full.select("did", "th", F.col("s1").alias("a"), (F.col("s2") + LENGTH).alias("b")).unionAll(partial)
    return every.groupBy(F.col("did").alias("__did"), F.col("th").alias("__th")).agg(F.collect_list(F.struct("a", "b")).alias("__spans"))


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove(raw: bytes, ranges: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in ranges:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row an input row."""
    kind = dict(docs.dtypes)[id_col]
    joined = keyed(docs, text_col, id_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), "__did", "__th").join(spans(docs, text_col, id_col, split), ["__did", "__th"], "left")

    def run(doc_id, t, ranges):
        out = []
        for i, text, r in zip(doc_id, t, ranges, strict=True):
            raw, cut = (text or "").encode("utf-8", "surrogatepass"), merged(r)
            out.append((i, len(raw), sum(b - a for a, b in cut), len(cut), hashlib.sha256(remove(raw, cut)).hexdigest()))
        return dict(zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), zip(*out, strict=True) if out else ([],) * 5, strict=True))

    return map_batches(joined.select("doc_id", "t", "__spans"), run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents without their repeated bytes, all columns kept; a character goes when any of its bytes does."""
    columns = docs.columns
    joined = keyed(docs, text_col, id_col).join(spans(docs, text_col, id_col), ["__did", "__th"], "left")

    @F.arrow_udf("string")
    def cut(text: pa.Array, ranges: pa.Array) -> pa.Array:
        parts = slices(pa.RecordBatch.from_arrays([text, ranges], ["t", "r"]), 512, 2_000_000)
        rows = (zip(*(c.to_pylist() for c in p.columns), strict=True) for p in parts)
        return pa.array([None if t is None else remove(t.encode("utf-8", "surrogatepass"), merged(r)).decode("utf-8", "ignore") for part in rows for t, r in part], pa.string())

    # a text that loses nothing stays in the JVM
    shorter = F.col("__spans").isNotNull() & F.col(text_col).isNotNull()
    return joined.withColumn(text_col, F.when(shorter, cut(F.when(shorter, F.col(text_col)), F.col("__spans"))).otherwise(F.col(text_col))).select(*(f"`{c}`" for c in columns))
