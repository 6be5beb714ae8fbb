"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact scaled forward scores.

Tokens are lower-cased words and one end token a document. The states emit classes: each of the TOP most
frequent words is a class of its own, all other words fall into BUCKETS classes by their last bytes, inside
which a word has probability (c + 1) / (N_b + V_b + 1), unknown words sharing one place. A document's
probability is exactly the forward probability of its classes times the words' probabilities in their classes.

Word counts cover all training documents. Workers hold the COMMON most frequent words; other words meet their
counts in a shuffled join. Expected counts of every Baum-Welch step are summed over all training documents, each from
its first token to its end; a step also gives the likelihood of the model it starts from, and training ends after
``steps`` steps or when a step gains less than GAIN. Scores run over whole documents.

Defined results: null texts are empty and score their end token; repeated rows score the same; without
training rows all words are unknown; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, cache, end_task, map_batches, most_frequent, saved, slices, small_batches, words

TOP, BUCKETS, COMMON = 4096, 256, 262_144
STATES, STEPS = 4, 3
GAIN = 1e-4  # log10 likelihood a token
SLICE_BYTES = 1_000_000  # of sequences, two bytes a token, laid out together
END = b""  # no word is empty
FLUSH = 400_000
CLASSES = 1 + TOP + BUCKETS  # the end token is class 0


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


def count_words(docs: DataFrame) -> DataFrame:
    """token, bucket, c over column t; counted inside each partition first, in bounded memory."""
    schema = "token string, bucket int, c long"
    arrow = _arrow_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in counts]), pa.array([bucket_of(w) for w in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], schema=arrow)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update(words(t, lower=True))
                counts[END] += 1
                if len(counts) > FLUSH:
                    yield flush()
                    counts.clear()
        if counts:
            yield flush()

    return docs.select("t").mapInArrow(run, schema).groupBy("token", "bucket").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The COMMON most frequent words, most frequent first, and totals."""

    blob: bytes
    counts: np.ndarray
    total: int
    distinct: int
    bucket_log: np.ndarray  # log10 of N_b + V_b + 1


_kept: dict = cache("ranks")


def _ranks(blob: bytes) -> dict[bytes, int]:
    if _kept.get("blob") is not blob:
        _kept.update(blob=blob, ranks={w: i for i, w in enumerate(blob.split(b"\n"))} if blob else {})
    return _kept["ranks"]


def lexicon(counts: DataFrame) -> Lexicon:
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts.where("token <> ''"), "c", COMMON).select("token", "c", "bucket").toPandas().sort_values(["c", "token"], ascending=[False, True], ignore_index=True)
    per = counts.where("token <> ''").groupBy("bucket").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in per:
        n[r["bucket"]], v[r["bucket"]] = r["n"], r["v"]
    head = top.head(TOP)
    np.subtract.at(n, head["bucket"].to_numpy(int), head["c"].to_numpy(float))
    np.subtract.at(v, head["bucket"].to_numpy(int), 1.0)
    end = counts.where("token = ''").first()
    words_ = [w.encode() for w in top["token"]]
    return Lexicon(b"\n".join(words_), np.concatenate([[end["c"] if end else 0], top["c"].to_numpy(np.int64)]).astype(np.int64), total, distinct, np.log10(n + v + 1))


ENCODED = "doc_id {id}, held_out boolean, train boolean, n_tokens long, known long, base double, inner double, seq binary, rare array<struct<token:string,n:int>>"


def encode(docs: DataFrame, lex: Lexicon) -> DataFrame:
    """Class sequences, partial sums over common words, and the words whose counts must be joined."""
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def run(doc_id, held, train, t):
        x = shared.value
        ranks, logs = _ranks(x.blob), np.log10(x.counts + 1.0)
        out = {k: [] for k in ("doc_id", "held_out", "train", "n_tokens", "known", "base", "inner", "seq", "rare")}
        for i, h, tr, text in zip(doc_id, held, train, t, strict=True):
            w = words(text, lower=True)
            rank = np.array([ranks.get(y, -1) for y in w] + [-1], np.int64) + 1  # 0: a rare word, or the end at the end
            rare_at = np.flatnonzero(rank[:-1] == 0).tolist()
            seq = rank.copy()
            low = np.flatnonzero(rank > TOP)
            if len(low) or rare_at:
                at = low.tolist() + rare_at
                seq[at] = 1 + TOP + np.array([bucket_of(w[k]) for k in at])
            in_bucket = seq[seq > TOP] - 1 - TOP
            some = rank[:-1][rank[:-1] > 0]
            has_end = int(x.counts[0] > 0)
            for k, v in (
                ("doc_id", i), ("held_out", h), ("train", tr), ("n_tokens", len(rank)), ("known", len(some) + has_end), ("base", float(logs[some].sum() + logs[0])),
                ("inner", float(logs[rank[low]].sum() - x.bucket_log[in_bucket].sum())), ("seq", seq.astype(np.uint16).tobytes()),
                ("rare", [{"token": a.decode("utf-8", "replace"), "n": n} for a, n in Counter(w[k] for k in rare_at).items()]),
            ):
                out[k].append(v)
        return out

    return map_batches(docs.select("doc_id", "held_out", "train", "t"), run, ENCODED.format(id=dict(docs.dtypes)["doc_id"]), at_most=512)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes x states
    likelihoods: tuple[float, ...] = ()  # log10 a token, of every step's model before the step


class _Laid:
    """Sequences laid out by time: at each step, the sequences still running are a prefix."""

    def __init__(self, seqs: list[np.ndarray]):
        self.order = np.argsort([-len(s) for s in seqs], kind="stable")
        size = np.array([len(seqs[k]) for k in self.order])
        self.n = np.searchsorted(-size, -np.arange(size[0]), "left")  # sequences longer than t
        self.off = np.concatenate([[0], np.cumsum(self.n)])
        flat = np.concatenate([seqs[k] for k in self.order]).astype(np.int64)
        t = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        self.obs = np.empty(len(flat), np.int64)
        self.obs[self.off[t] + np.repeat(np.arange(len(size)), size)] = flat


def forward(m: Model, laid: _Laid, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities (states x time) and their scales, laid out by time."""
    alpha, scale = np.empty_like(emit), np.empty(emit.shape[1], emit.dtype)
    move, a = np.ascontiguousarray(m.move.T.astype(emit.dtype)), None
    for lo, hi in zip(laid.off[:-1].tolist(), laid.off[1:].tolist(), strict=True):
        a = (np.repeat(m.start.astype(emit.dtype)[:, None], hi - lo, 1) if a is None else move @ a[:, : hi - lo]) * emit[:, lo:hi]
        c = np.add.reduce(a, 0, out=scale[lo:hi])
        a = np.divide(a, c, out=alpha[:, lo:hi])
    return alpha, scale


def expected(m: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """Expected starts, moves and emissions of the sequences, their log10 likelihood and their tokens, as one flat array."""
    laid = _Laid(seqs)
    emit = m.emit.T.astype(np.float32)[:, laid.obs]
    alpha, scale = forward(m, laid, emit)
    emit /= scale
    back = np.ones_like(alpha)
    move, off = m.move.astype(np.float32), laid.off.tolist()
    for t in range(len(laid.n) - 2, -1, -1):
        lo, mid, hi = off[t], off[t + 1], off[t + 2]
        e = emit[:, mid:hi]
        e *= back[:, mid:hi]  # from here on emit holds emission times back over scale
        np.matmul(move, e, out=back[:, lo : lo + hi - mid])
    alpha_, begins = alpha, laid.n[0]
    t = np.repeat(np.arange(1, len(laid.n)), laid.n[1:])
    prev = np.arange(begins, emit.shape[1]) - (laid.off[t] - laid.off[t - 1]) if len(t) else t
    moves = m.move * (alpha_[:, prev] @ emit[:, begins:].T)
    gamma = alpha_ * back
    counts = np.stack([np.bincount(laid.obs, g, CLASSES) for g in gamma], axis=1)
    return np.concatenate([gamma[:, :begins].sum(1), moves.ravel(), counts.ravel(), [np.log10(scale).sum(dtype=float), emit.shape[1]]])


def _summed(parts: DataFrame, fan: int = 64) -> np.ndarray | None:
    """Sum of binary arrays (column g), in levels of ``fan`` so that the driver gets few."""

    def add(batches):
        total = None
        for b in batches:
            for x in b.column(0).to_pylist():
                v = np.frombuffer(x)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary())})

    n = parts.rdd.getNumPartitions()
    while n > fan:
        n = -(-n // fan)
        parts = parts.repartition(n).mapInArrow(add, "g binary")
    total = None
    for r in parts.toLocalIterator():
        v = np.frombuffer(r["g"])
        total = v.copy() if total is None else total + v
    return total


def train(encoded: DataFrame, lex: Lexicon, states: int = STATES, steps: int = STEPS, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    freq = np.ones(CLASSES) * 0.5
    freq[0] += lex.counts[0]
    top = lex.counts[1 : TOP + 1]
    freq[1 : 1 + len(top)] += top
    freq[1 + TOP :] += 10.0**lex.bucket_log
    freq /= freq.sum()
    emit = freq[:, None] * np.exp(rng.normal(0, 0.7, (CLASSES, states)))
    m = Model(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(0))
    small_batches(encoded.sparkSession)
    rows = encoded.where("train").select("seq")
    for _ in range(steps):
        shared = encoded.sparkSession.sparkContext.broadcast(m)

        def step(batches, shared=shared):
            total = None
            for b in batches:
                for part in slices(b, 2048, SLICE_BYTES):
                    got = expected(shared.value, [np.frombuffer(x, np.uint16) for x in part.column(0).to_pylist()])
                    total = got if total is None else total + got
            end_task()
            if total is not None:
                yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary())})

        got = _summed(rows.mapInArrow(step, "g binary"))
        shared.unpersist()
        if got is None:
            return m
        likelihoods = (*m.likelihoods, got[-2] / got[-1])
        if len(likelihoods) > 1 and likelihoods[-1] - likelihoods[-2] < GAIN:
            return replace(m, likelihoods=likelihoods)
        start, move, emit = got[:states] + 0.1, got[states : states + states**2].reshape(states, states) + 0.1, got[states + states**2 : -2].reshape(CLASSES, states) + 0.5 * freq[:, None] * CLASSES / 16 + 1e-3
        m = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), likelihoods)
    return m


def score(docs: DataFrame, train_flag: Column, held_out: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row an input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), train_flag.alias("train"), F.col(text_col).alias("t"))
    counts = saved(count_words(rows.where("train")))
    lex = lexicon(counts)
    encoded = saved(encode(rows, lex).withColumn("rid", F.monotonically_increasing_id()))  # written, so ids are fixed
    model = docs.sparkSession.sparkContext.broadcast(train(encoded, lex))
    rare = encoded.select("rid", F.explode("rare").alias("w")).select("rid", "w.token", "w.n").join(counts.select("token", "c"), "token", "left")
    rare = rare.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("lg"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more"))

    kept = ("rid", "doc_id", "held_out", "n_tokens", "known", "base", "inner")

    def run(seq, *rest):
        seqs = [np.frombuffer(s, np.uint16) for s in seq]
        laid = _Laid(seqs)
        _, scale = forward(model.value, laid, model.value.emit.T[:, laid.obs])
        local = np.concatenate([np.arange(k) for k in laid.n])
        sums = np.bincount(local, np.log10(scale))
        out = np.empty(len(seqs))
        out[laid.order] = sums
        return dict(zip(kept, rest, strict=True)) | {"path": out.tolist()}

    kinds = dict(encoded.dtypes)
    paths = map_batches(encoded.select("seq", *kept), run, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", path double", most_bytes=SLICE_BYTES)
    out = paths.join(rare, "rid", "left")
    lg, more = F.coalesce("lg", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + more).cast("long").alias("n_known"),
        F.lit(int(lex.total)).cast("long").alias("train_tokens"),
        (F.col("base") + lg - F.col("n_tokens") * F.log10(F.lit(float(lex.total + lex.distinct + 1)))).alias("base_score"),
        (F.col("path") + F.col("inner") + lg).alias("score"),
    )
