"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document becomes a sparse vector: hashed words (square root of the count, scaled to length one), one-hot
bins of structure statistics taken from its byte histogram, and one-hot bins of numeric metadata columns.
The score is sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]); the last term is
the sum-of-squares identity, so scoring is linear in the features. Gradients are computed by Spark tasks and
summed; only parameters of a fixed size pass through the driver.

Defined results: a null text counts as empty; an empty text is scored from its (empty) statistics; null
or infinite metadata falls into a bin of its own; repeated rows get equal scores; an empty table gives an empty result;
without any labelled row, or with one class alone, the bias alone is learnt. Further input columns, whatever
their names, are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin_task, bounded_labels, end_task, map_batches, saved, slices, small_batches

WORD_BITS = 15
BIN_SLOTS = 1024  # one-hot bins live behind the word buckets
SIZE = (1 << WORD_BITS) + BIN_SLOTS
RANK = 6
#: Labelled rows used for training at most; smallest salted hashes first.
MAX_TRAIN_ROWS = 8192
STEPS = 24
BINS = 16


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def _classes() -> np.ndarray:
    """Bytes by kind: upper, lower, digit, space, newline, sentence marks, exclamations, other marks, non-ASCII."""
    kind = np.full(256, 7)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 0, 1, 2, 8
    kind[[32, 9, 11, 12, 13]], kind[10] = 3, 4
    kind[[44, 46, 59, 58, 63, 39, 34]], kind[33] = 5, 6
    return kind


CLASSES = _classes()


def structure(raw: bytes, tokens: list[bytes], counts: Counter) -> list[float]:
    n, w = max(1, len(raw)), max(1, len(tokens))
    by_kind = np.bincount(CLASSES, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 9) / n
    lines = [x for x in raw.split(b"\n") if x]
    return [*by_kind.tolist(), len(counts) / w, (len(raw) / w) / 20, 1 - len(set(lines)) / max(1, len(lines)), len(raw) / max(1, len(lines)) / 400, np.log2(n) / 20]


def vector(text: str | None, meta: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of one document."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    tokens = raw.split()
    counts = Counter(tokens)
    mask = (1 << WORD_BITS) - 1
    idx = [zlib.crc32(t) & mask for t in counts]
    val = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))
    val /= max(1e-9, np.sqrt((val * val).sum()))
    stats = structure(raw, tokens, counts)
    levels = [min(BINS - 2, int(np.sqrt(min(1.0, max(0.0, s))) * (BINS - 2))) for s in stats]
    levels += [BINS - 1 if m is None or not np.isfinite(m) else min(BINS - 2, max(0, int(np.log2(abs(float(m)) + 1) * 0.6))) for m in meta]
    bins = [(1 << WORD_BITS) + (k * BINS + v) % BIN_SLOTS for k, v in enumerate(levels)]
    return np.array(idx + bins, np.int32), np.concatenate([val, np.full(len(bins), 0.3)]).astype(np.float32)


def _raw_scores(model: Model, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores by the sum-of-squares identity, of rows laid end to end; every row has features."""
    vx = model.factors[idx] * val[:, None]
    sums = np.add.reduceat(vx, starts, axis=0)
    squares = np.add.reduceat((vx * vx).sum(1), starts)
    linear = np.add.reduceat(model.linear[idx] * val, starts)
    return model.bias + linear + 0.5 * ((sums * sums).sum(1) - squares), sums, vx


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", meta_cols: tuple[str, ...] = (), label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS, seed: int = 1) -> Model:
    """Full-batch Adam; each step is one Spark job whose tasks return gradient sums."""
    spark = docs.sparkSession
    rng = np.random.default_rng(seed)
    model = Model(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, RANK)).astype(np.float32))
    sample = bounded_labels(labels, label_col, max_rows, seed)
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), *(F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(meta_cols)))
    rows = given.join(F.broadcast(sample), "doc_id").select("doc_id", "t", "label", *(f"m{i}" for i in range(len(meta_cols))))

    def featurise(doc_id, t, label, *meta):
        got = [vector(x, m) for x, m in zip(t, zip(*meta, strict=True) if meta else [()] * len(t), strict=True)]
        return {"doc_id": doc_id, "label": label, "idx": [i.tobytes() for i, _ in got], "val": [v.tobytes() for _, v in got]}

    # one row an id, so that repeated rows do not add to the sample; a shuffle of the few labelled rows, before which the scan keeps all its tasks
    made = map_batches(rows, featurise, f"doc_id {dict(rows.dtypes)['doc_id']}, label int, idx binary, val binary")
    feats = saved(made.groupBy("doc_id").agg(F.min(F.struct("label", "idx", "val")).alias("r")).select("r.*").coalesce(8))
    n_of = {r["label"]: r["n"] for r in feats.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n_of) < 2:
        model.bias, model.factors = 0.0 if not n_of else (4.0 if 1 in n_of else -4.0), np.zeros_like(model.factors)
        return model
    total = sum(n_of.values())
    weight = {k: total / (2 * n) for k, n in n_of.items()}
    params = [np.zeros(1), model.linear.astype(np.float64), model.factors.astype(np.float64)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        now = spark.sparkContext.broadcast(Model(float(params[0][0]), params[1].astype(np.float32), params[2].astype(np.float32)))

        def gradient(batches, now=now):
            m, g0, g1, g2 = now.value, 0.0, np.zeros(SIZE), np.zeros((SIZE, RANK))
            for b in batches:
                label, idx, val = (c.to_pylist() for c in b.columns)
                parts = [np.frombuffer(x, np.int32) for x in idx]
                if not parts:
                    continue
                sizes = np.array([len(x) for x in parts])
                at, x = np.concatenate(parts), np.concatenate([np.frombuffer(v, np.float32) for v in val])
                z, sums, vx = _raw_scores(m, at, x, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
                d = (_sigmoid(z) - np.array(label)) * np.array([weight[y] for y in label])
                dx = np.repeat(d, sizes) * x
                g0 += d.sum()
                g1 += np.bincount(at, dx, SIZE)
                pull = dx[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
                for f in range(RANK):
                    g2[:, f] += np.bincount(at, pull[:, f], SIZE)
            yield pa.RecordBatch.from_pydict({"g": [np.concatenate([[g0], g1, g2.ravel()]).astype(np.float32).tobytes()]})

        got = sum(np.frombuffer(r["g"], np.float32).astype(np.float64) for r in feats.mapInArrow(gradient, "g binary").toLocalIterator()) / total
        grads = [got[:1], got[1 : 1 + SIZE] + 1e-5 * params[1], got[1 + SIZE :].reshape(SIZE, RANK) + 1e-5 * params[2]]
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= 0.08 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        now.unpersist()
    return Model(float(params[0][0]), params[1].astype(np.float32), params[2].astype(np.float32))


def score_column(spark: SparkSession, model: Model, text: Column, *meta: Column) -> Column:
    """The score of a whole text as a column; only the text and the metadata go to Python, all else stays in the JVM."""
    shared = spark.sparkContext.broadcast(model)
    small_batches(spark)

    def of(batch: pa.RecordBatch) -> np.ndarray:
        t, *m = (c.to_pylist() for c in batch.columns)
        vectors = [vector(x, y) for x, y in zip(t, zip(*m, strict=True) if m else [()] * len(t), strict=True)]
        starts = np.concatenate([[0], np.cumsum([len(i) for i, _ in vectors])[:-1]]).astype(np.int64)
        z = _raw_scores(shared.value, np.concatenate([i for i, _ in vectors]), np.concatenate([v for _, v in vectors]), starts)[0]
        return _sigmoid(z.astype(np.float64))

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        begin_task(owner)
        for given in batches:
            columns = [given] if isinstance(given, pa.Array) else given  # one column alone comes without a tuple
            batch = pa.RecordBatch.from_arrays(list(columns), [str(k) for k in range(len(columns))])
            yield pa.array(np.concatenate([np.zeros(0), *(of(part) for part in slices(batch, 512, 2_000_000))]))
        end_task()

    owner = uuid.uuid4().hex
    return F.arrow_udf(run, "double")(text, *(c.cast("double") for c in meta))


def score(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id", meta_cols: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted: one row an input row, in a narrow pass over whole texts."""
    p = score_column(docs.sparkSession, model, F.col(text_col), *(F.col(c) for c in meta_cols))
    return docs.select(F.col(id_col).alias("doc_id"), p.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", meta_cols: tuple[str, ...] = ()) -> DataFrame:
    """The rows that score 0.5 or more, with their own columns alone, whatever these are named."""
    return docs.where(score_column(docs.sparkSession, model, F.col(text_col), *(F.col(c) for c in meta_cols)) >= 0.5)
