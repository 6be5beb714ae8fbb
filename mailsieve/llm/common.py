"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than ASCII white space: ``bytes.split`` cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A folder of our own is taken in local mode only, where one machine does all."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='mailsieve-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mailsieve-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reserve(df: DataFrame, *names: str) -> None:
    """Refuse a table that has a column of a name which an operator needs for itself; case does not count."""
    if taken := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"rename the columns {sorted(taken)}: these names are reserved")


def keyed(df: DataFrame) -> DataFrame:
    """Adds __row, a 128-bit hash of all columns: rows are told apart where ids are null or repeat."""
    reserve(df, "__row", "__n")
    parts = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    half = lambda salt: F.lpad(F.hex(F.xxhash64(F.lit(salt), *parts)), 16, "0")
    return df.withColumn("__row", F.unhex(F.concat(half(1), half(2))))


def keep_first(own: DataFrame, of: DataFrame) -> DataFrame:
    """One row of the keyed ``own`` for each component of ``of`` (__row, doc_id, component): smallest id, null last, then hash."""
    first = of.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("x"))
    kept = own.join(first.select(F.col("x.__row").alias("__row")), "__row", "left_semi")
    one = Window.partitionBy("__row").orderBy("__row")
    return kept.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n", "__row")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id has remainder null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fold_flag(doc_id: Column, n: int, remainder: int) -> Column:
    """True for the held-out fold; rows without an id are never held out."""
    return F.coalesce(crc_mod(doc_id, n) == remainder, F.lit(False))


#: What workers keep between batches, by name; emptied when a worker turns to another function's tasks.
caches: dict[str, dict] = {}
_owner: list[str] = []


def cache(name: str) -> dict:
    return caches.setdefault(name, {})


def begin_task(owner: str) -> None:
    if _owner != [owner]:
        for kept in caches.values():
            kept.clear()
        _owner[:] = [owner]


def end_task() -> None:
    """Workers live on; the memory that this task no longer needs goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, at_most: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of ``at_most`` rows and ``most_bytes`` bytes of text at most; a longer row comes alone."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
        elif pa.types.is_list(column.type):
            size += 16 * np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most_bytes, "right"))
        end = min(batch.num_rows, at + at_most, max(at + 1, full))
        yield batch.slice(at, end - at)
        at = end


BATCH_BYTES, SPARK_BATCH_BYTES = "4m", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB, where the session has Spark's own 64 MB: several are in memory at a time on both sides."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == SPARK_BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def strings(column: pa.Array) -> list:
    """The same as ``to_pylist`` for texts, several times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


def map_batches(df: DataFrame, fn: Callable[..., dict], schema: str, at_most: int = 2048, most_bytes: int = 4_000_000) -> DataFrame:
    """Apply ``fn(*column lists) -> dict of column lists`` to bounded slices of each Arrow batch, without a shuffle."""
    return map_arrays(df, lambda *columns: fn(*(c.to_pylist() for c in columns)), schema, at_most, most_bytes)


def map_arrays(df: DataFrame, fn: Callable[..., dict], schema: str, at_most: int = 2048, most_bytes: int = 4_000_000) -> DataFrame:
    """The same for a function of Arrow arrays."""
    spark = df.sparkSession
    small_batches(spark)
    arrow = _arrow_schema(spark, schema)
    owner = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(owner)
        for batch in batches:
            for part in slices(batch, at_most, most_bytes):
                out = fn(*part.columns)
                yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x := out[f.name], pa.Array) else pa.array(x, f.type) for f in arrow], schema=arrow)
        end_task()

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.translate(ASCII_LOWER) if lower else raw).split()


def hash_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About nine tenths of ``most`` rows, those of the smallest hashes; all rows if there are no more than ``most``.

    The share follows from a count, so no partition's candidates are gathered; ``most`` lies many standard
    deviations above what is kept.
    """
    n = df.count()
    return df if n <= most else df.where(F.pmod(key, F.lit(1 << 40)) < F.lit(int((1 << 40) * 0.9 * most / n)))


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the highest counts, ``most`` at most. The cut lies between levels of a 64th of an octave, whose
    histogram is of bounded size; rows of the level that would not fit whole stay out."""
    level = F.floor(F.log2(F.col(count).cast("double")) * 64)
    left, cut = most, -1
    for r in sorted(df.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        left -= r["n"]
        if left < 0:
            cut = r["level"]
            break
    return df.where(level > cut)


def bounded_labels(labels: DataFrame, column: str, most: int, salt: int) -> DataFrame:
    """At most ``most`` labelled ids, the smallest by a salted hash: a sample that repeats. One row an id."""
    kept = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    one = kept.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    return hash_sample(one, F.xxhash64(F.col("doc_id"), F.lit(salt)), most)
