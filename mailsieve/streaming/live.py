"""Streaming forms of the operators across messages; each gives what its batch form gives over the same rows.

Replays, familiarity and style fold a key's rows in order of event time, in whatever micro-batch they come: a row is given
out when the watermark has passed it, rows later than that are dropped, and a key that is idle for EXPIRY_DAYS is forgotten.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import mailbox
from ..operators.history import IDLE_SECONDS, subject_bucket


#: A key that has had no row for so long, in event time, begins anew.
EXPIRY_DAYS = 400
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ordered(StatefulProcessor):
    """Holds a key's rows back until the watermark has passed them, then folds them in order of time.

    Rows wait in a map by millisecond, and every millisecond has a timer; so what micro-batch a row comes in makes no
    difference. A key's state is dropped ``expiry_ms`` after its last row. State and rows are kept as JSON texts.
    """

    def __init__(self, keys: list[str], columns: list[str], out: list[str], start, step, order: list[str], expiry_ms: int):
        self.keys, self.columns, self.out, self.start, self.step, self.order, self.expiry_ms = keys, columns, out, start, step, order, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "rows string")
        self.held = handle.getValueState("held", "state string, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        fresh: dict[int, list] = {}
        for pdf in rows:
            at = (pdf["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            for t, row in zip(at, pdf[self.columns].assign(ts=pdf["ts"].astype("datetime64[us]").astype("int64")).to_dict("records"), strict=True):
                if t > passed:  # later ones are late, and Spark drops those itself as a rule
                    fresh.setdefault(t, []).append({k: v.item() if hasattr(v, "item") else v for k, v in row.items()})
        for t, more in fresh.items():
            if self.waiting.containsKey((t,)):
                more = json.loads(self.waiting.getValue((t,))[0]) + more
            else:
                self.handle.registerTimer(t)
            self.waiting.updateValue((t,), (json.dumps(more),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        state, last = self.start, None
        if self.held.exists():
            text, last = self.held.get()
            state = json.loads(text)
        if not self.waiting.containsKey((at,)):
            if last is not None and last + self.expiry_ms <= at:
                self.held.clear()
            return
        if last is not None:
            self.handle.deleteTimer(last + self.expiry_ms)
            if at - last > self.expiry_ms:
                state = self.start
        named, made = dict(zip(self.keys, key, strict=True)), []
        for row in sorted(json.loads(self.waiting.getValue((at,))[0]), key=lambda r: [r[c] for c in self.order]):
            state, got = self.step(state, named, row)
            made.append(got)
        self.waiting.removeKey((at,))
        self.held.update((json.dumps(state), at))
        self.handle.registerTimer(at + self.expiry_ms)
        yield pd.DataFrame(made, columns=self.out)

    def close(self) -> None:
        pass


def _fold(stream: DataFrame, keys: list[str], columns: list[str], out: str, start, step: Callable[[list, dict, dict], tuple[list, dict]], expiry_days: int) -> DataFrame:
    """Keyed fold in order of (ts, msg_id): rows come out when the watermark has passed them. ``step`` gets (state, key, row)
    and returns the new state and an output row."""
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)  # keyed state with timers needs it
    names = [x.split()[0] for x in out.split(", ")]
    processor = _Ordered(keys, columns, names, start, step, ["ts", "msg_id"], expiry_days * 86_400_000)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, out, "append", "EventTime")


def dedupe(stream: DataFrame, key: str = "msg_id", delay: str = "30 days") -> DataFrame:
    """First sight of an id within 30 days of event time."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def campaign_alerts(path: str) -> Callable[[DataFrame, int], DataFrame]:
    """For ``foreachBatch``: alerts of a micro-batch (msg_id, ts, domain, subject, auth_fail), written to ``path``/alerts.

    A group's count and last time are its state, kept as a table by hash bucket. A message that fails authentication
    joins the group of its subject length, and its domain's group too while the first holds fewer than three; all
    others join their domain's group. A group that is idle for 30 days begins anew, and leaves the table after 60 when its bucket is
    next written. A repeated batch id writes the same again. Returns the alerts: msg_id, group_key, n, threat_score, newly_alertable.
    """
    state = BucketedTable(f"{path}/groups", "group_key", "group_key string, n long, last long")

    def counted(rows: DataFrame, now: DataFrame) -> DataFrame:
        w = Window.partitionBy("group_key").orderBy("ts_s", "msg_id")
        rows = rows.join(now, "group_key", "left")
        gap = F.coalesce((F.col("ts_s") - F.coalesce(F.lag("ts_s").over(w), F.col("last")) > IDLE_SECONDS).cast("int"), F.lit(0))
        rows = rows.withColumn("__gap", gap).withColumn("__session", F.sum("__gap").over(w))
        held = F.when(F.col("__session") == 0, F.coalesce("n", F.lit(0))).otherwise(F.lit(0))
        return rows.withColumn("n", held + F.row_number().over(Window.partitionBy("group_key", "__session").orderBy("ts_s", "msg_id"))).drop("__gap", "__session", "last")

    def save(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        rows = batch.withColumn("ts_s", F.unix_timestamp("ts"))
        own = rows.select("msg_id", "ts_s", "domain", F.coalesce("auth_fail", F.lit(False)).alias("auth_fail"), F.concat(F.lit("pattern:auth_fail:subject_"), subject_bucket(F.col("subject"))).alias("group_key"))
        now = state.read(spark, batch_id)
        failed = counted(own.where("auth_fail"), now)
        named = F.concat(F.lit("unknown:"), F.coalesce("domain", F.lit(""))).alias("group_key")
        by_domain = counted(own.where("NOT auth_fail").select("msg_id", "ts_s", named).union(failed.where("n <= 2").select("msg_id", "ts_s", named)), now)
        every = failed.select("msg_id", "group_key", "ts_s", "n").union(by_domain.select("msg_id", "group_key", "ts_s", "n"))
        score = F.when(F.col("n") == 1, 0.3).otherwise(F.least(F.lit(1.0), 0.3 + 0.1 * F.col("n")))
        out = f"{path}/alerts/batch={batch_id:010d}"
        every.select("msg_id", "group_key", "ts_s", "n", score.alias("threat_score"), (F.col("n") == 3).alias("newly_alertable")).write.mode("overwrite").parquet(out)
        made = spark.read.parquet(out)
        newest = made.agg(F.max("ts_s")).first()[0]
        kept = F.lit(True) if newest is None else F.col("last") >= newest - 2 * IDLE_SECONDS  # a group idle for longer begins anew anyway
        groups = made.groupBy("group_key").agg(F.max_by("n", F.struct("ts_s", "msg_id")).alias("n"), F.max("ts_s").alias("last"))
        state.write(groups, batch_id, lambda old, new: old.where(kept).join(new, "group_key", "left_anti").unionByName(new))
        return made.drop("ts_s")

    return save


def signature_replays(stream: DataFrame, delay: str = "1 hour", expiry_days: int = EXPIRY_DAYS) -> DataFrame:
    """msg_id, seen: running count per (d, b32) in order of event time, once the watermark has passed a message; a message
    without either counts once, outside any state."""
    keyed = F.col("d").isNotNull() & F.col("b32").isNotNull()
    timed = stream.withWatermark("ts", delay)
    alone = timed.where(~keyed).select("msg_id", F.lit(1).cast("long").alias("seen"))
    return _running_count(timed.where(keyed), ["d", "b32"], "seen", 0, expiry_days).union(alone)


def platform_familiarity(stream: DataFrame, delay: str = "1 hour", expiry_days: int = EXPIRY_DAYS) -> DataFrame:
    """msg_id, prior: earlier links of the sender to the platform, once the watermark has passed a link; five or more are familiar."""
    return _running_count(stream.withWatermark("ts", delay), ["sender", "platform"], "prior", -1, expiry_days)


def _running_count(timed: DataFrame, keys: list[str], name: str, shift: int, expiry_days: int) -> DataFrame:
    step = lambda s, k, r: ([s[0] + 1], {"msg_id": r["msg_id"], name: s[0] + 1 + shift})
    return _fold(timed, keys, ["msg_id"], f"msg_id long, {name} long", [0], step, expiry_days)


def sender_counts(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Running profile per sender, for update mode: count, first and last seen."""
    return stream.withWatermark("ts", delay).groupBy("sender").agg(F.count("*").alias("message_count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


STYLE = ["chars", "chars_per_sentence", "punctuation_density", "formality"]


def style_profiles(stream: DataFrame, delay: str = "1 hour", expiry_days: int = EXPIRY_DAYS) -> DataFrame:
    """msg_id, n, running means before the sample, and the weight of its hour, per sender, once the watermark has passed it."""

    def step(state, key, row):
        (n, means, hours), hour = state, int(row["hour"])
        got = {"msg_id": row["msg_id"], "n": n} | {f"avg_{c}": (means[i] if n else None) for i, c in enumerate(STYLE)} | {"hour_weight": hours[hour]}
        alpha = 1.0 / (n + 1)
        means = [m + (float(row[c]) - m) * alpha for m, c in zip(means, STYLE, strict=True)]
        hours = [h * (1 - alpha) + alpha if k == hour else h * (1 - alpha * 0.1) for k, h in enumerate(hours)]
        return [n + 1, means, hours], got

    out = "msg_id long, n long, " + ", ".join(f"avg_{c} double" for c in STYLE) + ", hour_weight double"
    return _fold(stream.withWatermark("ts", delay), ["sender"], ["msg_id", "hour", *STYLE], out, [0, [0.0] * len(STYLE), [0.0] * 24], step, expiry_days)


class BucketedTable:
    """A table by hash bucket of a key. A batch writes new versions of the buckets that it touches and then a manifest,
    which says for every bucket which batch wrote it last; the manifest, once complete, makes the batch count.

    The KEEP newest manifests stay, with every version of a bucket that one of them names; a batch deletes what it leaves
    behind. So a batch lists and reads as much however many came before it. A batch can be repeated, and a reader can go
    on with a version, for KEEP batches.
    """

    KEEP = 8

    def __init__(self, path: str, key: str, schema: str | StructType, buckets: int = 64):
        self.path, self.key, self.schema, self.buckets = path, key, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _files(self, spark: SparkSession):
        """The table's file system, and a maker of its paths."""
        make = spark._jvm.org.apache.hadoop.fs.Path
        return make(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), make

    def batches(self, spark: SparkSession) -> list[int]:
        """Batches whose manifest is complete, oldest first."""
        files, make = self._files(spark)
        top = make(f"{self.path}/manifest")
        if not files.exists(top):
            return []
        named = [x.getPath() for x in files.listStatus(top) if x.getPath().getName().startswith("batch=")]
        return sorted(int(p.getName().removeprefix("batch=")) for p in named if files.exists(make(p, "_SUCCESS")))

    def _manifest(self, spark: SparkSession, batch: int) -> dict[int, int]:
        return {r["bucket"]: r["place"] for r in spark.read.schema("bucket int, place long").parquet(f"{self.path}/manifest/batch={batch}").collect()}

    def places(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """Bucket to batch, of the newest manifest (before a batch): ``buckets`` rows at most."""
        known = [b for b in self.batches(spark) if before is None or b < before]
        return self._manifest(spark, known[-1]) if known else {}

    def _expire(self, spark: SparkSession) -> None:
        known = self.batches(spark)
        files, make = self._files(spark)
        for old, following in zip(known[: -self.KEEP], known[1:], strict=False):
            held = self._manifest(spark, following)
            for bucket, place in self._manifest(spark, old).items():
                if held.get(bucket) != place:  # versions only move on, so no later manifest names it either
                    files.delete(make(f"{self.path}/data/batch={place:010d}/bucket={bucket}"), True)
            files.delete(make(f"{self.path}/manifest/batch={old}"), True)

    def _load(self, spark: SparkSession, places: dict[int, int]) -> DataFrame:
        if not places:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*(f"{self.path}/data/batch={b:010d}/bucket={k}" for k, b in sorted(places.items())))

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        return self._load(spark, self.places(spark, before))

    def write(self, changes: DataFrame, batch_id: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        spark, places = changes.sparkSession, self.places(changes.sparkSession, batch_id)
        touched = {r["b"] for r in changes.select(self.bucket().alias("b")).distinct().collect()}
        old = self._load(spark, {k: b for k, b in places.items() if k in touched})
        rows = merge(old, changes).withColumn("bucket", self.bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch_id:010d}")
        now = places | dict.fromkeys(touched, batch_id)
        spark.createDataFrame(sorted(now.items()), "bucket int, place long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch_id}")
        self._expire(spark)


def save_batches(path: str, schema: str | StructType, version: str = "v", key: str = "id") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: upsert a micro-batch into the table; only the buckets of its keys are written anew. A
    repeated batch id starts from the same predecessor and writes the same again, so a replay changes nothing.
    ``schema`` is that of the table, without ``version``."""
    table = BucketedTable(path, key, schema)

    def save(batch: DataFrame, batch_id: int) -> None:
        table.write(batch, batch_id, lambda old, new: mailbox.upsert(old, new, version))

    return save


def latest(spark: SparkSession, path: str, schema: str | StructType, key: str = "id") -> DataFrame:
    """What a table that :func:`save_batches` wrote holds now."""
    return BucketedTable(path, key, schema).read(spark)
