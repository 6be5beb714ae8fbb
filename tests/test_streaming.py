"""Streams give what their batch forms give over the same rows."""

import pytest
from pyspark.sql import functions as F

from mailsieve.operators import history as H
from mailsieve.operators import mailbox as B
from mailsieve.streaming import live

ROWS = [(i, i % 3, f"2024-01-01 {i % 24:02d}:{i % 60:02d}:00" if i < 24 else f"2024-01-0{2 + i % 5} {i % 24:02d}:00:00", "x" * (i % 4 * 9), i % 2 == 0) for i in range(60)]


@pytest.fixture()
def table(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "msg_id long, k long, t string, subject string, auth_fail boolean").withColumn("ts", F.to_timestamp("t")).drop("t").orderBy("ts", "msg_id")
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    return df, path


def run(spark, tmp_path, stream):
    name = f"m{abs(hash(str(tmp_path)))}"
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def source(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


LAST = 10_000  # the id of a row long after all others, which moves the watermark on


@pytest.fixture()
def shuffled(spark, tmp_path):
    """Rows in six files, one a micro-batch, out of order within 12 hours; and a row that ends all waiting."""
    df = spark.createDataFrame([(i, i % 3, f"2024-01-{1 + i // 6:02d} {i % 6 * 4:02d}:30:00.{i:03d}", "x" * (i % 4 * 9)) for i in range(60)], "msg_id long, k long, t string, subject string").withColumn("ts", F.to_timestamp("t")).drop("t")
    end = spark.createDataFrame([(LAST, 0, "2024-03-01 00:00:00", "")], "msg_id long, k long, t string, subject string").withColumn("ts", F.to_timestamp("t")).drop("t")
    path = str(tmp_path / "shuffled")
    for part in range(6):
        # neighbours on both sides of a border change files
        shift = F.when(F.col("msg_id") % 10 == 9, 1).when(F.col("msg_id") % 10 == 0, -1).otherwise(0)
        own = df.where(F.least(F.lit(5), F.greatest(F.lit(0), F.floor((F.col("msg_id") + shift) / 10))) == part)
        own.orderBy(F.desc("msg_id")).coalesce(1).write.mode("append").parquet(path)
    end.coalesce(1).write.mode("append").parquet(path)
    return df, path


def test_dedupe(spark, table, tmp_path):
    df, path = table
    df.where("msg_id < 10").coalesce(1).write.mode("append").parquet(path)
    out = run(spark, tmp_path, live.dedupe(source(spark, df, path)))
    assert out.count() == 60


def test_replays_equal_batch(spark, shuffled, tmp_path):
    df, path = shuffled
    named = lambda d: d.withColumns({"d": F.when(F.col("k") > 0, F.col("k").cast("string")), "b32": F.when(F.col("msg_id") % 5 > 0, "b")})
    out = {r.msg_id: r.seen for r in run(spark, tmp_path, live.signature_replays(named(source(spark, df, path)), "12 hours")).collect()}
    assert {i: n for i, n in out.items() if i != LAST} == {r.msg_id: r.seen for r in H.signature_replays(named(df)).collect()}


def test_familiarity_equals_batch(spark, shuffled, tmp_path):
    df, path = shuffled
    named = lambda d: d.withColumns({"sender": F.when(F.col("k") > 0, F.col("k")), "platform": F.lit("p")})
    got = run(spark, tmp_path, live.platform_familiarity(named(source(spark, df, path)), "12 hours")).collect()
    out = {r.msg_id: r.prior for r in got}
    assert len(got) == len(out) == 60  # each once; the last row still waits
    assert out == {r.msg_id: r.prior for r in H.platform_familiarity(named(df)).collect()}


def test_an_idle_key_is_forgotten_at_its_expiry(spark, tmp_path):
    kind = "msg_id long, sender string, platform string, t string"
    days = [(1, "s", "2024-01-01"), (2, "s", "2024-01-02"), (3, "s", "2024-06-01"), (4, None, "2024-06-02"), (5, None, "2024-06-03"), (6, "t", "2025-12-01"), (7, "s", "2025-12-02"), (8, "t", "2026-01-01")]
    path = str(tmp_path / "in")
    for i, sender, day in days:
        spark.createDataFrame([(i, sender, "p", day)], kind).withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    out = run(spark, tmp_path, live.platform_familiarity(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)))
    assert {r.msg_id: r.prior for r in out.collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 1, 6: 0, 7: 0}


def test_sender_counts_equal_batch(spark, table, tmp_path):
    df, path = table
    named = lambda d: d.withColumn("sender", F.col("k"))
    q = live.sender_counts(named(source(spark, df, path))).writeStream.format("memory").outputMode("update").queryName("senders").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.table("senders").collect():
        got[r.sender] = max(got.get(r.sender, 0), r.message_count)
    assert got == {k: 20 for k in range(3)}


def test_campaign_alerts_equal_batch(spark, table, tmp_path):
    df, _ = table
    df = df.withColumn("domain", F.concat(F.lit("d"), F.col("k").cast("string"), F.lit(".example")))
    gap = df.where("msg_id % 7 = 0").withColumns({"msg_id": F.col("msg_id") + 100, "ts": F.col("ts") + F.expr("INTERVAL 45 DAYS")})
    every = df.unionByName(gap)
    save, at = live.campaign_alerts(str(tmp_path / "c")), [r[0] for r in every.select("ts").orderBy("ts").collect()]
    cuts = [at[0], at[20], at[45], at[60], at[-1] + (at[-1] - at[0])]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        save(every.where((F.col("ts") >= a) & (F.col("ts") < b)), k)
    save(every.where((F.col("ts") >= cuts[3]) & (F.col("ts") < cuts[4])), 3)  # the same batch again
    out = spark.read.parquet(str(tmp_path / "c" / "alerts")).collect()
    groups = H.campaigns(every.withColumn("ts_s", F.unix_timestamp("ts"))).collect()
    assert {k: max(x.n for x in out if x.group_key == k) for k in {x.group_key for x in out}} == {k: max(g.n for g in groups if g.group_key == k) for k in {g.group_key for g in groups}}
    assert sum(r.newly_alertable for r in out) == sum(r.alertable for r in groups) and any(r.group_key.startswith("unknown:") and r.newly_alertable for r in out)
    assert len(out) == sum(g.n for g in groups)


def test_style_profiles_equal_batch(spark, shuffled, tmp_path):
    df, path = shuffled
    named = lambda d: d.withColumns({"sender": F.col("k").cast("string"), "hour": F.hour("ts"), "chars": F.length("subject").cast("double"), "chars_per_sentence": F.col("msg_id") * 1.0, "punctuation_density": F.lit(1.0), "formality": F.lit(0.5)})
    out = {r.msg_id: (r.n, r.avg_chars, r.hour_weight) for r in run(spark, tmp_path, live.style_profiles(named(source(spark, df, path)), "12 hours")).collect()}
    batch = H.style_profiles(named(df).withColumn("ts_s", F.unix_timestamp("ts"))).collect()
    assert len(out) == len(batch) == 60
    for r in batch:
        n, chars, weight = out[r.msg_id]
        assert n == r.n and weight == pytest.approx(r.hour_weight) and (r.n == 0 or chars == pytest.approx(r.avg_chars))


def test_save_batches_replay(spark, tmp_path):
    schema = "id long, message_id string, subject string, is_deleted boolean, v int"
    first = spark.createDataFrame([(1, "a", "s1", False, 1), (2, None, "s2", False, 1)], schema)
    second = spark.createDataFrame([(1, None, "s1b", False, 2)], schema)
    table = "id long, message_id string, subject string, is_deleted boolean"
    save = live.save_batches(str(tmp_path / "t"), table)
    save(first, 0)
    save(second, 1)
    save(second, 1)  # the same batch again
    got = {r.id: (r.message_id, r.subject) for r in live.latest(spark, str(tmp_path / "t"), table).collect()}
    assert got == {1: ("a", "s1b"), 2: (None, "s2")}
    gone = B.reconcile(live.latest(spark, str(tmp_path / "t"), table), spark.createDataFrame([(2,)], "id long"))
    assert {r.id: r.is_deleted for r in gone.collect()} == {1: True, 2: False}


def test_a_table_of_many_batches_stays_small(spark, tmp_path):
    path, kind = tmp_path / "t", "id long, message_id string, subject string, is_deleted boolean"
    save, keep = live.save_batches(str(path), kind), live.BucketedTable.KEEP
    for b in range(keep + 6):
        batch = spark.createDataFrame([(b % 5, f"m{b % 5}", f"s{b}", False, b), (100 + b, "x", "y", False, b)], kind + ", v int")
        save(batch, b)
        if b % 4 == 0:
            save(batch, b)  # repeated
    (path / "manifest" / "batch=99").mkdir()  # one that was never finished
    table = live.BucketedTable(str(path), "id", kind)
    assert table.batches(spark) == list(range(6, keep + 6))
    got = {r.id: r.subject for r in live.latest(spark, str(path), kind).collect()}
    assert got == {100 + b: "y" for b in range(keep + 6)} | {b % 5: f"s{b}" for b in range(keep + 6)}
    named = {(k, b) for m in table.batches(spark) for k, b in table._manifest(spark, m).items()}
    kept = {(int(p.name.removeprefix("bucket=")), int(p.parent.name.removeprefix("batch="))) for p in path.glob("data/*/bucket=*")}
    assert kept == named
