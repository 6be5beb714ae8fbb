"""Two-level scans against ordered windows, with one key that holds half of all rows."""

import math
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailsieve.operators import history as H
from mailsieve.operators.running import BLOCK_SECONDS, Scan, with_running

DAY = 86400


def rows(spark, n=1200):
    rng = random.Random(3)
    made = []
    for i in range(n):
        key = "hot" if i % 2 else rng.choice(["a", "b", None])
        made.append((i, key, rng.choice(["x", "y", None]), None if i % 97 == 0 else rng.randrange(40 * DAY), rng.choice([None, 0.5, 2.0]), rng.choice([None, "s", f"t{i}"])))
    return spark.createDataFrame(made, "id long, k string, k2 string, ts long, v double, s string").repartition(5)


def test_scans_equal_windows(spark):
    df = rows(spark)
    got = with_running(df, "ts", "id", Scan(["k"], {"n": F.lit(1), "total": F.col("v")}, {"prior": F.col("s")}), Scan(["k", "k2"], {"m": F.lit(1)}))
    w, w2 = Window.partitionBy("k").orderBy("ts", "id"), Window.partitionBy("k", "k2").orderBy("ts", "id")
    before = lambda x: x.rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumns({"n": F.count("*").over(before(w)), "total": F.coalesce(F.sum("v").over(before(w)), F.lit(0.0)), "prior": F.lag("s").over(w), "m": F.count("*").over(before(w2))})
    show = lambda d: sorted((r.id, r.n, round(r.total, 6), r.prior, r.m) for r in d.collect())
    assert show(got) == show(want)
    assert with_running(df.limit(0), "ts", "id", Scan(["k"], {"n": F.lit(1)})).count() == 0
    stamped = df.withColumn("ts", F.timestamp_seconds("ts"))
    assert show(with_running(stamped, "ts", "id", Scan(["k"], {"n": F.lit(1), "total": F.col("v")}, {"prior": F.col("s")}), Scan(["k", "k2"], {"m": F.lit(1)}))) == show(want)


def test_a_hot_key_is_spread_over_blocks(spark):
    df = rows(spark)
    sizes = sorted(r["count"] for r in df.where("ts IS NOT NULL").groupBy("k", F.floor(F.col("ts") / BLOCK_SECONDS)).count().collect())
    assert sizes[-1] <= 6 * sizes[len(sizes) // 2]
    plan = with_running(df, "ts", "id", Scan(["k"], {"n": F.lit(1)}))._jdf.queryExecution().executedPlan().toString()
    ordered = [line for line in plan.splitlines() if "Window [" in line and "ts#" in line]
    assert ordered and all("__block#" in line.split("], [")[1] for line in ordered)  # no row window by the key alone


def test_folds_equal_a_loop(spark):
    df = rows(spark, 400).where("ts IS NOT NULL").withColumns({"a": F.coalesce(-F.col("v"), F.lit(0.0)) / 10, "b": F.col("id") % 7 / 3.0})
    got = {r.id: r.u for r in with_running(df, "ts", "id", Scan(["k"], folds={"u": (F.col("a"), F.col("b"))})).collect()}
    state = {}
    for r in sorted(df.collect(), key=lambda r: (r.ts, r.id)):
        u = state.get(r.k, 0.0)
        assert math.isclose(got[r.id], u, rel_tol=1e-9, abs_tol=1e-9)
        state[r.k] = math.exp(r.a) * u + r.b


def test_style_profile_of_a_long_history(spark):
    rng = random.Random(5)
    samples = [(i, 1000 * i, "s", rng.choice([9, 9, 10, 23]), rng.random(), 1.0, 0.1, 0.5) for i in range(300)]
    df = spark.createDataFrame(samples, "msg_id long, ts_s long, sender string, hour int, chars double, chars_per_sentence double, punctuation_density double, formality double")
    got, hours = {r.msg_id: r for r in H.style_profiles(df).collect()}, [0.0] * 24
    for i, (_, _, _, hour, *_) in enumerate(samples):
        assert got[i].n == i and math.isclose(got[i].hour_weight, hours[hour], rel_tol=1e-9, abs_tol=1e-12)
        alpha = 1 / (i + 1)
        hours = [h + alpha * (1 - h) if k == hour else h * (1 - alpha / 10) for k, h in enumerate(hours)]
    assert math.isclose(got[299].avg_chars, sum(s[4] for s in samples[:299]) / 299)
