"""Queries against their SQL on tables that the given ones hold no case of: empty and absent texts, gaps between keys."""

import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mailsieve.operators.history import _log_shrunk, thread_hijack
from mailsieve.plans import catalog

WORDS = "alpha, beta gamma. delta epsilon! please wire, thanks".split()


def text(i):
    if i % 7 == 3:
        return ""
    return "äöü, ß! é." * (i % 4) if i % 5 == 0 else " ".join(WORDS[(i * k) % len(WORDS)] for k in range(2, 5 + i % 9))


def documents(ids, absent=()):
    return pd.DataFrame({"doc_id": ids, "text": [None if i in absent else text(i) for i in ids], "lang": "en", "source": ["src1" if i % 3 else "src2" for i in ids], "n_chars": 0})


CASES = {
    "empty": documents(range(300)),
    "absent": documents(range(300), absent=range(0, 300, 11)),
    "gaps": documents([i + i // 25 * 1_000_003 for i in range(300)]),
}


def different(spark, tmp_path, docs, name):
    """Rows of the query that are not its SQL's, and the other way round."""
    docs.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs)
    df = catalog.QUERIES[name](spark, str(tmp_path))
    columns = ", ".join(sorted(df.columns))
    mine = con.from_df(pd.DataFrame(df.collect(), columns=df.columns))
    theirs = con.sql(catalog.ORACLES[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    rows = lambda x: sorted(repr(tuple("null" if v is None or v != v else round(v, 6) if isinstance(v, float) else v for v in r)) for r in x.select(columns).fetchall())
    a, b = rows(mine), rows(theirs)
    assert len(a) > 0
    return [x for x, y in zip(a, b, strict=False) if x != y] + a[len(b) :] + b[len(a) :]


@pytest.mark.parametrize("case", CASES)
def test_style_warnings(spark, tmp_path, case):
    assert different(spark, tmp_path, CASES[case], "g13_g14_style_warnings") == []


def test_shrinking_of_long_histories(spark):
    n = [31, 32, 33, 34, 50, 1000, 30_000, 200_000]
    exact = [math.fsum(math.log1p(-0.1 / (i + 1)) for i in range(k)) for k in n]
    got = [r.v for r in spark.createDataFrame([(i, k) for i, k in enumerate(n)], "i int, n long").select("i", _log_shrunk(F.col("n")).alias("v")).orderBy("i").collect()]
    assert all(math.isclose(a, b, rel_tol=0, abs_tol=2e-15) for a, b in zip(got, exact, strict=True))


@pytest.mark.parametrize("case", CASES)
def test_thread_hijack(spark, tmp_path, case):
    assert different(spark, tmp_path, CASES[case], "g4_thread_hijack") == []


def test_parents_of_the_archive_are_known(spark):
    m = spark.createDataFrame([(1, 1, 1, "m1", None, "s", "b", "d"), (1, 2, 2, "m2", "m0", "s", "b", "d")], "thread_id int, ts int, msg_id int, message_id string, in_reply_to string, subject string, body string, domain string")
    unknown = lambda *a: [r.unknown_parent for r in thread_hijack(m, *a).orderBy("msg_id").collect()]
    assert unknown() == [False, True] and unknown(spark.createDataFrame([("M0",)], "message_id string")) == [False, False]


@pytest.mark.parametrize("case", CASES)
def test_history_signals(spark, tmp_path, case):
    assert different(spark, tmp_path, CASES[case], "h3_history_signals") == []
