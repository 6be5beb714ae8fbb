"""Rows of null and repeated ids are decided one by one."""

from mailsieve.llm import decontaminate, near_copies, simhash_gph

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A, B, C, D = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
ITEM = " ".join(f"item{i}" for i in range(12))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)


def ids(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_keep_one_decides_by_row(spark):
    rows = [(1, A), (None, A), (None, B), (None, C), (7, A), (7, D), (8, "x y"), (8, "x y")]
    want = sorted([(1, A), (None, B), (None, C), (7, D), (8, "x y")], key=str)
    for keep_one in (simhash_gph.keep_one, near_copies.keep_one):
        assert ids(keep_one(frame(spark, rows))) == want


def test_clean_decides_by_row(spark):
    rows = [(None, A), (None, f"{B} {ITEM}"), (5, C), (5, f"{D} {ITEM}"), (6, D)]
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert ids(decontaminate.clean(frame(spark, rows), items)) == sorted([(None, A), (5, C), (6, D)], key=str)
