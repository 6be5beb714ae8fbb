"""The registered queries themselves: columns, types, folds, conversation -7, and the pipeline as a whole."""

import hashlib
import zlib

import duckdb
import pytest

import corpus_pipeline
from mailsieve.llm import queries
from mailsieve.llm.common import saved

DIR = "/root/testdata/sf0.001"
TYPES = {
    "op1_quality_classifier": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op3_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op4_hmm_language_model": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op7_chat_formatting": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op8_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op9_simhash_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}
FOLDS = {"op1_quality_classifier": (3, 1), "op4_hmm_language_model": (7, 2)}


@pytest.mark.parametrize("name", sorted(TYPES))
def test_contract(spark, name):
    out = queries.QUERIES[name](spark, DIR)
    assert {k: v for k, v in out.dtypes if k in TYPES[name]} == TYPES[name]
    rows = out.collect()
    if name == "op7_chat_formatting":
        turns = spark.read.parquet(f"{DIR}/conversations.parquet")
        assert {r.conv_id for r in rows} == {r.conv_id for r in turns.select("conv_id").distinct().collect()} | {-7}
        text = "</s>[INST] ok [/INST]"
        r = next(r for r in rows if r.conv_id == -7)
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
        return
    ids = [r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect()]
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    if name in FOLDS:
        n, held = FOLDS[name]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == held) for r in rows)
    if name == "op1_quality_classifier":
        label = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
        held = [r for r in rows if r.held_out and label.get(r.doc_id) is not None]
        assert all(r.predicted == (r.score >= 0.5) for r in rows)
        assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.9 * len(held)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    out, want = queries.QUERIES[name](spark, DIR), con.execute(queries.ORACLES[name])
    assert out.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_pipeline_run_keeps_odd_rows_and_columns(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    text = lambda a, n=60: " ".join(words[(a * 37 + 7 * i * i) % 400] for i in range(n))
    row = lambda i, a, *rest: (i, text(a), "en", "s", len(text(a)), *rest)
    rows = [row(i, i, 99.0, 7, "x", 5, 3) for i in range(1, 20)] + [row(None, 50, 1.0, 8, "y", 6, 4), (None,) * 10, row(3, 60, 2.0, 9, "z", 7, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, did int, spans string, th int, predicted int").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, text(2, 12)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = saved(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns, name
    kept = {tuple(r) for r in now.collect()}
    assert kept == {r for r in rows if r[0] != 2}  # nothing is a near copy or shares a passage; the second holds the item
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) - 1 and all(r.round_trip for r in out)


def test_reserved_names_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", 2)], "doc_id long, text string, __row int")
    with pytest.raises(ValueError, match="__row"):
        corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
