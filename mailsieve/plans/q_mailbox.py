"""Mailbox queries over the message view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mailbox as B
from . import oracle as O
from .catalog import query
from .views import messages, read

BOX = f"{O.M}, b AS (SELECT msg_id AS id, 'm' || msg_id AS message_id, thread_id, ts_s AS received_at, subject, from_addr, split_part(from_addr, '@', 1) AS from_name, CASE WHEN msg_id % 2 = 0 THEN 'inbox' ELSE 'archive' END AS mailbox_id, msg_id % 3 = 0 AS is_read, msg_id % 7 = 0 AS is_deleted, CASE WHEN msg_id % 5 = 0 THEN 'suspicious' ELSE 'safe' END AS verdict FROM m)"


def _box(spark, sf_dir):
    k = F.col("msg_id")
    return messages(spark, sf_dir).select(
        k.alias("id"), F.concat(F.lit("m"), k.cast("string")).alias("message_id"), "thread_id", F.col("ts_s").alias("received_at"), "subject", "from_addr", F.substring_index("from_addr", "@", 1).alias("from_name"),
        F.when(k % 2 == 0, "inbox").otherwise("archive").alias("mailbox_id"), (k % 3 == 0).alias("is_read"), (k % 7 == 0).alias("is_deleted"), F.when(k % 5 == 0, "suspicious").otherwise("safe").alias("verdict"),
    )


@query("SELECT doc_id, lang, n_chars FROM documents")
def a1_table_scan(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")


@query(f"WITH {BOX} SELECT id, received_at FROM b WHERE NOT is_deleted AND mailbox_id = 'inbox' ORDER BY received_at DESC, id LIMIT 500 OFFSET 20")
def a7_i1_mailbox_page(spark, sf_dir):
    return B.page(_box(spark, sf_dir).where("mailbox_id = 'inbox'"), 900, 20).select("id", "received_at")


@query(f"WITH {BOX} SELECT id FROM b WHERE NOT is_deleted AND (contains(lower(subject), 'the') OR contains(lower(from_addr), 'the') OR contains(lower(from_name), 'the')) ORDER BY received_at DESC, id LIMIT 300")
def i2_search(spark, sf_dir):
    return B.search(_box(spark, sf_dir), "ThE", ["subject", "from_addr", "from_name"], 300).select("id")


@query(f"WITH {BOX} SELECT id FROM b WHERE NOT is_deleted AND thread_id = 7 ORDER BY received_at, id LIMIT 100")
def i3_thread(spark, sf_dir):
    return B.thread(_box(spark, sf_dir), 7).select("id")


@query(f"WITH {BOX} SELECT id FROM b WHERE id IN (SELECT item_id FROM benchmark)")
def i4_by_ids(spark, sf_dir):
    ids = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("m"), F.col("item_id").cast("string")).alias("message_id"))
    return B.by_ids(_box(spark, sf_dir), ids).select("id")


@query(f"WITH {BOX} SELECT mailbox_id, count(*) AS total, sum((NOT is_read)::INT)::BIGINT AS unread, sum((verdict = 'suspicious')::INT)::BIGINT AS alerts FROM b WHERE NOT is_deleted GROUP BY mailbox_id")
def i5_stats(spark, sf_dir):
    return B.stats(_box(spark, sf_dir), ["mailbox_id"])


@query(f"WITH {BOX} SELECT from_name || ' <' || from_addr || '>' AS contact, count(*) AS message_count FROM b GROUP BY from_name, from_addr ORDER BY message_count DESC, from_addr LIMIT 5000")
def i6_contacts(spark, sf_dir):
    c = _box(spark, sf_dir).groupBy(F.col("from_addr").alias("email"), F.concat(F.lit('"'), "from_name", F.lit('"')).alias("display_name")).agg(F.count("*").alias("message_count"))
    return B.top_contacts(c)


@query(f"WITH {BOX} SELECT id, is_read OR id IN (SELECT item_id FROM benchmark) AS is_read FROM b")
def i7_mark_read(spark, sf_dir):
    return B.mark(_box(spark, sf_dir), read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), "is_read").select("id", "is_read")


@query(f"WITH {BOX} SELECT id, is_deleted OR id NOT IN (SELECT doc_id FROM labels) AS is_deleted FROM b")
def i8_reconcile(spark, sf_dir):
    return B.reconcile(_box(spark, sf_dir), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))).select("id", "is_deleted")


@query("SELECT event_id AS seq, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def i9_audit_listing(spark, sf_dir):
    return read(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select(F.col("event_id").alias("seq"), "event_type")


@query(
    f"""WITH {BOX}, c AS (SELECT id, CASE WHEN id % 4 = 0 THEN NULL ELSE 'n' || id END AS message_id, subject || '!' AS subject, 2 AS v FROM b WHERE id % 3 = 0 UNION ALL SELECT id, 'old' || id, subject || '?', 1 FROM b WHERE id % 3 = 0 UNION ALL SELECT 1000000000 + id, 'x' || id, subject, 1 FROM b WHERE id % 10 = 0),
    l AS (SELECT id, arg_max(subject, v) AS subject, arg_max(message_id, v) FILTER (WHERE message_id IS NOT NULL) AS message_id FROM c GROUP BY id)
    SELECT coalesce(b.id, l.id) AS id, coalesce(l.message_id, b.message_id) AS message_id, md5(coalesce(l.subject, b.subject)) AS subject, CASE WHEN l.id IS NOT NULL THEN false ELSE b.is_deleted END AS is_deleted FROM b FULL JOIN l ON b.id = l.id"""
)
def a5_upsert(spark, sf_dir):
    b = _box(spark, sf_dir).select("id", "message_id", "subject", "is_deleted")
    k = F.col("id")
    third = b.where(k % 3 == 0)
    new = third.select("id", F.when(k % 4 != 0, F.concat(F.lit("n"), k.cast("string"))).alias("message_id"), F.concat("subject", F.lit("!")).alias("subject"), "is_deleted", F.lit(2).alias("v"))
    old = third.select("id", F.concat(F.lit("old"), k.cast("string")).alias("message_id"), F.concat("subject", F.lit("?")).alias("subject"), "is_deleted", F.lit(1).alias("v"))
    added = b.where(k % 10 == 0).select((k + 1000000000).alias("id"), F.concat(F.lit("x"), k.cast("string")).alias("message_id"), "subject", "is_deleted", F.lit(1).alias("v"))
    return B.upsert(b, new.union(old).union(added), "v").withColumn("subject", F.md5("subject"))


@query("SELECT page_id % 2000 AS msg_id, 'f' AS filename, max(page_id) AS verdict FROM pages WHERE page_id % 2000 IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def a6_scan_upsert(spark, sf_dir):
    scans = read(spark, sf_dir, "pages").select((F.col("page_id") % 2000).alias("msg_id"), F.lit("f").alias("filename"), F.col("page_id").alias("verdict"), F.col("page_id").alias("v"))
    m = read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"))
    return B.upsert_scans(scans, m, "v").select("msg_id", "filename", "verdict")


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN 'subject: too long' WHEN doc_id % 5 = 0 THEN 'body_preview: nul' WHEN length(text) > 10000 THEN 'body_preview: too long' END AS reject_reason FROM documents")
def a8_validation(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("subject"), F.concat("text", F.when(F.col("doc_id") % 5 == 0, "\x00").otherwise("")).alias("body_preview"))
    return B.validate(d).select("doc_id", "reject_reason")


@query(f"WITH {O.M} SELECT msg_id, sha256('acc' || chr(0) || msg_id) AS key FROM m")
def a5_message_keys(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", B.message_key(F.lit("acc"), F.col("msg_id").cast("string")).alias("key"))
