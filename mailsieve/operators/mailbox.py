"""Mailbox queries, upserts and validation over message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The most characters of each field.
LIMITS = {"account_id": 256, "mailbox_id": 256, "jmap_id": 256, "message_id": 998, "thread_id": 256, "from_addr": 320, "from_name": 256, "subject": 2000, "body_preview": 10000}
KEPT_WHEN_NULL = ["message_id", "thread_id", "received_at"]


def page(m: DataFrame, limit: int, offset: int = 0, order: str = "received_at", tie: str = "id") -> DataFrame:
    """Live rows, newest first, ties by id; the limit lies between 1 and 500."""
    return m.where(~F.coalesce(F.col("is_deleted"), F.lit(False))).orderBy(F.desc(order), tie).offset(offset).limit(max(1, min(500, limit)))


def search(m: DataFrame, query: str, columns: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows whose columns hold the query, as ASCII letters in any case; nothing in it is a wildcard."""
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.translate(F.col(c), up, low), F.lit(query.translate(str.maketrans(up, low)))), F.lit(False))
    return page(m.where(hit), limit, offset)


def thread(m: DataFrame, thread_id, limit: int = 100) -> DataFrame:
    return m.where(~F.coalesce(F.col("is_deleted"), F.lit(False)) & (F.col("thread_id") == thread_id)).orderBy("received_at", "id").limit(limit)


def by_ids(m: DataFrame, ids: DataFrame, key: str = "message_id") -> DataFrame:
    return m.join(ids.select(key), key, "left_semi")


def stats(m: DataFrame, keys: list[str]) -> DataFrame:
    live = m.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))
    return live.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(~F.col("is_read")).alias("unread"), F.count_if(F.col("verdict").isin("suspicious", "dangerous")).alias("alerts"))


def top_contacts(contacts: DataFrame, limit: int = 5000) -> DataFrame:
    shown = F.when(F.coalesce(F.col("display_name"), F.lit("")) == "", F.col("email")).otherwise(F.concat(F.replace("display_name", F.lit('"'), F.lit("")), F.lit(" <"), "email", F.lit(">")))
    return contacts.orderBy(F.desc("message_count"), "email").limit(limit).select(shown.alias("contact"), "message_count")


def mark(m: DataFrame, ids: DataFrame, column: str, key: str = "id") -> DataFrame:
    """Set a flag on the rows of an id table; all other rows keep theirs."""
    hit = ids.select(F.col(key).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    return m.join(hit, F.col(key) == F.col("__k"), "left").withColumn(column, F.coalesce("__hit", F.col(column))).drop("__k", "__hit")


def reconcile(m: DataFrame, live: DataFrame, key: str = "id") -> DataFrame:
    """Rows that are not in the live id table become deleted; an empty table deletes all."""
    ids = live.select(F.col(key).alias("__k")).distinct()
    return m.join(ids, F.col(key) == F.col("__k"), "left").withColumn("is_deleted", F.col("is_deleted") | F.col("__k").isNull()).drop("__k")


def message_key(account: Column, source_id: Column) -> Column:
    return F.sha2(F.concat(account.cast("binary"), F.lit(b"\x00"), source_id.cast("binary")), 256)


def upsert(current: DataFrame, changes: DataFrame, version: str) -> DataFrame:
    """The table after ``changes`` (same columns and a version): the latest version of a key wins whole, except that
    some columns keep their last value that is not null; a saved row is live again. One shuffle on the key,
    aggregated on the map side, so a key that changes very often stays one row a task."""
    rows = current.withColumn(version, F.lit(None).cast(dict(changes.dtypes)[version])).unionByName(changes)
    at = F.struct(F.col(version).isNotNull().alias("new"), F.col(version).alias("v"))
    keep = [c for c in KEPT_WHEN_NULL if c in current.columns]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) if c in keep else F.max_by(c, at).alias(c) for c in current.columns if c not in ("id", "is_deleted")]
    out = rows.groupBy("id").agg(*last, F.max_by("is_deleted", at).alias("__d"), F.max(F.col(version).isNotNull()).alias("__new"))
    return out.withColumn("is_deleted", ~F.col("__new") & F.col("__d")).select(*current.columns)


def upsert_scans(scans: DataFrame, messages: DataFrame, version: str) -> DataFrame:
    """The latest scan of every (msg_id, filename) whose message exists."""
    keys = ["msg_id", "filename"]
    latest = scans.groupBy(*keys).agg(*[F.max_by(c, version).alias(c) for c in scans.columns if c not in keys])
    return latest.join(messages.select(F.col("id").alias("msg_id")), "msg_id", "left_semi")


def validate(m: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Adds reject_reason, null for valid rows: the first field with a NUL or too many characters, or over 1,000 recipients."""
    tests = []
    for c, most in (limits or LIMITS).items():
        if c in m.columns:
            tests += [F.when(F.contains(F.col(c), F.lit("\x00")), f"{c}: nul"), F.when(F.length(c) > most, f"{c}: too long")]
    if "to_addrs" in m.columns:
        tests += [F.when(F.size("to_addrs") > 1000, "to_addrs: too many"), F.when(F.exists("to_addrs", lambda a: (F.length(a) > 320) | F.contains(a, F.lit("\x00"))), "to_addrs: invalid")]
    return m.withColumn("reject_reason", F.coalesce(*tests))
