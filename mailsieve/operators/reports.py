"""Validation of analysis reports against their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .content import audit

# Markers of an attack on the analyst.
ATTACK_MARKERS = [
    "ignore previous", "ignore all previous", "system prompt", "you are now", "dan mode", "jailbreak", "send all emails", "send to attacker", "execute code", "[INSTRUCTIONS", "<|im_start|>", "<|im_end|>",
    "assistant:", "human:", "translate the above", "repeat your instructions", "from now on", "act as if", "<!--", "[/inst]", "<|system|>", "<|end|>",
]


def validate_reports(reports: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds reason, null for promoted reports: the first rule that fails, in a fixed order.

    ``reports`` (report_id, email_id, score, topics, summary, source_id), ``sources`` (source_id, email_id). A
    report without its source fails with no_source; nulls in summary or topics count as empty.
    """
    known = sources.select("source_id", F.col("email_id").alias("__expected"))
    rows = reports.join(known, "source_id", "left").withColumn("summary", F.coalesce("summary", F.lit(""))).withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    rows = audit(rows, "summary").withColumnRenamed("safe", "__safe")
    low = F.lower("summary")
    topic_marker = F.exists("topics", lambda t: T.any_of(F.lower(t), ATTACK_MARKERS))
    reason = F.coalesce(
        F.when(F.col("__expected").isNull(), "no_source"),
        F.when(F.exists("topics", lambda t: (F.octet_length(t) > 32) | ~F.rlike(t, F.lit("^[A-Za-z0-9_-]+$"))), "topic"),
        F.when(F.rlike("summary", F.lit(r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}\x{00AD}]")), "summary_characters"),
        F.when((F.octet_length("email_id") > 1024) | F.rlike("email_id", F.lit(r"[\x00-\x1F\x7F]")), "email_id"),
        F.when(~F.col("email_id").eqNullSafe(F.col("__expected")), "email_id_mismatch"),
        F.when(F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1), "score"),
        F.when(F.size("topics") > 5, "too_many_topics"),
        F.when(T.any_of(low, ATTACK_MARKERS) | topic_marker, "attack_marker"),
        F.when(~F.col("__safe"), "audit"),
        F.when(F.length("summary") > 280, "summary_length"),
    )
    return rows.withColumn("reason", reason).select(*reports.columns, "reason")
