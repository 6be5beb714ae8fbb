"""Feed items: window, topics, emerging terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.matching import terms_in
from .containing import containment

#: Pattern of a term.
TERM = r"([a-z][a-z0-9-]{3,}|[ァ-ヶー]{3,})"


def recent(items: DataFrame, now_s: int, days: int) -> DataFrame:
    """Items of the last days, one a URL (the newest; ties by source, then title)."""
    inside = items.where(F.col("published_s") >= now_s - days * 86400)
    newest = inside.groupBy("url").agg(F.max_by(F.struct(*[c for c in items.columns if c != "url"]), F.struct("published_s", "source", "title")).alias("r"))
    return newest.select("r.*", "url").select(*items.columns)


def topic_matches(items: DataFrame, keywords: DataFrame) -> DataFrame:
    """url and topic, once each. ``keywords`` (topic, keyword) is a table of any size.

    Short ASCII keywords must stand as whole words and are joined on the words of their length; all others may stand anywhere
    and are sought by automata, a block of them in one pass over the texts. An empty keyword matches nothing.
    """
    k = keywords.select("topic", F.lower("keyword").alias("term")).where("term <> ''").distinct()
    short = F.rlike("term", F.lit("^[a-z0-9]{1,4}$"))
    rows = items.select("url", F.lower(F.concat_ws(" ", "title", "summary")).alias("text"))
    words = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) <= 4))
    by_word = rows.select("url", F.explode(words).alias("term")).join(k.where(short), "term")
    by_text = terms_in(rows, "url", "text", k.where(~short)).join(k.where(~short), "term")
    return by_word.select("url", "topic").union(by_text.select("url", "topic")).distinct()


def topic_ranking(topics: DataFrame, matches: DataFrame) -> DataFrame:
    """topic, matches, rank, gap: all topics by matches; a gap has matches but no coverage."""
    n = matches.groupBy("topic").agg(F.count("*").alias("matches"))
    out = topics.join(n, "topic", "left").withColumn("matches", F.coalesce("matches", F.lit(0).cast("long")))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("matches"), "topic"))).withColumn("gap", ~F.col("has_coverage"))


def emerging_terms(items: DataFrame, known: DataFrame, stop_words: list[str], least: int = 3, limit: int = 15) -> DataFrame:
    """term, df: terms in ``least`` items or more that no known keyword (a table of any size) holds."""
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    df = items.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), 1))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    df = df.where(~F.col("term").isin(stop_words))
    held = containment(df.select(F.col("term").alias("x")), known.select(F.lower("keyword").alias("x"))).select(F.col("short").alias("term")).distinct()
    fresh = df.join(held, "term", "left_anti")
    return fresh.orderBy(F.desc("df"), "term").limit(limit)


def latest_per_topic(items: DataFrame, matches: DataFrame, n: int = 3) -> DataFrame:
    w = Window.partitionBy("topic").orderBy(F.desc("published_s"), "source", "url")
    return items.join(matches, "url").withColumn("k", F.row_number().over(w)).where(F.col("k") <= n)


def per_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    n = items.groupBy("source").agg(F.count("*").alias("n"))
    return sources.join(n, "source", "left").select("source", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
