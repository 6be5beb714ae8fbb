"""Feed payloads of several shapes as one table of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = "source string, title string, url string, published timestamp, summary string"
_RSS = "channel struct<item:array<struct<title:string,link:string,pubDate:string,description:string>>>"
_ATOM = "entry array<struct<title:string,id:string,published:string,summary:string>>"
_LIST = "array<struct<title:string,url:string,created_at:string>>"
_REPOS = "items array<struct<full_name:string,name:string,html_url:string,pushed_at:string,description:string>>"
_HITS = "hits array<struct<objectID:string,title:string,url:string,created_at:string>>"
_DRAFTS = "objects array<struct<name:string,title:string,time:string,abstract:string>>"


def _clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def _iso(c: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "+00:00"))


def _rfc(c: Column) -> Column:
    zoned = F.regexp_replace(F.regexp_replace(F.trim(c), r"\b(?:GMT|UTC|UT)$", "+0000"), r"^\w{3},\s*", "")
    return F.try_to_timestamp(zoned, F.lit("d MMM yyyy HH:mm:ss Z"))


def _shape(raw: DataFrame, kind: str, items: Column, title, url, date, summary) -> DataFrame:
    rows = raw.where(F.col("shape") == kind).select("source", "query", F.explode(items).alias("i"))
    i = lambda name: F.col(f"i.{name}")
    return rows.select("source", "query", _clean(title(i)).alias("title"), F.trim(F.coalesce(url(i), F.lit(""))).alias("url"), date(i).alias("published"), _clean(summary(i)).alias("summary"))


def parse_feeds(raw: DataFrame, limit: int = 20) -> DataFrame:
    """Items from (source, query, shape, payload); shape is atom, rss, list, repos, drafts or hits.

    Rows without title, address or readable date drop out, as do XML payloads with a document type or entity
    declaration. Each query keeps its ``limit`` newest items, ties by address.
    """
    raw = raw.where(~F.rlike("payload", F.lit(r"(?i)<!\s*(?:DOCTYPE|ENTITY)\b")))
    none = lambda i: F.lit("")
    parts = [
        _shape(raw, "atom", F.from_xml("payload", _ATOM)["entry"], lambda i: i("title"), lambda i: i("id"), lambda i: _iso(i("published")), lambda i: i("summary")),
        _shape(raw, "rss", F.from_xml("payload", _RSS)["channel"]["item"], lambda i: i("title"), lambda i: i("link"), lambda i: _rfc(i("pubDate")), lambda i: i("description")),
        _shape(raw, "list", F.from_json("payload", _LIST), lambda i: i("title"), lambda i: i("url"), lambda i: _iso(i("created_at")), none),
        _shape(raw, "repos", F.from_json("payload", _REPOS)["items"], lambda i: F.coalesce(i("full_name"), i("name")), lambda i: i("html_url"), lambda i: _iso(i("pushed_at")), lambda i: i("description")),
        _shape(raw, "drafts", F.from_json("payload", _DRAFTS)["objects"], lambda i: F.coalesce(i("title"), i("name")), lambda i: F.concat(F.lit("https://datatracker.ietf.org/doc/"), i("name"), F.lit("/")), lambda i: _iso(i("time")), lambda i: i("abstract")),
        _shape(raw, "hits", F.from_json("payload", _HITS)["hits"], lambda i: i("title"), lambda i: F.coalesce(F.nullif(i("url"), F.lit("")), F.concat(F.lit("https://news.ycombinator.com/item?id="), i("objectID"))), lambda i: _iso(i("created_at")), none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where("title <> '' AND url <> '' AND published IS NOT NULL")
    newest = Window.partitionBy("source", "query").orderBy(F.desc("published"), "url")
    return out.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= limit).drop("k")
