"""Feed queries; documents stand for feed items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import feeds as J
from . import oracle as O
from .catalog import query
from .views import read

# Words that are never terms.
STOP_WORDS = (
    "about after also allows analysis based been before being between both can could data defines document domain each email emails example from have header here http https into mail message messages more most other over "
    "only protocol public report results security show some such support than that their them then there these they this those through under using very was were what when where which while will with www your "
    "github identified system systems メール セキュリティ"
).split()
NOW, DAYS = 1709000000, 50
KEYWORDS = [("spoof", "the"), ("spoof", "erst"), ("trace", "onn"), ("trace", "an"), ("chain", "eux"), ("chain", "qué"), ("none", "zzzz")]
TOPICS = [("spoof", True), ("trace", False), ("chain", True), ("none", False)]
ITEMS = "i AS (SELECT source, substr(text, 1, 60) AS title, 'https://x.example/' || (doc_id // 2) AS url, 1704067200 + doc_id * 5400 AS published_s, substr(text, 61) AS summary FROM documents)"
RECENT = f"{ITEMS}, r AS (SELECT * FROM i WHERE published_s >= {NOW - DAYS * 86400} QUALIFY row_number() OVER (PARTITION BY url ORDER BY published_s DESC, source DESC, title DESC) = 1)"
MATCH = f"{RECENT}, k(topic, kw) AS (VALUES {', '.join(f'({O.q(a)}, {O.q(b)})' for a, b in KEYWORDS)}), mt AS (SELECT DISTINCT url, topic FROM (SELECT *, lower(title || ' ' || summary) AS t FROM r), k WHERE CASE WHEN regexp_matches(kw, '^[a-z0-9]{{1,4}}$') THEN list_contains(regexp_extract_all(t, '[a-z0-9]+'), kw) ELSE contains(t, kw) END)"


def _items(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("source", F.substring("text", 1, 60).alias("title"), F.concat(F.lit("https://x.example/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("url"), (F.lit(1704067200) + F.col("doc_id") * 5400).alias("published_s"), F.expr("substr(text, 61)").alias("summary"))


def _recent(spark, sf_dir):
    return J.recent(_items(spark, sf_dir), NOW, DAYS)


def _matches(spark, sf_dir):
    return J.topic_matches(_recent(spark, sf_dir), spark.createDataFrame(KEYWORDS, "topic string, keyword string"))


@query(f"WITH {RECENT} SELECT url, source, published_s FROM r")
def j1_recent_items(spark, sf_dir):
    return _recent(spark, sf_dir).select("url", "source", "published_s")


@query(f"WITH {MATCH} SELECT * FROM mt")
def j2_topic_matches(spark, sf_dir):
    return _matches(spark, sf_dir)


@query(f"WITH {MATCH}, t(topic, has_coverage) AS (VALUES {', '.join(f'({O.q(a)}, {str(b).lower()})' for a, b in TOPICS)}), n AS (SELECT t.topic, has_coverage, count(url) AS matches FROM t LEFT JOIN mt ON t.topic = mt.topic GROUP BY ALL) SELECT topic, matches, CAST(row_number() OVER (ORDER BY matches DESC, topic) AS INT) AS rank, NOT has_coverage AS gap FROM n")
def j3_topic_ranking(spark, sf_dir):
    return J.topic_ranking(spark.createDataFrame(TOPICS, "topic string, has_coverage boolean"), _matches(spark, sf_dir)).select("topic", "matches", "rank", "gap")


@query(f"WITH {RECENT}, t AS (SELECT url, unnest(list_distinct(regexp_extract_all(lower(title || ' ' || summary), '[a-z][a-z0-9-]{{3,}}|[ァ-ヶー]{{3,}}'))) AS term FROM r), d AS (SELECT term, count(*) AS df FROM t GROUP BY term) SELECT term, df FROM d WHERE df >= 3 AND term NOT IN ({', '.join(map(O.q, STOP_WORDS))}) AND NOT contains('erst', term) ORDER BY df DESC, term LIMIT 15")
def j4_emerging_terms(spark, sf_dir):
    return J.emerging_terms(_recent(spark, sf_dir), spark.createDataFrame(KEYWORDS, "topic string, keyword string"), STOP_WORDS)


@query(f"WITH {MATCH} SELECT topic, url, CAST(k AS INT) AS k FROM (SELECT topic, url, row_number() OVER (PARTITION BY topic ORDER BY published_s DESC, source, url) AS k FROM mt JOIN r USING (url)) WHERE k <= 3")
def j5_latest_per_topic(spark, sf_dir):
    return J.latest_per_topic(_recent(spark, sf_dir), _matches(spark, sf_dir)).select("topic", "url", "k")


@query(f"WITH {RECENT}, s AS (SELECT DISTINCT source FROM i UNION SELECT 'silent') SELECT s.source, count(r.url) AS n FROM s LEFT JOIN r ON r.source = s.source GROUP BY s.source")
def j6_per_source(spark, sf_dir):
    sources = _items(spark, sf_dir).select("source").union(spark.createDataFrame([("silent",)], "source string")).distinct()
    return J.per_source(_recent(spark, sf_dir), sources)
