"""Queries over links and domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as T
from ..operators import links as L
from . import oracle as O
from .catalog import query
from .views import messages, read

U = f"{O.M}, w AS (SELECT msg_id, unnest(string_split_regex(body, '\\s+')) AS w, generate_subscripts(string_split_regex(body, '\\s+'), 1) - 1 AS pos FROM m), u AS (SELECT msg_id, pos, rtrim(w, '.,)]!?;') AS url FROM w WHERE regexp_matches(w, '^https?://'))"
HOST = "lower(regexp_extract({}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#]*@)?([^/?#:]*)', 1))"


def _is(h: str, d: str) -> str:
    return f"({h} = {O.q(d)} OR ends_with({h}, {O.q('.' + d)}))"


def _score() -> str:
    low, h = "lower(url)", "regexp_extract(lower(url), '^(?:https?://)*([^/?#]*)', 1)"
    legit = "(" + " OR ".join(_is(h, d) for d in L.AUTH_DOMAINS) + ")"
    param = lambda p: f"regexp_matches({low}, '[?&#]{p}=')"
    terms = [f"CASE WHEN {param(p)} THEN 25 ELSE 0 END" for p in L.TOKEN_PARAMS] + [f"CASE WHEN NOT {legit} AND {param(p)} THEN 15 ELSE 0 END" for p in L.OAUTH_PARAMS]
    terms.append("CASE WHEN " + " OR ".join(f"(contains({h}, {O.q(d)}) AND NOT {_is(h, d)})" for d in L.AUTH_DOMAINS) + " THEN 50 ELSE 0 END")
    terms += [f"CASE WHEN contains({low}, {O.q(p)}) THEN 30 ELSE 0 END" for p in L.KIT_PATTERNS] + [f"CASE WHEN contains({low}, {O.q(p)}) THEN 15 ELSE 0 END" for p in L.PROXY_PATHS]
    terms.append(f"CASE WHEN {O.any_of(low, ['redirect=', 'next=', 'url='])} AND contains({low}, 'http') THEN 20 ELSE 0 END")
    return f"least(100, {' + '.join(terms)})"


@query(f"WITH {U} SELECT msg_id, url, {_score()} AS score, CASE WHEN {_score()} >= 50 THEN 'dangerous' WHEN {_score()} >= 20 THEN 'caution' ELSE 'safe' END AS verdict FROM u")
def e1_proxy_urls(spark, sf_dir):
    return L.with_proxy_score(L.urls(messages(spark, sf_dir), "msg_id")).select("msg_id", "url", "score", L.proxy_verdict(F.col("score")).alias("verdict"))


@query(
    f"""WITH {O.M}, d AS (SELECT DISTINCT split_part(from_addr, '@', 2) || x AS domain FROM m, (VALUES (''), ('а'), ('ωа')) t(x))
    SELECT domain, round(least(1.0::DOUBLE, len(list_filter(string_split(lower(domain), '.'), lambda l: starts_with(l, 'xn--'))) * 0.4::DOUBLE + CASE WHEN regexp_matches(domain, '[{L.HOMOGLYPHS}]') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN CAST(regexp_matches(domain, '[A-Za-z]') AS INT) + CAST(regexp_matches(domain, '[\\x{{0400}}-\\x{{04FF}}]') AS INT) + CAST(regexp_matches(domain, '[\\x{{0370}}-\\x{{03FF}}]') AS INT) >= 2 THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END), 6) AS risk FROM d"""
)
def e2_idn_risk(spark, sf_dir):
    base = messages(spark, sf_dir).select(F.element_at(F.split("from_addr", "@"), 2).alias("d")).distinct()
    d = base.select(F.explode(F.array(*[F.concat("d", F.lit(x)) for x in ("", "а", "ωа")])).alias("domain")).distinct()
    return d.select("domain", F.round(L.idn_risk(F.col("domain")), 6).alias("risk"))


CONTACTS = ["partner.examples", "gooogle.com"]
_NEAR = "coalesce(" + ", ".join([f"CASE WHEN levenshtein(domain, 'companyy.example') = 1 THEN 'companyy.example' END"] + [f"CASE WHEN levenshtein(domain, {O.q(w)}) BETWEEN 1 AND 2 THEN {O.q(w)} END" for w in lx.WATCHED_DOMAINS] + [f"CASE WHEN levenshtein(domain, {O.q(c)}) = 1 THEN {O.q(c)} END" for c in CONTACTS]) + ")"


@query(f"WITH {O.M}, d AS (SELECT {O.domain('from_addr')} AS domain, count(*) AS n FROM m GROUP BY 1) SELECT domain, n, {_NEAR} AS resembles FROM d")
def e3_lookalike_domains(spark, sf_dir):
    d = messages(spark, sf_dir).select(T.address_domain(F.col("from_addr")).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))
    return d.join(L.lookalikes(d, "companyy.example", contacts(spark)), "domain", "left")


def contacts(spark):
    return spark.createDataFrame([(c,) for c in CONTACTS], "domain string")


PLANTED = [
    "https://www.google.com/a", "http://192.168.0.1/x", "https://bit.ly/q", "https://g00gle.com/", "https://goggle.com/", "https://user@evil.example/", "https://login.google.com.evil.example/",
    "https://free.tk/", "https://safe-links.example/", "https://google-com.example/", "https://xn--pypal-4ve.com/", "https://safelinks.protection.outlook.com/?url=x", "https://-bad.example/", "https://plain.example/",
]


def _reputation(url: str) -> str:
    h = HOST.format(url)
    f = f"replace({h}, '-', '.')"
    trusted = lambda x: "(" + " OR ".join(_is(x, t) for t in L.TRUSTED) + ")"
    inside = lambda x: "(" + " OR ".join(f"starts_with({x}, {O.q(t + '.')}) OR contains({x}, {O.q('.' + t + '.')})" for t in L.TRUSTED) + ")"
    swap = "(" + " OR ".join(f"(contains({h}, {O.q(b)}) AND NOT contains({h}, {O.q(b.replace('0', 'o').replace('1', 'l'))}))" for b in L.DIGIT_SWAPS) + ")"
    rules = [
        ("(" + " OR ".join(_is(h, r) for r in L.REWRITERS) + f") OR (starts_with({h}, 'protect-') AND ends_with({h}, '.mimecast.com'))", "suspicious"),
        (f"contains({url}, '@') OR regexp_matches({h}, '(?:^|\\.)-|-(?:\\.|$)')", "suspicious"),
        (f"{f} <> {h} AND ({trusted(f)} OR {inside(f)})", "suspicious"),
        (trusted(h), "trusted"),
        (f"regexp_matches({h}, '^(?:[0-9]+|0[xX][0-9A-Fa-f]+)(?:\\.(?:[0-9]+|0[xX][0-9A-Fa-f]+))*$')", "suspicious"),
        (f"regexp_matches({h}, '(?:^|\\.)xn--|[^\\x00-\\x7F]')", "suspicious"),
        ("(" + " OR ".join(_is(h, s) for s in L.CODE_SHORTENERS) + ")", "suspicious"),
        ("(" + " OR ".join(f"ends_with({h}, {O.q(t)})" for t in L.FREE_TLDS) + ")", "suspicious"),
        (inside(h), "suspicious"),
        ("(" + " OR ".join(f"levenshtein({h}, {O.q(t)}) BETWEEN 1 AND 3" for t in L.TRUSTED) + ")", "suspicious"),
        (swap, "suspicious"),
    ]
    return "CASE " + " ".join(f"WHEN {a} THEN '{b}'" for a, b in rules) + " ELSE 'neutral' END"


@query(f"WITH {U}, a AS (SELECT url FROM u UNION ALL SELECT url FROM pages UNION ALL SELECT unnest({O.array(PLANTED)})) SELECT url, count(*) AS n, {_reputation('url')} AS reputation FROM a GROUP BY url")
def e4_url_reputation(spark, sf_dir):
    planted = spark.createDataFrame([(u,) for u in PLANTED], "url string")
    every = L.urls(messages(spark, sf_dir), "msg_id").select("url").union(read(spark, sf_dir, "pages").select("url")).union(planted)
    return L.with_reputation(every.groupBy("url").agg(F.count("*").alias("n")))


@query(
    """WITH p AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 'https://eur01.safelinks.protection.outlook.com/?url=' || url_encode(url) || '&data=1' WHEN 1 THEN 'https://slack-redir.net/link?url=' || url_encode(url)
      WHEN 2 THEN 'https://www.google.com/url?q=' || url_encode(url) ELSE url END AS wrapped FROM pages) SELECT page_id, wrapped, url AS unwrapped FROM p"""
)
def e5_unwrapped_links(spark, sf_dir):
    p, k = read(spark, sf_dir, "pages"), F.col("page_id") % 4
    coded = F.replace(F.url_encode("url"), F.lit("+"), F.lit("%20"))
    wrapped = F.when(k == 0, F.concat(F.lit("https://eur01.safelinks.protection.outlook.com/?url="), coded, F.lit("&data=1"))).when(k == 1, F.concat(F.lit("https://slack-redir.net/link?url="), coded)).when(k == 2, F.concat(F.lit("https://www.google.com/url?q="), coded)).otherwise(F.col("url"))
    return p.select("page_id", wrapped.alias("wrapped")).withColumn("unwrapped", L.unwrap(F.col("wrapped")))


@query(f"WITH x AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN ' JavaScript:alert(1)' ELSE 'plain text' END AS payload FROM pages) SELECT page_id, CASE WHEN regexp_matches(payload, '^https?://') THEN {_reputation('payload')} WHEN regexp_matches(lower(ltrim(payload)), '^(blob:|data:|javascript:)') THEN 'suspicious' ELSE 'neutral' END AS reputation FROM x")
def e6_decoded_payloads(spark, sf_dir):
    k = F.col("page_id") % 3
    payload = F.when(k == 0, F.col("url")).when(k == 1, " JavaScript:alert(1)").otherwise("plain text")
    return read(spark, sf_dir, "pages").select("page_id", L.payload_reputation(payload).alias("reputation"))


@query(f"WITH {U}, c AS (SELECT msg_id, count(*) AS n FROM u GROUP BY msg_id) SELECT msg_id, n, CASE WHEN n <= 1 THEN 'normal' WHEN n = 2 THEN 'elevated' ELSE 'split_suspected' END AS risk FROM c")
def e7_code_counts(spark, sf_dir):
    return L.urls(messages(spark, sf_dir), "msg_id").groupBy("msg_id").agg(F.count("*").alias("n")).withColumn("risk", L.code_count_risk(F.col("n")))


@query(f"WITH {U} SELECT msg_id, url FROM u WHERE {O.any_of('lower(url)', ['://' + d for d in L.LINK_SHORTENERS])}")
def e8_shortened_links(spark, sf_dir):
    return L.urls(messages(spark, sf_dir), "msg_id").where(L.shortened(F.col("url"))).select("msg_id", "url")


_AH = "lower(regexp_extract(url, '^(?:https?://)*(?:[^/?]*@)?([^/?:]*)', 1))"
_REAL = "coalesce(" + ", ".join(f"CASE WHEN {_is(_AH, d)} THEN {O.q(p)} END" for d, p in L.PLATFORMS.items()) + ")"
_FAKE = "coalesce(" + ", ".join(f"CASE WHEN contains({_AH}, {O.q(d)}) AND NOT {_is(_AH, d)} THEN {O.q(p)} END" for d, p in L.PLATFORMS.items()) + ")"
_ALL_URLS = f"{U}, a AS (SELECT msg_id, url FROM u UNION ALL SELECT msg_id, 'https://dropbox.com.evil.example/' || msg_id FROM m WHERE msg_id % 50 = 0)"


def _all_urls(spark, sf_dir):
    m = messages(spark, sf_dir)
    return L.urls(m, "msg_id").select("msg_id", "url").union(m.where("msg_id % 50 = 0").select("msg_id", F.concat(F.lit("https://dropbox.com.evil.example/"), F.col("msg_id").cast("string"))))


@query(f"WITH {_ALL_URLS} SELECT msg_id, url, {_REAL} AS platform, {_FAKE} AS impersonated FROM a")
def e9_platforms(spark, sf_dir):
    return _all_urls(spark, sf_dir).select("msg_id", "url", L.platform(F.col("url")).alias("platform"), L.impersonated(F.col("url")).alias("impersonated"))


BLOCKED = ["evil.example"]
_LINKS = f"""{U}, a AS (SELECT msg_id, url FROM u UNION ALL SELECT msg_id, CASE msg_id // 50 % 4 WHEN 0 THEN 'https://dropbox.com.bad.example/' || msg_id WHEN 1 THEN 'https://dropbox.com.evil.example/' || msg_id WHEN 2 THEN 'https://drive.google.com/open?next=https%3A%2F%2Fx.evil.example%2Fa&u=1' ELSE 'https://box.com/s?note=forget+everything&r=https://notevil.example/' END FROM m WHERE msg_id % 50 = 0),
    h AS (SELECT msg_id, url, {_AH} AS host, coalesce({_REAL}, {_FAKE}) AS plat, url_decode(replace(regexp_extract(url, '[?&](?:redirect|url|to|dest|link|next|continue|r)=([^&]*)', 1), '+', '%2B')) AS target FROM a),
    k AS (SELECT *, {_is('host', BLOCKED[0])} AS hit, coalesce({_is("CASE WHEN regexp_matches(target, '^https?://') THEN " + _AH.replace('url', 'target') + " END", BLOCKED[0])}, false) AS via, coalesce({' OR '.join(f"(plat = {O.q(p)} AND contains(url, {O.q(d)}) AND NOT {_is('host', d)})" for d, p in L.PLATFORMS.items())}, false) AS like_,
      {O.any_of('lower(url)', ['login', 'signin', 'auth'])} AS login, {O.any_of('lower(url)', ['://' + d for d in L.LINK_SHORTENERS])} AS short, {O.any_of('lower(url)', [p.lower() for p in lx.OVERRIDE_PHRASES])} AS injected, msg_id % 2 = 0 AS familiar FROM h)"""


@query(
    f"""WITH {_LINKS} SELECT msg_id, url, CASE WHEN short THEN 'warn' WHEN hit OR via OR injected THEN 'block' WHEN like_ THEN 'suspicious' WHEN login THEN 'warn' WHEN familiar THEN 'safe' ELSE 'caution' END AS risk,
    CASE WHEN short THEN 'shortener' ELSE array_to_string(list_filter([CASE WHEN hit THEN 'blocked_host' END, CASE WHEN via AND NOT hit THEN 'blocked_redirect' END, CASE WHEN like_ AND NOT hit AND NOT via THEN 'imitation' END, CASE WHEN NOT hit AND NOT via AND NOT like_ THEN CASE WHEN familiar THEN 'familiar' ELSE 'unfamiliar' END END,
      CASE WHEN login THEN 'login_words' END, CASE WHEN injected THEN 'prompt_injection' END], lambda z: z IS NOT NULL), ',') END AS reasons FROM k WHERE short OR plat IS NOT NULL"""
)
def e10_link_risk(spark, sf_dir):
    m = messages(spark, sf_dir)
    planted = """CASE msg_id div 50 % 4 WHEN 0 THEN 'https://dropbox.com.bad.example/' || msg_id WHEN 1 THEN 'https://dropbox.com.evil.example/' || msg_id WHEN 2 THEN 'https://drive.google.com/open?next=https%3A%2F%2Fx.evil.example%2Fa&u=1' ELSE 'https://box.com/s?note=forget+everything&r=https://notevil.example/' END"""
    urls = L.urls(m, "msg_id").select("msg_id", "url").union(m.where("msg_id % 50 = 0").selectExpr("msg_id", planted))
    return L.with_link_risk(urls, F.col("msg_id") % 2 == 0, spark.createDataFrame([(d,) for d in BLOCKED], "domain string")).where("risk IS NOT NULL").select("msg_id", "url", "risk", F.array_join("reasons", ",").alias("reasons"))


_ASKED = "url || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '&ref=z' WHEN 2 THEN '&ref=' || page_id || '&ref=y#ref=q' ELSE '&Ref=1&xref=2&ref=&page=' || page_id END"
_PARAM = lambda name: f"nullif(substr(list_filter(string_split_regex(regexp_replace(split_part({_ASKED}, '#', 1), '^[^?&]*[?&]?', ''), '&'), lambda p: starts_with(p, '{name}='))[1], {len(name) + 2}), '')"


@query(f"SELECT page_id, {_PARAM('ref')} AS ref, {_PARAM('page')} AS page FROM pages")
def b15_query_params(spark, sf_dir):
    asked = F.expr(_ASKED)
    return read(spark, sf_dir, "pages").select("page_id", T.query_param(asked, "ref").alias("ref"), T.query_param(asked, "page").alias("page"))


@query(f"SELECT doc_id, md5(lower(translate(text || ' раураl', {O.q(lx.FULL_WIDTH[:-1] + L.FOLD_FROM)}, {O.q(lx.HALF_WIDTH[:-1] + L.FOLD_TO)}))) AS folded FROM documents")
def b4_homoglyph_fold(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(L.fold_homoglyphs(F.concat("text", F.lit(" раураl")))).alias("folded"))
