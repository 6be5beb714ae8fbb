"""Queries over message texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as T
from ..operators import content as C
from . import oracle as O
from .catalog import query
from .views import messages, read

ALL_TERMS = [t for terms in lx.PERSUASION.values() for t in terms] + lx.URGENCY + lx.MONEY + lx.ROUTE_CHANGE
ALL_TERMS = list(dict.fromkeys(ALL_TERMS))
N = O.normed()
B = ["b1", "b2"]


@query(f"WITH {N} SELECT msg_id, md5(b1) AS form, md5(b2) AS spaced_form FROM n")
def b1_b2_normal_forms(spark, sf_dir):
    a, b = T.both_forms(F.col("body"))
    return messages(spark, sf_dir).select("msg_id", F.md5(a).alias("form"), F.md5(b).alias("spaced_form"))


@query(f"WITH {O.M} SELECT msg_id, md5({O.norm('body', True)}) AS form, md5({O.spaced('body', True)}) AS spaced_form FROM m")
def b3_screener_forms(spark, sf_dir):
    a, b = T.both_forms(F.col("body"), True)
    return messages(spark, sf_dir).select("msg_id", F.md5(a).alias("form"), F.md5(b).alias("spaced_form"))


@query("SELECT doc_id, md5(translate(text || '１２３', '０１２３４５６７８９', '0123456789')) AS folded FROM documents")
def b5_fold_digits(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.fold_digits(F.concat("text", F.lit("１２３")))).alias("folded"))


@query("SELECT page_id, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#]*@)?([^/?#:]*)', 1)) AS host FROM pages")
def b14_hosts(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.url_host(F.col("url")).alias("host"))


@query(f"WITH {O.M} SELECT msg_id, {O.domain('from_addr')} AS domain, nullif(trim(regexp_extract('\"X Y\" <' || from_addr || '>', '^\"?([^<\"]*)\"? <', 1)), '') AS shown FROM m")
def b16_addresses(spark, sf_dir):
    header = F.concat(F.lit('"X Y" <'), "from_addr", F.lit(">"))
    return messages(spark, sf_dir).select("msg_id", T.address_domain(header).alias("domain"), T.display_name(header).alias("shown"))


@query(
    f"""WITH {O.M}, p AS (SELECT a.msg_id, regexp_replace(a.subject, '^\\s*([rR][eE]|[fF][wW][dD]?)\\s*:\\s*', '') AS x, b.subject AS y FROM m a JOIN m b ON b.msg_id = a.msg_id + 1),
    s AS (SELECT msg_id, x, list_distinct(list_filter(string_split_regex(lower(x), '\\s+'), lambda w: strlen(w) > 1)) AS u, list_distinct(list_filter(string_split_regex(lower(y), '\\s+'), lambda w: strlen(w) > 1)) AS v FROM p)
    SELECT msg_id, md5(x) AS base, round(CASE WHEN len(u) + len(v) = 0 THEN 1.0 ELSE len(list_intersect(u, v)) / CAST(len(list_distinct(list_concat(u, v))) AS DOUBLE) END, 6) AS similarity FROM s"""
)
def b17_subjects(spark, sf_dir):
    m = messages(spark, sf_dir)
    nxt = m.select((F.col("msg_id") - 1).alias("msg_id"), F.col("subject").alias("y"))
    base = T.strip_reply(F.col("subject"))
    return m.join(nxt, "msg_id").select("msg_id", F.md5(base).alias("base"), F.round(T.word_similarity(base, F.col("y")), 6).alias("similarity"))


@query(
    f"""WITH {O.M}, t AS (SELECT lower(unnest(regexp_extract_all(body, '[A-Za-z]+'))) AS token FROM m)
    SELECT token, count(*) AS n FROM t WHERE length(token) >= 2 AND token NOT IN ('the','a','an','is','are','was','were','be','been','and','or','of','to','in','for','on','at','by','this','that','it','its','with','from','have','has','will','please','your','our','we','you','i') GROUP BY token"""
)
def b13_tokens(spark, sf_dir):
    from ..operators.history import tokens

    return messages(spark, sf_dir).select(F.explode(tokens(F.col("body"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {N}, t AS (SELECT unnest({O.array(ALL_TERMS)}) AS term) SELECT term, count(*) AS n FROM n, t WHERE contains(b1, term) OR contains(b2, term) GROUP BY term")
def c1_lexicon_hits(spark, sf_dir):
    a, b = T.both_forms(F.col("body"))
    forms = messages(spark, sf_dir).select(a.alias("b1"), b.alias("b2"))
    return forms.select(F.explode(T.hits_of([F.col("b1"), F.col("b2")], ALL_TERMS)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


_PHRASES = [p.lower() for p in lx.OVERRIDE_PHRASES]
_TOKENS = [t.lower() for t in lx.SPECIAL_TOKENS]


@query(
    f"""WITH {O.M}, n AS (SELECT msg_id, body, {O.norm('body', True)} AS b1, {O.spaced('body', True)} AS b2 FROM m),
    f AS (SELECT msg_id, {O.count_of(B, _PHRASES)} AS p, {O.count_of('b1', _TOKENS)} AS t, list_aggregate(string_split(body, ''), 'entropy') AS e, strlen(body) AS k FROM n)
    SELECT msg_id, p + t AS n_risks, CASE WHEN p + t > 0 THEN 'blocked' WHEN e > 4.5 AND k > 40 THEN 'suspicious' ELSE 'clean' END AS verdict FROM f"""
)
def c2_prompt_screen(spark, sf_dir):
    return C.screen(messages(spark, sf_dir)).select("msg_id", F.size("risks").alias("n_risks"), "verdict")


@query("SELECT doc_id, round(list_aggregate(string_split(text, ''), 'entropy'), 6) AS entropy FROM documents")
def c3_entropy(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.round(C.char_entropy(F.col("text")), 6).alias("entropy"))


@query(
    f"""WITH {O.M}, n AS (SELECT msg_id, body, {O.norm('body', True)} AS b FROM m), w AS (SELECT *, string_split_regex(b, '\\s+') AS ws FROM n),
    f AS (SELECT msg_id, {O.any_of('b', lx.INSTRUCTION_MARKERS)} AS instruction,
      len(list_filter(ws, lambda w: contains(w, '@') AND contains(w, '.') AND regexp_matches(regexp_replace(regexp_replace(w, '^[^\\pL\\pN]+', ''), '[^\\pL\\pN]+$', ''), '^.+@[^@]*\\.[^@]*$'))) > 0 AS mail_target,
      len(list_filter(ws, lambda w: (starts_with(w, 'http://') OR starts_with(w, 'https://')) AND {O.any_of('w', lx.EXFILTRATION_PARAMS)})) > 0 AS url_target,
      {O.any_of('b', lx.CLEARANCE_CLAIMS)} AS forged FROM w)
    SELECT *, NOT (instruction OR mail_target OR url_target OR forged) AS safe FROM f"""
)
def c4_output_audit(spark, sf_dir):
    return C.audit(messages(spark, sf_dir)).select("msg_id", "instruction", "mail_target", "url_target", "forged", "safe")


@query(
    f"""WITH {O.M}, n AS (SELECT msg_id, body, {O.norm('body', True)} AS b1, {O.spaced('body', True)} AS b2 FROM (SELECT msg_id, body || CASE WHEN msg_id % 40 = 3 THEN chr(8203) ELSE '' END AS body FROM m)),
    f AS (SELECT msg_id, {O.any_of(B, _PHRASES)} OR {O.any_of('b1', _TOKENS)} AS hit, list_aggregate(string_split(body, ''), 'entropy') > 4.5 AND strlen(body) > 40 AS high, msg_id % 40 = 3 AS z FROM n)
    SELECT CASE WHEN hit OR z THEN 'block' WHEN high THEN 'advisory' ELSE 'clean' END AS gate, count(*) AS n FROM f GROUP BY 1"""
)
def c5_preflight(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("body", F.concat("body", F.when(F.col("msg_id") % 40 == 3, "​").otherwise("")))
    return C.preflight(m).groupBy("gate").agg(F.count("*").alias("n"))


def _hits(form: str, p: str) -> str:
    times = lambda s: f"(length({form}) - length(replace({form}, {O.q(s)}, ''))) // length({O.q(s)})"
    return "(" + times(p) + "".join(f" - {times(p + neg)}" for neg in lx.MEMORY_NEGATIONS) + ")"


@query(
    f"""WITH {O.M}, s AS (SELECT msg_id, CASE msg_id % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'system' ELSE 'mail' END AS source, body FROM m),
    n AS (SELECT *, {O.norm('body')} AS b1, {O.spaced('body')} AS b2 FROM s),
    h AS (SELECT msg_id, source, body, {' + '.join(f'greatest({_hits("b1", p)}, {_hits("b2", p)})' for p in lx.MEMORY_PATTERNS)} AS hits FROM n),
    v AS (SELECT msg_id, CASE WHEN source = 'mail' AND hits > 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE source WHEN 'user' THEN 0.9::DOUBLE WHEN 'system' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END - 0.2::DOUBLE * hits - CASE WHEN strlen(body) > 500 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)) END AS score FROM h)
    SELECT msg_id, round(score, 6) AS score, score >= 0.5 - 1e-9 AS accepted FROM v"""
)
def c7_memory_trust(spark, sf_dir):
    m = messages(spark, sf_dir)
    source = F.when(F.col("msg_id") % 3 == 0, "user").when(F.col("msg_id") % 3 == 1, "system").otherwise("mail")
    score = C.memory_score(source, F.col("body"))
    return m.select("msg_id", F.round(score, 6).alias("score"), (score >= 0.5 - 1e-9).alias("accepted"))


@query(f"WITH {N} SELECT msg_id, CASE WHEN {O.any_of(B, lx.FINANCIAL)} AND {O.any_of(B, lx.VERIFY_URGENCY)} THEN 'strong' WHEN {O.any_of(B, lx.FINANCIAL)} OR {O.any_of(B, lx.VERIFY_URGENCY)} THEN 'optional' ELSE 'none' END AS recommendation FROM n")
def c8_verification(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", C.verification(F.col("body")).alias("recommendation"))


@query(f"WITH {N} SELECT msg_id, greatest({', '.join(' + '.join(f'CAST({O.any_of(b, t)} AS INT)' for t in lx.PERSUASION.values()) for b in B)}) AS score FROM n")
def c9_persuasion(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", C.persuasion(F.col("body")).alias("score"))


@query(f"WITH {N} SELECT msg_id, {O.any_of(B, lx.URGENCY)} AND {O.any_of(B, lx.MONEY)} AS money_urgency, {O.any_of(B, lx.ROUTE_CHANGE)} AS route_change, {O.any_of(B, lx.CHANNEL_MIGRATION)} AS channel_move FROM n")
def c10_content_flags(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", *(c.alias(k) for k, c in C.content_flags(F.col("body")).items()))


@query(
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '東京ですありがとうございます' ELSE text END AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) = 0 THEN 'other' WHEN length(regexp_replace(t, '[^\\x{3041}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{4E00}-\\x{9FFF}]', '', 'g')) / length(t) > 0.15 THEN 'japanese'
      WHEN length(regexp_replace(t, '[^A-Za-z]', '', 'g')) / length(t) > 0.40 THEN 'english' ELSE 'other' END AS language FROM d"""
)
def c11_language(spark, sf_dir):
    t = F.when(F.col("doc_id") % 5 == 0, "東京ですありがとうございます").otherwise(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", C.language(t).alias("language"))


def _times(form: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"(length({form}) - length(replace({form}, {O.q(t)}, ''))) // {len(t)}" for t in terms) + ")"


@query(
    f"""WITH {O.M}, a AS (SELECT msg_id, body, string_split(regexp_replace(body, '\\n$', ''), chr(10)) AS ls, {_times('body', lx.POLITE[0])} + {_times('lower(body)', lx.POLITE[1])} AS po, {_times('body', lx.CASUAL[0])} + {_times('lower(body)', lx.CASUAL[1])} AS ca FROM m)
    SELECT msg_id, len(list_filter(string_split(body, chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S'))) AS paragraphs, len(regexp_extract_all(body, '[。．.!?！？]')) AS sentences, len(regexp_extract_all(body, '[、，,]')) AS commas, length(body) AS chars,
      len(list_filter(ls[greatest(1, len(ls) - 4):], lambda x: regexp_matches(x, '\\S'))) AS signature_lines, round(CASE WHEN po + ca = 0 THEN 0.5::DOUBLE ELSE po / (po + ca) END, 6) AS formality FROM a"""
)
def c12_style(spark, sf_dir):
    return C.style(messages(spark, sf_dir)).select("msg_id", "paragraphs", "sentences", "commas", "chars", "signature_lines", F.round("formality", 6).alias("formality"))


@query(
    """WITH d AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT doc_id, text || CASE WHEN doc_id % 4 < 2 THEN repeat(chr(10) || '████ ████', CAST(6 + doc_id % 4 * 2 AS INT)) ELSE '' END AS t FROM documents)),
    f AS (SELECT doc_id, i, length(trim(line)) >= 8 AND length(regexp_replace(trim(line), '[^█▀▄▌▐░▒▓■□▪▫◼◻●○◾◽⬛⬜　]', '', 'g')) / length(trim(line)) >= 0.5 AS ok FROM d),
    g AS (SELECT doc_id, ok, i - row_number() OVER (PARTITION BY doc_id, ok ORDER BY i) AS grp FROM f), r AS (SELECT doc_id, max(CASE WHEN ok THEN n ELSE 0 END) AS best FROM (SELECT doc_id, ok, grp, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
    SELECT doc_id, best >= 8 AS has_code FROM r"""
)
def c13_block_codes(spark, sf_dir):
    k = F.col("doc_id") % 4
    t = F.concat("text", F.when(k < 2, F.repeat(F.lit("\n████ ████"), (6 + k * 2).cast("int"))).otherwise(""))
    return read(spark, sf_dir, "documents").select("doc_id", C.block_code(t).alias("has_code"))


@query("WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text || ' call +81 (90) 1234-5678', '[0-9+() -]+')) AS run FROM documents) SELECT doc_id, regexp_replace(run, '[^0-9+]', '', 'g') AS number FROM r WHERE length(regexp_replace(run, '[^0-9]', '', 'g')) BETWEEN 10 AND 15")
def c14_phones(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.lit(" call +81 (90) 1234-5678")))
    return C.phones(d, "doc_id", "text").select("doc_id", "number")


def host_sql(hosts: dict[str, str]) -> str:
    rows = ", ".join(f"({O.q(h)}, {O.q(k)})" for h, k in hosts.items())
    return f"""WITH {O.M}, w AS (SELECT msg_id, rtrim(unnest(string_split_regex(body, '\\s+')), '.,)]!?;') AS url FROM m), h AS (SELECT msg_id, url, regexp_extract(url, '^(?:.*?://)?([^/?#:]*)', 1) AS host FROM w),
    t(d, kind) AS (VALUES {rows}) SELECT msg_id, url, kind FROM h, t WHERE host = d OR ends_with(host, '.' || d)"""


CHANNELS = " || CASE msg_id % 4 WHEN 0 THEN ' https://teams.microsoft.com/l/meetup-join/19?x=1&tenantId=t-' || msg_id || '&y=2' WHEN 1 THEN ' https://acme.slack.com/join' WHEN 2 THEN ' https://t.me/pay_bot' ELSE ' https://zoom.us/my/room' END"


@query(
    f"""SELECT msg_id, url, kind, CASE WHEN kind = 'teams' AND contains(url, 'teams.microsoft.com/l/meetup-join/') AND contains(url, 'tenantId=') THEN regexp_extract(url, 'tenantId=([^&]*)', 1) END AS tenant, CASE WHEN kind = 'slack' AND regexp_matches(url, 'https://.*[.]slack[.]com') THEN regexp_extract(url, 'https://(.*?)[.]slack[.]com', 1) END AS workspace,
    CASE WHEN kind = 'zoom' THEN CASE WHEN contains(url, '/j/') THEN regexp_extract(url, '/j/([0-9]*)', 1) ELSE 'unknown' END END AS meeting_id, kind = 'zoom' AND (contains(url, 'pwd=') OR contains(url, '&p=')) AS has_password, kind = 'telegram' AND (contains(url, '_bot') OR contains(url, 'bot?')) AS is_bot, kind IN ('whatsapp', 'telegram', 'signal') AS high_risk
    FROM ({host_sql(lx.MEETING_HOSTS).replace('string_split_regex(body,', f'string_split_regex(body{CHANNELS},')})"""
)
def c15_channel_links(spark, sf_dir):
    planted = messages(spark, sf_dir).withColumn("body", F.expr("body" + CHANNELS))
    return C.channel_links(planted, "msg_id")


@query(host_sql(lx.DOCUMENT_HOSTS))
def c16_document_links(spark, sf_dir):
    return C.links_by_host(messages(spark, sf_dir), "msg_id", lx.DOCUMENT_HOSTS)


WALLETS = f"""WITH {O.M}, w AS (SELECT msg_id, regexp_replace(regexp_replace(unnest(string_split_regex(body, '\\s+')), '^[^\\pL\\pN]+', ''), '[^\\pL\\pN]+$', '') AS address FROM m),
    c AS (SELECT msg_id, address, CASE WHEN regexp_matches(address, '^0[xX][0-9A-Fa-f]{{40}}$') THEN 'ETH' WHEN regexp_matches(address, '^bc1[A-Za-z0-9]{{23,59}}$|^[13][A-Za-z0-9]{{26,33}}$') THEN 'BTC' END AS currency FROM w)
    SELECT msg_id, currency, address FROM c WHERE currency IS NOT NULL"""


@query(WALLETS)
def c17_wallets(spark, sf_dir):
    return C.wallets(messages(spark, sf_dir), "msg_id")


@query(
    f"""WITH {N}, a AS (SELECT msg_id, CASE msg_id % 4 WHEN 0 THEN 'clip.mp4' WHEN 1 THEN 'voice.mp3' ELSE 'note.txt' END AS filename FROM m),
    f AS (SELECT msg_id, {O.any_of(B, lx.FINANCIAL)} AS fin, {O.any_of(B, lx.VERIFY_URGENCY)} AS urg FROM n)
    SELECT msg_id, CASE WHEN fin AND urg THEN 'high' WHEN fin OR urg THEN 'medium' ELSE 'low' END AS severity FROM f JOIN a USING (msg_id) WHERE filename <> 'note.txt'"""
)
def c18_media_advisory(spark, sf_dir):
    from ..operators.attachments import media_advisory

    m = messages(spark, sf_dir)
    k = F.col("msg_id") % 4
    a = m.select("msg_id", F.when(k == 0, "clip.mp4").when(k == 1, "voice.mp3").otherwise("note.txt").alias("filename"), F.lit(None).cast("string").alias("declared_mime"))
    return media_advisory(a, m).select("msg_id", "severity")


def _redacted(x: str) -> str:
    x = f"translate({x}, {O.q(lx.FULL_WIDTH)}, {O.q(lx.HALF_WIDTH)})"
    for pattern, put in (
        ("(?:[ -]*[0-9]){16}|(?:[ -]*[0-9]){13,15}[ -]*", "[REDACTED-CC]"), ("([A-Za-z0-9][A-Za-z0-9._-]{2})[A-Za-z0-9._-]+@", "\\1***@"), ("Bearer \\S*", "Bearer [REDACTED]"),
        ("[0-9](?:[-() ]*[0-9]){9,10}[-() ]*([^-() 0-9]|$)", "[TEL-REDACTED]\\1"),
    ):
        x = f"regexp_replace({x}, {O.q(pattern)}, {O.q(put)}, 'g')"
    return x


PRIVATE = "body || ' mail anna.b-lee@mail.example or .x_yz.w@m.example, call 090-1234-5678 (03) 1234-5678 now, Bearer abc.def'"


@query(f"WITH {O.M} SELECT msg_id, {_redacted(PRIVATE)} AS redacted FROM m")
def c19_redaction(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", C.redact(F.expr(PRIVATE)).alias("redacted"))


_ESCAPED = "text || ' a%2541%41%0A%zz%E9%' || doc_id"


def _percent_once(x: str) -> str:
    part = "CASE WHEN regexp_matches(p, '^[2-9A-Fa-f][0-9A-Fa-f]') THEN chr(('0x' || p[1:2])::INT) || p[3:] ELSE '%' || p END"
    return f"string_split({x}, '%')[1] || array_to_string(list_transform(string_split({x}, '%')[2:], lambda p: {part}), '')"


@query(f"WITH a AS (SELECT doc_id, {_ESCAPED} AS x FROM documents), b AS (SELECT doc_id, {_percent_once('x')} AS x FROM a), c AS (SELECT doc_id, {_percent_once('x')} AS x FROM b) SELECT doc_id, md5({_percent_once('x')}) AS decoded FROM c")
def b6_percent_decode(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.percent_decode(F.expr(_ESCAPED))).alias("decoded"))


_LINK = "url || '&q=a+b%20c%C3%A9%zz&amp;z=1'"


@query(f"SELECT page_id, url_decode({_LINK}) AS kept_plus, replace(url_decode(replace({_LINK}, '+', ' ')), '&amp;', '&') AS unwrapped FROM pages")
def b7_url_decode(spark, sf_dir):
    from ..operators.links import decoded

    return read(spark, sf_dir, "pages").select("page_id", T.url_decoded(F.expr(_LINK)).alias("kept_plus"), decoded(F.expr(_LINK)).alias("unwrapped"))


@query("SELECT doc_id, md5(text || 'i<A&lt;') AS decoded FROM documents")
def b8_entities(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.decode_entities(F.concat("text", F.lit("&#105;&lt;&#x41;&amp;lt;")))).alias("decoded"))


#: A run of base64 letters without its padding, and as much of it as can be decoded.
_BARE = "rtrim(t, '=')"
_WHOLE = f"CASE WHEN length({_BARE}) % 4 = 1 THEN left({_BARE}, length({_BARE}) - 1) ELSE {_BARE} END"


@query(
    f"""WITH x AS (SELECT doc_id, regexp_extract_all(text || ' see ' || to_base64(encode(text)) || ' end', '[A-Za-z0-9+/=]{{20,}}') AS ts FROM documents),
    d AS (SELECT doc_id, list_transform(ts, lambda t: try(decode(from_base64(rpad({_WHOLE}, CAST(ceil(length({_WHOLE}) / 4) * 4 AS INT), '='))))) AS ds FROM x)
    SELECT doc_id, md5(array_to_string(list_filter(ds, lambda z: z IS NOT NULL), chr(10))) AS decoded FROM d"""
)
def b9_base64_tokens(spark, sf_dir):
    planted = F.concat("text", F.lit(" see "), F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit("")), F.lit(" end"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(T.decode_base64_tokens(planted), "\n")).alias("decoded"))


@query("SELECT doc_id, 'ok' AS payload FROM documents")
def b10_tag_payload(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.tag_payload(F.concat("text", F.lit("".join(chr(0xE0000 + ord(c)) for c in "ok")))).alias("payload"))


@query("SELECT doc_id, md5(text) AS stripped FROM documents")
def b11_emoji(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_emoji(F.concat("text", F.lit("🎉⭐")))).alias("stripped"))


_LETTERED = "text || ' see c o n f i d e n t i a l ' || doc_id"


@query(
    f"""WITH x AS (SELECT doc_id, string_split({_LETTERED}, '') AS cs FROM documents), i AS (SELECT doc_id, cs, list_filter(range(1, len(cs) + 1), lambda i: NOT (cs[i] = ' ' AND i > 1 AND regexp_matches(coalesce(cs[i - 1], ''), '[a-z]') AND NOT (i > 2 AND regexp_matches(cs[i - 2], '[a-z]')) AND regexp_matches(coalesce(cs[i + 1], ''), '[a-z]') AND NOT regexp_matches(coalesce(cs[i + 2], ''), '[A-Za-z]'))) AS kept FROM x)
    SELECT doc_id, md5(array_to_string(list_transform(kept, lambda i: cs[i]), '')) AS closed FROM i"""
)
def b12_letter_spacing(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.collapse_letters(F.expr(_LETTERED))).alias("closed"))


@query(
    f"""WITH s AS (SELECT doc_id, text AS summary, string_split_regex({O.norm('text', True)}, '\\s+') AS ws FROM documents)
    SELECT doc_id AS report_id, CASE WHEN doc_id % 7 = 0 THEN 'email_id_mismatch' WHEN doc_id % 5 = 0 THEN 'score'
      WHEN len(list_filter(ws, lambda w: contains(w, '@') AND contains(w, '.') AND regexp_matches(regexp_replace(regexp_replace(w, '^[^\\pL\\pN]+', ''), '[^\\pL\\pN]+$', ''), '^.+@[^@]*\\.[^@]*$'))) > 0 THEN 'audit' WHEN length(summary) > 280 THEN 'summary_length' END AS reason FROM s"""
)
def c6_report_validation(spark, sf_dir):
    from ..operators.reports import validate_reports

    d, k = read(spark, sf_dir, "documents"), F.col("doc_id")
    name = k.cast("string")
    reports = d.select(k.alias("report_id"), F.when(k % 7 == 0, "other").otherwise(name).alias("email_id"), F.when(k % 5 == 0, 2.0).otherwise(0.5).alias("score"), F.array(F.lit("note")).alias("topics"), F.col("text").alias("summary"), name.alias("source_id"))
    return validate_reports(reports, d.select(name.alias("source_id"), name.alias("email_id"))).select("report_id", "reason")


@query(f"SELECT doc_id, {_redacted('text')} AS body FROM documents")
def c20_sensitive_columns(spark, sf_dir):
    return C.redact_columns(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), F.col("n_chars").alias("token")))
