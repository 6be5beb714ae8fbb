"""Queries over sensitive data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as T
from ..operators import dlp as D
from . import oracle as O
from .catalog import query
from .views import messages, read

DIGITS = "regexp_replace({}, '[^0-9]', '', 'g')"
BODY = "body || ' 1234 5678 9018 7000012050002'"
W = O.M + f", t AS (SELECT msg_id, {BODY} AS body, {DIGITS.format(BODY)} AS ds FROM m)"
_P = " + ".join(f"CAST(substr(ds, i + {10 - k}, 1) AS INT) * {w}" for k, w in enumerate((2, 3, 4, 5, 6, 7, 2, 3, 4, 5, 6)))
PERSONAL = f"len(list_filter(range(1, length(ds) - 10), lambda i: CAST(substr(ds, i + 11, 1) AS INT) = CASE WHEN ({_P}) % 11 < 2 THEN 0 ELSE 11 - ({_P}) % 11 END)) > 0"
_S = " + ".join(f"CAST(substr(ds, i + {12 - k}, 1) AS INT) * {1 if k % 2 == 0 else 2}" for k in range(12))
CORPORATE = f"len(list_filter(range(1, length(ds) - 11), lambda i: substr(ds, i, 1) <> '0' AND CAST(substr(ds, i, 1) AS INT) = 9 - ({_S}) % 9)) > 0"
_X = "regexp_replace(c, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({_X}) + 1), lambda k: CASE WHEN k % 2 = 0 THEN CASE WHEN CAST(substr(reverse({_X}), k, 1) AS INT) * 2 > 9 THEN CAST(substr(reverse({_X}), k, 1) AS INT) * 2 - 9 ELSE CAST(substr(reverse({_X}), k, 1) AS INT) * 2 END ELSE CAST(substr(reverse({_X}), k, 1) AS INT) END)) % 10 = 0"
CARD = f"len(list_filter(regexp_extract_all(body, {O.q(D.CARD)}), lambda c: {LUHN})) > 0"
_TURNED = "substr(regexp_replace(c, '[^A-Z0-9]', '', 'g'), 5) || substr(regexp_replace(c, '[^A-Z0-9]', '', 'g'), 1, 4)"
_NUMERIC = f"array_to_string(list_transform(string_split({_TURNED}, ''), lambda h: CASE WHEN h BETWEEN '0' AND '9' THEN h ELSE CAST(ascii(h) - 55 AS VARCHAR) END), '')"
IBAN_SQL = f"len(list_filter(regexp_extract_all(body, {O.q(D.IBAN)}), lambda c: length(regexp_replace(c, '[^A-Z0-9]', '', 'g')) BETWEEN 15 AND 34 AND CAST({_NUMERIC} AS HUGEINT) % 97 = 1)) > 0"
BIC_SQL = f"len(list_filter(regexp_extract_all(regexp_replace(body, '[^\\x00-\\x7F]', '_', 'g'), {O.q(D.BIC)}), lambda c: list_contains({O.array(lx.COUNTRIES)}, substr(c, 5, 2)))) > 0"
SSN_SQL = f"len(list_filter(regexp_extract_all(body, {O.q(D.SSN)}), lambda c: substr(c, 1, 3) NOT IN ('000', '666') AND substr(c, 1, 1) <> '9' AND substr(c, 5, 2) <> '00' AND substr(c, 8, 4) <> '0000')) > 0"
SQL = {
    "jp_personal_number": PERSONAL,
    "jp_corporate_number": CORPORATE,
    "payment_card": CARD,
    "iban": IBAN_SQL,
    "bank_code": BIC_SQL,
    "us_ssn": SSN_SQL,
    "ip_address": f"regexp_matches(body, {O.q(D.IPV4)})",
    "confidential": O.any_of("lower(body)", lx.CONFIDENTIAL),
    "privilege": O.any_of("lower(body)", lx.PRIVILEGE),
    "codename": f"regexp_matches(body, {O.q(D.CODENAME)})",
    "source_code": f"{O.count_of('body', lx.CODE_MARKERS)} >= 3",
    "medical": O.any_of("lower(body)", lx.MEDICAL),
}


def _messages(spark, sf_dir):
    return messages(spark, sf_dir).withColumn("body", F.concat("body", F.lit(" 1234 5678 9018 7000012050002")))


def _classifier(name: str, number: str):
    def run(spark, sf_dir):
        return _messages(spark, sf_dir).select("msg_id", D.CLASSIFIERS[name](F.col("body")).alias("found"))

    run.__name__ = f"{number}_{name}"
    return query(f"WITH {W} SELECT msg_id, {SQL[name]} AS found FROM t")(run)


for _number, _name in (("d1", "jp_personal_number"), ("d2", "jp_corporate_number"), ("d3", "payment_card"), ("d4", "iban"), ("d5", "bank_code"), ("d6", "us_ssn"), ("d7", "ip_address"), ("d8", "confidential"), ("d9", "privilege"), ("d9", "codename"), ("d9", "source_code"), ("d9", "medical")):
    _classifier(_name, _number)


def _rules_sql(direction: str) -> str:
    parts = []
    for r in D.DEFAULT_RULES:
        c = r["condition"]
        if r["direction"] != direction:
            continue
        if c.get("match") == "classifier":
            sql = SQL[c["name"]]
        elif c.get("match") == "size":
            sql = f"strlen(body) >= {c['at_least']}"
        else:
            sql = f"({SQL['source_code']}) AND {O.domain('from_addr')} IN ({', '.join(map(O.q, c['and'][1]['domains']))})"
        parts.append(f"SELECT msg_id, {O.q(r['id'])} AS rule_id, {r['priority']} AS priority, {D.RANK[r['action']]} AS rank, {O.q(r['action'])} AS action FROM t WHERE {sql}")
    x = "m.body || ' 1234 5678 9018 7000012050002'"
    return f"{O.M}, t AS (SELECT msg_id, from_addr, subject || chr(10) || {x} AS body, {DIGITS.format('subject || ' + x)} AS ds FROM m), f AS ({' UNION ALL '.join(parts)})"


RULES = {d: _rules_sql(d) for d in ("outbound", "inbound")}


def findings(spark, sf_dir, direction):
    m = _messages(spark, sf_dir).select("msg_id", "subject", "body", "from_addr", F.array("from_addr").alias("to_addrs"), F.octet_length(F.concat_ws("\n", "subject", "body")).alias("size_bytes"), F.array().cast("array<string>").alias("mimes"))
    return D.evaluate_rules(m, D.DEFAULT_RULES, direction).select("msg_id", "rule_id", "action", "priority", "rank")


@query(f"WITH {_rules_sql('outbound')} SELECT rule_id, action, count(*) AS n FROM f GROUP BY ALL")
def d10_d12_rule_findings(spark, sf_dir):
    return findings(spark, sf_dir, "outbound").groupBy("rule_id", "action").agg(F.count("*").alias("n"))


@query(f"WITH {_rules_sql('outbound')} SELECT msg_id, max_by(action, rank) AS verdict, string_agg(rule_id, ',' ORDER BY priority, rule_id) AS rules FROM f GROUP BY msg_id")
def d11_verdicts(spark, sf_dir):
    return D.verdicts(findings(spark, sf_dir, "outbound"), "msg_id").select("msg_id", "verdict", "rules")


@query(
    f"""WITH {O.M}, x AS (SELECT msg_id, body AS c, instr(lower(body), 'invoice') AS p FROM m), y AS (SELECT *, CASE WHEN p > 0 THEN greatest(1, p - 30) ELSE 1 END AS s, CASE WHEN p > 0 THEN least(length(c), p + 49) ELSE least(length(c), 80) END AS e FROM x)
    SELECT msg_id, CASE WHEN length(c) <= 80 THEN c WHEN s = 1 THEN substr(c, s, e - s + 1) || '…' ELSE '…' || substr(c, s, e - s + 1) || '…' END AS excerpt FROM y"""
)
def d13_excerpts(spark, sf_dir):
    return messages(spark, sf_dir).select("msg_id", D.excerpt(F.col("body"), "invoice").alias("excerpt"))


@query(
    """WITH k AS (SELECT DISTINCT lower(token) AS token FROM (SELECT unnest(string_split_regex(text, '[\\s,;]+')) AS token FROM benchmark) WHERE strlen(token) >= 6),
    t AS (SELECT DISTINCT doc_id, lower(token) AS token FROM (SELECT doc_id, unnest(string_split_regex(text, '[\\s,;]+')) AS token FROM documents) WHERE strlen(token) >= 3)
    SELECT doc_id, count(*) AS matches FROM t JOIN k USING (token) GROUP BY doc_id HAVING count(*) >= 3"""
)
def d14_exact_data_match(spark, sf_dir):
    known = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[\s,;]+")).alias("token")).where(F.octet_length("token") >= 6)
    return D.data_matches(read(spark, sf_dir, "documents"), known, "doc_id", "text", "pepper", 3)


KNOWN = ["google.com", "microsoft.com", "company.example", "partners.example", "gmall.com"]
_MISDIRECTED = f"""{O.M}, k(domain) AS (VALUES {', '.join(f'({O.q(d)})' for d in KNOWN if d != 'company.example')}),
    r AS (SELECT msg_id, from_addr AS address, {O.domain('from_addr')} AS domain FROM m UNION ALL SELECT msg_id, reply_to, {O.domain('reply_to')} FROM m WHERE reply_to IS NOT NULL),
    p AS (SELECT msg_id, count(*) AS n, bool_or(domain = 'company.example') AS own, bool_and(domain = 'company.example' OR domain IN ({', '.join(map(O.q, lx.FREE_MAIL))})) AS closed FROM r GROUP BY msg_id),
    s AS (SELECT r.msg_id, address, r.domain, (SELECT min(k.domain) FROM k WHERE levenshtein(r.domain, k.domain) BETWEEN 1 AND 2) AS similar_to, n > 1 AND own AND closed AND r.domain IN ({', '.join(map(O.q, lx.FREE_MAIL))}) AS inside
      FROM r JOIN p USING (msg_id) WHERE r.domain <> 'company.example' AND r.domain NOT IN (SELECT domain FROM k)),
    bad AS (SELECT msg_id, address, CASE WHEN similar_to IS NOT NULL THEN 'lookalike' ELSE 'free_mail_inside' END AS reason, similar_to FROM s WHERE similar_to IS NOT NULL OR inside)"""


def _misdirected(spark, sf_dir):
    m = messages(spark, sf_dir)
    r = m.select("msg_id", F.explode(F.array_compact(F.array("from_addr", "reply_to"))).alias("address"))
    return D.misdirected(r, spark.createDataFrame([(d,) for d in KNOWN], "domain string"), "company.example")


@query(f"WITH {_MISDIRECTED} SELECT * FROM bad")
def d15_misdirected(spark, sf_dir):
    return _misdirected(spark, sf_dir)


@query(f"WITH {_MISDIRECTED}, {_rules_sql('outbound').removeprefix(O.M + ', ')}, v AS (SELECT msg_id, max_by(action, rank) AS verdict FROM f GROUP BY msg_id), b AS (SELECT msg_id, count(*) AS c FROM bad GROUP BY msg_id) SELECT msg_id, CASE WHEN c IS NOT NULL THEN 'block' ELSE verdict END AS verdict, coalesce(c, 0) AS n_recipients FROM v LEFT JOIN b USING (msg_id)")
def d16_escalation(spark, sf_dir):
    v = D.verdicts(findings(spark, sf_dir, "outbound"), "msg_id").select("msg_id", "verdict")
    return D.escalate(v, _misdirected(spark, sf_dir))


@query(f"WITH {_rules_sql('inbound')} SELECT msg_id, max_by(action, rank) AS verdict, min_by(rule_id, (-rank, priority, rule_id)) AS reported_rule FROM f GROUP BY msg_id")
def d17_envelope_scan(spark, sf_dir):
    return D.verdicts(findings(spark, sf_dir, "inbound"), "msg_id").select("msg_id", "verdict", "reported_rule")


@query("WITH d AS (SELECT DISTINCT split_part(url, '/', 3) AS h FROM pages UNION SELECT * FROM (VALUES ('microsoft.com'), ('rnicrosoft.com'), ('mcrosoft.com'), ('google.com'), ('gogle.com'))) SELECT a.h AS domain, b.h AS other, levenshtein(a.h, b.h) AS edits FROM d a, d b WHERE levenshtein(a.h, b.h) BETWEEN 1 AND 2")
def b18_edit_distance(spark, sf_dir):
    hosts = read(spark, sf_dir, "pages").select(F.element_at(F.split("url", "/"), 3).alias("domain"))
    d = hosts.union(spark.createDataFrame([(x,) for x in ("microsoft.com", "rnicrosoft.com", "mcrosoft.com", "google.com", "gogle.com")], "domain string")).distinct()
    return D.similar_domains(d, d, 2).select("domain", "other", F.levenshtein("domain", "other").alias("edits"))
