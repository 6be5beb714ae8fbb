"""Queries over signals and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as T
from ..operators import content as C
from ..operators import history as H
from ..operators import scoring as S
from . import oracle as O
from .catalog import query
from . import q_dlp as QD
from . import q_history as QH
from . import q_pages as QP
from .q_content import WALLETS, host_sql
from .q_history import SIG, _signed
from .q_links import CONTACTS, U, _score, contacts
from .views import messages

_F = "(spf IN ('fail', 'reject'))::INT + (dkim IN ('fail', 'reject'))::INT + (dmarc IN ('fail', 'reject'))::INT"
_N = "(spf = 'none')::INT + (dkim = 'none')::INT + (dmarc = 'none')::INT"


def _rows(source: str, signals: list[tuple[str, str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT msg_id, '{f}' AS family, '{k}' AS code, CAST({w} AS DOUBLE) AS contribution FROM {source} WHERE {c}" for f, k, c, w in signals)


AUTH = _rows(f"(SELECT *, {_F} AS f, {_N} AS n FROM m)", [("auth", "auth_failed", "f >= 2", "0.40"), ("auth", "auth_part_failed", "f = 1", "0.15"), ("auth", "auth_absent", "n = 3", "0.30"), ("auth", "auth_mostly_absent", "n = 2 AND f = 0", "0.15"), ("auth", "dmarc_reject", "dmarc = 'reject'", "0.20"), ("auth", "chain_failed", "arc = 'fail'", "0.35"), ("auth", "chain_passed", "arc = 'pass' AND f >= 1", "-0.10")])
_LIKE = "coalesce(" + ", ".join(["CASE WHEN levenshtein(domain, 'company.example') = 1 THEN 1 END"] + [f"CASE WHEN levenshtein(domain, {O.q(w)}) BETWEEN 1 AND 2 THEN 1 END" for w in lx.WATCHED_DOMAINS] + [f"CASE WHEN levenshtein(domain, {O.q(c)}) = 1 THEN 1 END" for c in CONTACTS]) + ")"
DOMAIN = _rows(f"(SELECT *, {O.domain('from_addr')} AS domain FROM m)", [("domain", "lookalike", f"{_LIKE} IS NOT NULL", "0.35"), ("domain", "idn", "starts_with(domain, 'xn--')", "0.4"), ("domain", "return_path", f"coalesce({O.domain('return_path')} <> domain, false)", "0.10")])
B = ["b1", "b2"]
_P = f"greatest({', '.join(' + '.join(f'CAST({O.any_of(b, t)} AS INT)' for t in lx.PERSUASION.values()) for b in B)})"
CONTENT = _rows(f"(SELECT *, {_P} AS p FROM n)", [("content", "money_urgency", f"{O.any_of(B, lx.URGENCY)} AND {O.any_of(B, lx.MONEY)}", "0.25"), ("content", "route_change", O.any_of(B, lx.ROUTE_CHANGE), "0.30"), ("content", "channel_move", O.any_of(B, lx.CHANNEL_MIGRATION), "0.35"), ("content", "persuasion", "p >= 2", "least(0.40::DOUBLE, 0.1::DOUBLE * p)")])
LINK = f"SELECT msg_id, 'domain' AS family, 'proxy_link' AS code, CASE WHEN v = 'dangerous' THEN 0.70::DOUBLE ELSE 0.20::DOUBLE END AS contribution FROM (SELECT *, coalesce(max((v = 'dangerous')::INT) OVER (PARTITION BY msg_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM (SELECT msg_id, pos, CASE WHEN {_score()} >= 50 THEN 'dangerous' WHEN {_score()} >= 20 THEN 'caution' ELSE 'safe' END AS v FROM u) WHERE v <> 'safe') WHERE o = 0"
FIRST = f"SELECT msg_id, 'history' AS family, 'first_contact' AS code, 0.05::DOUBLE AS contribution FROM fc UNION ALL SELECT msg_id, 'history', 'first_contact_high_risk', 0.12::DOUBLE FROM fc WHERE {O.any_of(['s1', 's2'], lx.HIGH_RISK_SUBJECTS)}"
PRESSED = f"""WITH {O.M}, l AS (SELECT msg_id, ls, unnest(generate_series(1, len(ls))) AS i FROM (SELECT msg_id, string_split(body, chr(10)) AS ls FROM m))
    SELECT msg_id FROM l WHERE len(list_filter(regexp_extract_all(ls[i], '[0-9+() -]+'), lambda r: length(regexp_replace(r, '[^0-9]', '', 'g')) BETWEEN 10 AND 15)) > 0 AND {O.any_of("lower(concat_ws(' ', CASE WHEN i > 1 THEN ls[i - 1] END, ls[i], ls[i + 1]))", C.HASTE)}"""
PIVOT = f"""SELECT DISTINCT msg_id, 'content' AS family, 'high_risk_pivot' AS code, 0.35::DOUBLE AS contribution FROM (SELECT msg_id FROM ({host_sql({h: 'risky' for h in S.RISKY_HOSTS})}) UNION ALL SELECT msg_id FROM ({WALLETS}) UNION ALL SELECT msg_id FROM ({PRESSED}))"""
ACCOUNT = f"SELECT msg_id, 'content' AS family, 'account_change' AS code, least(0.6::DOUBLE, 0.6::DOUBLE * risk) AS contribution FROM ({QH.ACCOUNT}) WHERE risk > 0"
SPOOF = _rows(f"({QH.SPOOF})", [("domain", "reply_to", "mismatch", "least(0.6::DOUBLE, risk)"), ("domain", "impersonation", "impersonation", "0.30")])
PROFILE = _rows("(SELECT * FROM m WHERE msg_id NOT IN (SELECT msg_id FROM fc))", [("history", "verified", "from_addr LIKE '%@company.example'", "-0.20"), ("history", "reported", "from_addr LIKE '%@g00gle.com'", "0.60")])
CRYPTO = _rows("m", [("auth", "crypto_failed", "msg_id % 7 = 1", "0.45"), ("auth", "crypto_passed", "msg_id % 7 = 2", "-0.10")])
THREAD = _rows(f"({QH.THREAD})", [("history", k, c, f"{w}") for (k, w), c in zip(S.THREAD_WEIGHTS.items(), "abclhs", strict=True)])
DRIFT = _rows(f"({QH.DRIFT})", [("history", "topic_drift", "drift", "0.15")])
_PH = [p.lower() for p in lx.OVERRIDE_PHRASES]
BLOCKED = f"""WITH {O.M}, n AS (SELECT msg_id, {O.norm('body', True)} AS b1, {O.spaced('body', True)} AS b2 FROM m) SELECT msg_id, {O.any_of(B, _PH)} OR {O.any_of('b1', [t.lower() for t in lx.SPECIAL_TOKENS])} AS blocked FROM n"""
INJECTION = f"SELECT msg_id, 'content' AS family, 'prompt_injection' AS code, 0.45::DOUBLE AS contribution FROM ({BLOCKED}) WHERE blocked"
SIGNATURE = f"""SELECT * FROM (WITH {SIG}, r AS (SELECT s.*, m.dkim, split_part(from_addr, '@', 2) AS fd, count(*) OVER (PARTITION BY d, b32 ORDER BY s.ts_s, s.msg_id) AS seen FROM s JOIN m USING (msg_id))
    {_rows('r', [('auth', 'length_tag', 'has_length', '0.35'), ('auth', 'misaligned', "d <> fd AND NOT ends_with(fd, '.' || d) AND NOT ends_with(d, '.' || fd)", "CASE WHEN dkim = 'pass' THEN 0.40 ELSE 0.20 END"), ('auth', 'replay', 'seen >= 2', '0.30')])})"""
MODEL = f"SELECT msg_id, 'model' AS family, 'model' AS code, 0.45::DOUBLE * (msg_id % 10) / 10 AS contribution FROM ({BLOCKED}) WHERE NOT blocked"
BASE = [AUTH, DOMAIN, CONTENT, LINK, FIRST, PIVOT, ACCOUNT, SPOOF, THREAD, DRIFT, INJECTION, SIGNATURE]
ALL = lambda base: f"""{O.normed()}, {U.removeprefix(O.M + ', ')}, fc AS (SELECT * FROM n WHERE msg_id IN (SELECT min(msg_id) FROM m GROUP BY from_addr)),
    base AS ({' UNION ALL '.join(base)})"""  # noqa: E731
_ANY = lambda codes: "code IN (" + ", ".join(map(O.q, codes)) + ")"
_escalated = lambda base: f"""{ALL(base)}, fl AS (SELECT msg_id, bool_or(family = 'auth' AND contribution > 0) AS a, bool_or(family = 'domain') AS d, bool_or(family = 'content') AS c, bool_or({_ANY(['first_contact', 'first_contact_high_risk'])}) AS f, bool_or({_ANY(S.HIGH_RISK_CODES)}) AS h, bool_or({_ANY(S.THREAD_CODES)}) AS t FROM base GROUP BY msg_id),
    esc AS ({_rows('fl', [('auth', 'auth_domain_content', 'a AND d AND c', '0.20'), ('history', 'first_auth_high_risk', 'f AND a AND h', '0.15'), ('domain', 'domain_thread', 'd AND t', '0.15')])}), every AS (SELECT * FROM base UNION ALL SELECT * FROM esc)"""  # noqa: E731
ESC = _escalated(BASE)
_judged = lambda esc: f"{esc}, sc AS (SELECT m.msg_id, 1 / (1 + exp(-5 * (coalesce(sum(contribution), 0) - 0.7::DOUBLE))) AS score FROM m LEFT JOIN every e ON e.msg_id = m.msg_id GROUP BY m.msg_id), v AS (SELECT msg_id, score, CASE WHEN score >= 0.85 THEN 'dangerous' WHEN score >= 0.60 THEN 'suspicious' WHEN score >= 0.30 THEN 'advisory' ELSE 'safe' END AS verdict FROM sc)"
VERDICT = _judged(ESC)


def mail(spark, sf_dir):
    """The message view as the assessment takes it: senders with display names, ids and parents of threads."""
    return messages(spark, sf_dir).withColumns({"sender": F.col("from_addr"), "from_addr": F.expr(QH.NAMED)} | QH.replies())


def _profiles(spark, sf_dir):
    """What users have said of senders: verified and reported ones."""
    sender = F.col("from_addr")
    return messages(spark, sf_dir).select(sender.alias("sender")).distinct().select("sender", F.endswith("sender", F.lit("@company.example")).alias("verified"), F.endswith("sender", F.lit("@g00gle.com")).alias("reported"))


def _crypto():
    return F.when(F.col("msg_id") % 7 == 1, "fail").when(F.col("msg_id") % 7 == 2, "pass")


def assessed(spark, sf_dir, supplied=False):
    """All messages, with their signals; ``supplied``: also what others supply, namely profiles, signature checks and a model."""
    m = mail(spark, sf_dir)
    if supplied:
        m = m.withColumns({"dkim_crypto": _crypto(), "model_probability": F.col("msg_id") % 10 / 10})
    known = spark.createDataFrame(QH.CONTACTS, "name string, domain string")
    return S.assessed(S.with_context(S.message_facts(m, "company.example"), m, known, contacts(spark), _profiles(spark, sf_dir) if supplied else None, QH.archive(m)))


@query(f"WITH {O.M} {AUTH}")
def h1_auth_signals(spark, sf_dir):
    return S.auth_signals(messages(spark, sf_dir))


@query(f"WITH {U} {DOMAIN} UNION ALL {LINK} UNION ALL {SPOOF}")
def h2_domain_signals(spark, sf_dir):
    m = mail(spark, sf_dir)
    spoof = H.reply_spoof(m, spark.createDataFrame(QH.CONTACTS, "name string, domain string"))
    return S.domain_signals(m, "company.example", contacts(spark)).unionByName(S.link_signals(m)).unionByName(S.spoof_signals(spoof))


@query(f"WITH {O.normed()}, fc AS (SELECT * FROM n WHERE msg_id IN (SELECT min(msg_id) FROM m GROUP BY from_addr)) {FIRST} UNION ALL {THREAD} UNION ALL {DRIFT} UNION ALL {PROFILE}")
def h3_history_signals(spark, sf_dir):
    m = mail(spark, sf_dir)
    first = H.first_contacts(m, "sender", ["ts_s", "msg_id"]).select("msg_id", F.lit(True).alias("is_first"), F.col("high_risk").alias("subject_high_risk"), F.lit(False).alias("drift"))
    drift = QH.g3_topic_drift(spark, sf_dir).where("drift").select("msg_id", F.lit(False).alias("is_first"), F.lit(False).alias("subject_high_risk"), "drift")
    flags = first.unionByName(drift).withColumns({"verified": F.lit(False), "reported": F.lit(False)})
    known = m.join(first.select("msg_id"), "msg_id", "left_anti").join(_profiles(spark, sf_dir), "sender")
    flags = flags.unionByName(known.select("msg_id", *(F.lit(False).alias(c) for c in ("is_first", "subject_high_risk", "drift")), "verified", "reported"))
    return S.history_signals(flags).unionByName(S.thread_signals(H.thread_hijack(m.withColumn("domain", T.address_domain(F.col("from_addr"))), QH.archive(m))))


@query(f"WITH {O.normed()} {CONTENT}")
def h4_content_signals(spark, sf_dir):
    return S.content_signals(messages(spark, sf_dir))


@query(f"{PIVOT} UNION ALL {ACCOUNT}")
def h4_pivot_and_account_signals(spark, sf_dir):
    m = messages(spark, sf_dir)
    return S.pivot_signals(m).unionByName(S.account_signals(H.account_changes(m.withColumn("ts", F.col("ts_s")))))


@query(f"{SIGNATURE} UNION ALL SELECT * FROM (WITH {O.M} {CRYPTO})")
def h5_signature_signals(spark, sf_dir):
    m = H.signature_replays(_signed(spark, sf_dir).withColumn("ts", F.col("ts_s"))).withColumn("dkim_crypto", _crypto())
    return S.signature_signals(m)


@query(f"SELECT msg_id, CASE WHEN blocked THEN 'content' ELSE 'model' END AS family, CASE WHEN blocked THEN 'prompt_injection' ELSE 'model' END AS code, CASE WHEN blocked THEN 0.45::DOUBLE ELSE 0.45::DOUBLE * (msg_id % 10) / 10 END AS contribution FROM ({BLOCKED})")
def h6_model_signals(spark, sf_dir):
    return S.injection_signals(C.screen(messages(spark, sf_dir)), F.col("msg_id") % 10 / 10)


_ESCALATED = ["auth_domain_content", "first_auth_high_risk", "domain_thread"]


@query(f"WITH {ESC} SELECT * FROM esc")
def h7_escalations(spark, sf_dir):
    return assessed(spark, sf_dir).select("msg_id", F.explode("signals").alias("s")).select("msg_id", "s.*").where(F.col("code").isin(_ESCALATED))


@query(f"WITH {VERDICT} SELECT verdict, count(*) AS n, round(avg(score), 6) AS mean_score FROM v GROUP BY verdict")
def h8_verdicts(spark, sf_dir):
    return assessed(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"WITH {_judged(_escalated([*BASE, PROFILE, CRYPTO, MODEL]))} SELECT msg_id, round(score, 6) AS score, verdict FROM v")
def h8_verdicts_with_supplied_facts(spark, sf_dir):
    return assessed(spark, sf_dir, supplied=True).select("msg_id", F.round("score", 6).alias("score"), "verdict")


@query(f"WITH {ESC} SELECT msg_id, code, CAST(row_number() OVER (PARTITION BY msg_id ORDER BY contribution DESC, family, code) AS INT) AS rank FROM every")
def h9_ranked_signals(spark, sf_dir):
    return S.ranked_signals(assessed(spark, sf_dir)).select("msg_id", "code", "rank")


_FOUND = f"SELECT DISTINCT msg_id FROM (WITH {QD.RULES['outbound']} SELECT msg_id FROM f)"
_ALERTS = f"SELECT count(*) FROM (WITH {QH.CAMPAIGNS} SELECT group_key FROM g WHERE n >= 3)"


@query(f"WITH {VERDICT} SELECT verdict, count(*) AS n, round(avg(score), 6) AS mean_score, sum((spf = 'fail')::INT)::BIGINT AS n_spf_failed, count(x.msg_id) AS n_sensitive, coalesce(sum(n_risks), 0)::BIGINT AS n_attachment_risks, ({_ALERTS}) AS n_campaigns FROM v JOIN m USING (msg_id) LEFT JOIN ({_FOUND}) x ON x.msg_id = m.msg_id LEFT JOIN ({QP.SCANNED}) r ON r.msg_id = m.msg_id GROUP BY verdict")
def i10_scan_summary(spark, sf_dir):
    sensitive = QD.findings(spark, sf_dir, "outbound").select("msg_id").distinct().withColumn("sensitive", F.lit(True))
    rows = assessed(spark, sf_dir).join(messages(spark, sf_dir).select("msg_id", "spf"), "msg_id").join(sensitive, "msg_id", "left").join(QP.f9_f15_attachment_scan(spark, sf_dir), "msg_id", "left")
    per = rows.groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.col("spf") == "fail").alias("n_spf_failed"), F.count("sensitive").alias("n_sensitive"), F.coalesce(F.sum("n_risks"), F.lit(0)).alias("n_attachment_risks"))
    return per.join(F.broadcast(QH.g11_alertable_groups(spark, sf_dir).agg(F.count("*").alias("n_campaigns"))))  # one row
