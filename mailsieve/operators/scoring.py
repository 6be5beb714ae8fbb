"""Signals of a message as a long table, escalation across signals, score and verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as T
from ..functions.matching import Hits, term_hits
from . import content as C
from . import history as H
from . import links as L
from .running import with_running

#: Codes whose labels count as high risk, and as thread signals, when signals escalate.
HIGH_RISK_CODES = ["first_contact_high_risk", "high_risk_pivot", "high_risk_topic"]
THREAD_CODES = ["unknown_parent", "domain_changed", "high_risk_topic"]
SCHEMA = ["msg_id", "family", "code", "contribution"]


Signal = tuple[str, str, Column, Column | float]


def signal_array(signals: list[Signal]) -> Column:
    """The signals (family, code, condition, contribution) of a message row that hold, as an array of structs."""
    made = [F.when(c, F.struct(F.lit(f).alias("family"), F.lit(k).alias("code"), (w if isinstance(w, Column) else F.lit(float(w))).cast("double").alias("contribution"))) for f, k, c, w in signals]
    return F.array_compact(F.array(*made))


def _explode(df: DataFrame, signals: list[Signal]) -> DataFrame:
    return df.select("msg_id", F.explode(signal_array(signals)).alias("s")).select("msg_id", "s.*")


def _auth(f: Column, n: Column) -> list[Signal]:
    """From the numbers of failed and of absent results."""
    return [
        ("auth", "auth_failed", f >= 2, 0.40), ("auth", "auth_part_failed", f == 1, 0.15), ("auth", "auth_absent", n == 3, 0.30), ("auth", "auth_mostly_absent", (n == 2) & (f == 0), 0.15),
        ("auth", "dmarc_reject", F.col("dmarc") == "reject", 0.20), ("auth", "chain_failed", F.col("arc").isin("fail", "reject"), 0.35), ("auth", "chain_passed", (F.col("arc") == "pass") & (f >= 1), -0.10),
    ]


def _auth_counts() -> tuple[Column, Column]:
    verdicts = [F.col(c) for c in ("spf", "dkim", "dmarc")]
    return tuple(reduce(lambda a, b: a + b, [F.coalesce(v.isin(*x), F.lit(False)).cast("int") for v in verdicts]) for x in (("fail", "reject"), ("none",)))


def auth_signals(m: DataFrame) -> DataFrame:
    f, n = _auth_counts()
    return _explode(m.withColumns({"__f": f, "__n": n}), _auth(F.col("__f"), F.col("__n")))


def domain_signals(m: DataFrame, ours: str, contacts: DataFrame) -> DataFrame:
    """Look-alike, IDN and return-path signals. Domains are few: each distinct one is judged once and joined back.
    ``contacts`` (domain): the domains of contacts."""
    m = m.withColumn("domain", T.address_domain(F.col("from_addr")))
    judged = L.lookalikes(m, ours, contacts).select("domain", F.col("resembles").alias("__like"), L.idn_risk(F.col("domain")).alias("__idn"))
    m = m.join(judged, "domain")
    rp = T.address_domain(F.col("return_path"))
    return _explode(m, [
        ("domain", "lookalike", F.col("__like").isNotNull(), 0.35), ("domain", "idn", F.col("__idn") > 0, F.greatest(F.col("__idn"), F.lit(0.15))), ("domain", "return_path", F.coalesce(rp != F.col("domain"), F.lit(False)), 0.10),
    ])


def link_signals(m: DataFrame) -> DataFrame:
    """A signal for every risky link up to the first dangerous one."""
    u = L.with_proxy_score(L.urls(m, "msg_id")).withColumn("verdict", L.proxy_verdict(F.col("score"))).where("verdict <> 'safe'")
    before = F.max((F.col("verdict") == "dangerous").cast("int")).over(Window.partitionBy("msg_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    u = u.withColumn("over", F.coalesce(before, F.lit(0))).where("over = 0")
    return u.select("msg_id", F.lit("domain").alias("family"), F.lit("proxy_link").alias("code"), F.when(F.col("verdict") == "dangerous", 0.70).otherwise(0.20).alias("contribution"))


def spoof_signals(spoof: DataFrame) -> DataFrame:
    return _explode(spoof, [("domain", "reply_to", F.col("mismatch"), F.least(F.lit(0.6), F.col("risk"))), ("domain", "impersonation", F.col("impersonation"), 0.30)])


def history_signals(m: DataFrame) -> DataFrame:
    """From columns is_first, subject_high_risk, drift, verified, reported (booleans; nulls are false)."""
    c = lambda k: F.coalesce(F.col(k), F.lit(False))
    return _explode(m, [
        ("history", "first_contact", c("is_first"), 0.05), ("history", "first_contact_high_risk", c("is_first") & c("subject_high_risk"), 0.12), ("history", "topic_drift", ~c("is_first") & c("drift"), 0.15),
        ("history", "verified", ~c("is_first") & c("verified"), -0.20), ("history", "reported", ~c("is_first") & c("reported"), 0.60),
    ])


THREAD_WEIGHTS = {"unknown_parent": 0.30, "reply_without_parent": 0.25, "domain_changed": 0.35, "language_shift": 0.20, "high_risk_topic": 0.25, "subject_changed": 0.15}


def thread_signals(t: DataFrame) -> DataFrame:
    return _explode(t, [("history", k, F.col(k), w) for k, w in THREAD_WEIGHTS.items()])


def content_signals(m: DataFrame) -> DataFrame:
    a, b = T.both_forms(F.col("body"))
    m, forms = m.withColumns({"__b1": a, "__b2": b}), [F.col("__b1"), F.col("__b2")]
    m = m.withColumn("__p", C.persuasion(F.col("body"), forms)).withColumns({f"__{k}": v for k, v in C.content_flags(F.col("body"), forms).items()})
    return _explode(m, [
        ("content", "money_urgency", F.col("__money_urgency"), 0.25), ("content", "route_change", F.col("__route_change"), 0.30), ("content", "channel_move", F.col("__channel_move"), 0.35),
        ("content", "persuasion", F.col("__p") >= 2, F.least(F.lit(0.40), 0.1 * F.col("__p"))),
    ])


def pivot_signals(m: DataFrame) -> DataFrame:
    """One signal a message that leads to a messenger, a wallet or a pressed phone call."""
    risky = {h: k for h, k in lx.MEETING_HOSTS.items() if k in ("whatsapp", "telegram", "signal")}
    ids = C.links_by_host(m, "msg_id", risky).select("msg_id").union(C.wallets(m, "msg_id").select("msg_id")).union(C.phones(m, "msg_id").where("high_risk").select("msg_id")).distinct()
    return ids.select("msg_id", F.lit("content").alias("family"), F.lit("high_risk_pivot").alias("code"), F.lit(0.35).alias("contribution"))


def account_signals(changes: DataFrame) -> DataFrame:
    return _explode(changes.where("risk > 0"), [("content", "account_change", F.lit(True), F.least(F.lit(0.6), 0.6 * F.col("risk")))])


def injection_signals(screened: DataFrame, probability: Column | None = None) -> DataFrame:
    """0.45 where the screen blocks; else the supplied model's probability times 0.45 (0 without one)."""
    blocked = F.col("verdict") == "blocked"
    return _explode(screened, [("content", "prompt_injection", blocked, 0.45), ("model", "model", ~blocked, 0.45 * F.coalesce(probability if probability is not None else F.lit(0.0), F.lit(0.0)))])


def _signature(domain: Column) -> list[Signal]:
    aligned = (F.col("d") == domain) | F.endswith(domain, F.concat(F.lit("."), F.col("d"))) | F.endswith(F.col("d"), F.concat(F.lit("."), domain))
    return [
        ("auth", "length_tag", F.col("has_length"), 0.35), ("auth", "misaligned", F.coalesce(~aligned, F.lit(False)), F.when(F.col("dkim") == "pass", 0.40).otherwise(0.20)), ("auth", "replay", F.col("seen") >= 2, 0.30),
        ("auth", "crypto_failed", F.col("dkim_crypto") == "fail", 0.45), ("auth", "crypto_passed", F.col("dkim_crypto") == "pass", -0.10),
    ]


def signature_signals(m: DataFrame) -> DataFrame:
    """From columns d, b32, has_length, seen, dkim, dkim_crypto (null, pass or fail) and from_addr."""
    return _explode(m, _signature(T.address_domain(F.col("from_addr"))))


def _escalated(has) -> list[Signal]:
    """Extra signals for combinations; ``has`` asks whether a message has a signal that a condition on (family, code, contribution) holds for."""
    auth, domain, content = has(lambda f, k, w: (f == "auth") & (w > 0)), has(lambda f, k, w: f == "domain"), has(lambda f, k, w: f == "content")
    first, high, thread = (has(lambda f, k, w, codes=codes: k.isin(codes)) for codes in (["first_contact", "first_contact_high_risk"], HIGH_RISK_CODES, THREAD_CODES))
    return [("auth", "auth_domain_content", auth & domain & content, 0.20), ("history", "first_auth_high_risk", first & auth & high, 0.15), ("domain", "domain_thread", domain & thread, 0.15)]


def escalations(signals: DataFrame) -> DataFrame:
    """Extra signals for combinations, of signals as a long table; one aggregate a message, combined on the map side."""
    asked: list[Column] = []

    def has(test):
        asked.append(F.bool_or(test(F.col("family"), F.col("code"), F.col("contribution"))).alias(f"f{len(asked)}"))
        return F.col(f"f{len(asked) - 1}")

    made = _escalated(has)
    return _explode(signals.groupBy("msg_id").agg(*asked), made)


# --- Messages with all their signals ----------------------------------------------------------------------
PHRASES = lx.URGENCY + lx.MONEY + lx.ROUTE_CHANGE + lx.CHANNEL_MIGRATION + [p for terms in lx.PERSUASION.values() for p in terms]
RISKY_HOSTS = [h for h, k in lx.MEETING_HOSTS.items() if k in ("whatsapp", "telegram", "signal")]
BODY_TERMS = PHRASES + C.SCREENED + H.THREAD_KEYWORDS + H.ACCOUNT_KEYWORDS + RISKY_HOSTS


def _links(body: Column) -> Column:
    """The contributions of a body's risky links, up to the first dangerous one."""
    words = F.regexp_extract_all(body, F.lit(r"(?:^|\s)(https?://\S*)"), 1)
    low = F.transform(words, lambda w: F.lower(F.regexp_replace(F.rtrim(w, F.lit(".,)]!?;")), r"\p{Cntrl}", "")))
    points = F.transform(low, lambda u: L.proxy_points(u, L.proxy_host(u)))
    none = F.struct(F.lit(False).alias("done"), F.array().cast("array<double>").alias("risky"))
    step = lambda a, p: F.when(a["done"] | (p < 20), a).otherwise(F.struct((p >= 50).alias("done"), F.concat(a["risky"], F.array(F.when(p >= 50, 0.70).otherwise(0.20))).alias("risky")))
    return F.when(F.contains(body, F.lit("http")), F.aggregate(points, none, step, lambda a: a["risky"]))


def message_facts(m: DataFrame, ours: str) -> DataFrame:
    """What one message says by itself, a narrow row a message: its text is read here, once, and goes no further.

    ``m``: msg_id, thread_id, sender, ts, from_addr, reply_to, return_path, subject, body, message_id, in_reply_to, spf, dkim,
    dmarc, arc, dkim_header and, if there are any, language, dkim_crypto and model_probability.
    """
    for c, kind in (("dkim_crypto", "string"), ("model_probability", "double")):
        m = m if c in m.columns else m.withColumn(c, F.lit(None).cast(kind))
    body, subject = F.col("body"), F.col("subject")
    forms = C.screened_forms(body) | dict(zip(("b1", "b2"), T.both_forms(body), strict=True)) | {"low": F.lower(body), "raw": body}
    at = {k: i for i, k in enumerate(forms)}
    m = m.withColumns({"__hits": term_hits(list(forms.values()), BODY_TERMS), "__topics": term_hits(T.both_forms(subject), lx.HIGH_RISK_SUBJECTS)})
    hits = {k: Hits("__hits", BODY_TERMS, [at[x] for x in k.split("+")]) for k in ("n", "n+s", "bn+bs", "b64", "ent", "eb64", "b1", "b2", "b1+b2", "low", "raw")}
    plain, f_n = hits["b1+b2"], _auth_counts()
    domain = T.address_domain(F.col("from_addr"))
    persuasion = F.greatest(*(reduce(lambda a, b: a + b, [hits[f].any_of(terms).cast("int") for terms in lx.PERSUASION.values()]) for f in ("b1", "b2")))
    facts = {
        "domain": domain, "name": H.folded_name(F.col("from_addr")), "language": H.language_of(m), "is_reply": F.rlike(F.lower(subject), F.lit("^re[:：]")), "fails": f_n[0], "nones": f_n[1],
        "lookalike": L.lookalike(domain, ours).isNotNull(), "idn": L.idn_risk(domain), "return_mismatch": F.coalesce(T.address_domain(F.col("return_path")) != domain, F.lit(False)), "mismatch": H.reply_mismatch(F.col("reply_to"), domain),
        "money_urgency": plain.any_of(lx.URGENCY) & plain.any_of(lx.MONEY), "route_change": plain.any_of(lx.ROUTE_CHANGE), "channel_move": plain.any_of(lx.CHANNEL_MIGRATION), "persuasion": persuasion,
        "blocked": F.size(C.screen_risks(body, hits)) > 0, "pivot": C.leads_to(body, RISKY_HOSTS, hits["raw"].any_of(RISKY_HOSTS)) | C.has_wallet(body) | C.pressed_phone(body),
        "topic_words": hits["low"].any_of(H.THREAD_KEYWORDS), "keyword": hits["low"].any_of(H.ACCOUNT_KEYWORDS), "now": H.accounts(body), "links": _links(body), "subject_risk": Hits("__topics", lx.HIGH_RISK_SUBJECTS, [0, 1]).any_of(lx.HIGH_RISK_SUBJECTS),
    }
    tags = H.signature_tags(F.col("dkim_header"))
    kept = ["msg_id", "thread_id", "sender", "ts", "subject", "message_id", "in_reply_to", "reply_to", "dkim", "dmarc", "arc", "dkim_crypto", "model_probability"]
    return m.select(*kept, *(c.alias(k) for k, c in facts.items()), *(tags[k].alias(k) for k in ("d", "b32", "has_length")))


def _pairs(a: Column, b: Column) -> Column:
    """How many pairs of places of two token arrays hold the same token: the dot product of their term frequencies."""
    return F.aggregate(a, F.lit(0), lambda n, x: n + F.size(F.filter(b, lambda y: y == x)))


def with_context(facts: DataFrame, m: DataFrame, known: DataFrame, contacts: DataFrame | None = None, profiles: DataFrame | None = None, archive: DataFrame | None = None) -> DataFrame:
    """Adds what other messages say of one: running scans of narrow rows, by sender, by thread and by signature.

    ``m`` gives all message ids and sender names, ``known`` the contacts by name (name, domain), ``contacts`` the domains of
    contacts (domain), ``profiles`` what is set by hand (sender, verified, reported) and ``archive`` the ids (message_id) that the
    mailbox holds beside ``m``.
    """
    # totals need few facts: they are taken anew, and the plan of all facts stands once in that of the whole
    few = m.select("msg_id", "thread_id", "sender", "ts", "subject", T.address_domain(F.col("from_addr")).alias("domain"), H.language_of(m).alias("language"), H.accounts(F.col("body")).alias("now"), *(c.alias(k) for k, c in H.signature_tags(F.col("dkim_header")).items()))
    threads = H.thread_scans("language", H.with_new_accounts(few, few), {H.PAST[0]: F.col(H.PAST[1])})
    x = with_running(H.with_new_accounts(facts, few), "ts", "msg_id", H.topic_scan("sender", "subject", few), *threads, H.replay_scan(few))
    a, b = H.tokens(F.col("subject")), H.tokens(F.col("typical"))
    x = x.withColumns({"__a": F.when(F.col("n") >= 5, a), "__b": F.when(F.col("n") >= 5, b)})
    similar = _pairs(F.col("__a"), F.col("__b")) / F.sqrt((_pairs(F.col("__a"), F.col("__a")) * _pairs(F.col("__b"), F.col("__b"))).cast("double"))
    drift = F.when((F.size("__a") > 0) & (F.size("__b") > 0), similar < 0.15)
    x = x.withColumns({"is_first": F.col("n") == 0, "drift": F.coalesce(drift, F.lit(False))}).drop("__a", "__b", "n", "typical")
    x = x.join(H.known_ids(m, archive), F.lower(F.trim("in_reply_to")) == F.col("__known"), "left")
    names = m.select(H.folded_name(F.col("from_addr")).alias("__name"), T.address_domain(F.col("from_addr")).alias("__domain"))
    hit = H.impersonators(names, known).withColumn("impersonation", F.lit(True))
    x = x.join(hit, (F.col("name") == F.col("__name")) & (F.col("domain") == F.col("__domain")), "left").drop("__name", "__domain").withColumn("impersonation", F.coalesce("impersonation", F.lit(False)))
    if contacts is not None:
        near = L.one_edit(names.select(F.col("__domain").alias("x")), contacts.select(F.lower("domain").alias("x"))).select(F.col("a").alias("__near")).distinct()
        x = x.join(near, F.col("domain") == F.col("__near"), "left").withColumn("lookalike", F.coalesce("lookalike", F.lit(False)) | F.col("__near").isNotNull()).drop("__near")
    if profiles is None:
        x = x.withColumns({"verified": F.lit(False), "reported": F.lit(False)})
    else:
        x = x.join(profiles.groupBy("sender").agg(F.bool_or("verified").alias("verified"), F.bool_or("reported").alias("reported")), "sender", "left")
    x = H.counted_replays(x)
    parent = F.trim(F.coalesce("in_reply_to", F.lit(""))) != ""
    unlike = T.word_similarity(T.strip_reply(F.col("subject")), T.strip_reply(F.col("__prior_subject"))) < 0.30
    thread = {
        "unknown_parent": parent & F.col("__known").isNull(), "reply_without_parent": F.col("is_reply") & F.col("in_reply_to").isNull(), "domain_changed": F.col("domain").isNotNull() & (F.col("__with_domain") > 0) & (F.col("__of_domain") == 0),
        "language_shift": (F.col("__prior_lang") != F.col("language")) & (F.col("language") != "other"), "high_risk_topic": (F.col("is_reply") | F.col("in_reply_to").isNotNull()) & F.col("topic_words"),
        "subject_changed": F.col("is_reply") & F.col("__prior_subject").isNotNull() & unlike,
    }
    return H.account_counts(x.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in thread.items()}))


def assessed(x: DataFrame) -> DataFrame:
    """msg_id, signals, raw, score, verdict of every message, from facts with context; one narrow pass over flags."""
    c, no = F.col, F.lit(False)
    spoof = H.spoof_risk(c("reply_to"), c("mismatch"), c("impersonation"))
    account = H.account_risk()
    made: list[Signal] = [
        *_auth(c("fails"), c("nones")), *_signature(c("domain")),
        ("domain", "lookalike", c("lookalike"), 0.35), ("domain", "idn", c("idn") > 0, F.greatest(c("idn"), F.lit(0.15))), ("domain", "return_path", c("return_mismatch"), 0.10),
        ("domain", "reply_to", c("mismatch"), F.least(F.lit(0.6), spoof)), ("domain", "impersonation", c("impersonation"), 0.30),
        ("history", "first_contact", c("is_first"), 0.05), ("history", "first_contact_high_risk", c("is_first") & F.coalesce(c("subject_risk"), no), 0.12), ("history", "topic_drift", ~c("is_first") & c("drift"), 0.15),
        ("history", "verified", ~c("is_first") & F.coalesce(c("verified"), no), -0.20), ("history", "reported", ~c("is_first") & F.coalesce(c("reported"), no), 0.60),
        *(("history", k, c(k), w) for k, w in THREAD_WEIGHTS.items()),
        ("content", "money_urgency", c("money_urgency"), 0.25), ("content", "route_change", c("route_change"), 0.30), ("content", "channel_move", c("channel_move"), 0.35), ("content", "persuasion", c("persuasion") >= 2, F.least(F.lit(0.40), 0.1 * c("persuasion"))),
        ("content", "high_risk_pivot", c("pivot"), 0.35), ("content", "account_change", account > 0, F.least(F.lit(0.6), 0.6 * account)),
        ("content", "prompt_injection", c("blocked"), 0.45), ("model", "model", ~c("blocked") & c("model_probability").isNotNull(), 0.45 * c("model_probability")),
    ]
    link = F.transform(F.coalesce("links", F.array().cast("array<double>")), lambda w: F.struct(F.lit("domain").alias("family"), F.lit("proxy_link").alias("code"), w.cast("double").alias("contribution")))
    x = x.select("msg_id", F.concat(signal_array(made), link).alias("__base"))
    more = _escalated(lambda test: F.exists("__base", lambda s: test(s["family"], s["code"], s["contribution"])))
    x = x.select("msg_id", F.concat("__base", signal_array(more)).alias("signals"))
    return scored(x.withColumn("raw", F.aggregate("signals", F.lit(0.0), lambda a, s: a + s["contribution"])))


def ranked_signals(messages: DataFrame) -> DataFrame:
    """msg_id, family, code, contribution, rank of assessed messages: sorted inside each row, without a shuffle."""
    order = F.array_sort(F.transform("signals", lambda s: F.struct((-s["contribution"]).alias("less"), s["family"].alias("family"), s["code"].alias("code"))))
    return messages.select("msg_id", F.posexplode(order).alias("at", "s")).select("msg_id", "s.family", "s.code", (-F.col("s.less")).alias("contribution"), (F.col("at") + 1).alias("rank"))


def scored(x: DataFrame) -> DataFrame:
    """Adds score, the logistic of 5 (raw - 0.7), and verdict."""
    x = x.withColumn("score", 1 / (1 + F.exp(-5 * (F.col("raw") - 0.7))))
    return x.withColumn("verdict", F.when(F.col("score") >= 0.85, "dangerous").when(F.col("score") >= 0.60, "suspicious").when(F.col("score") >= 0.30, "advisory").otherwise("safe"))


def verdicts(messages: DataFrame, signals: DataFrame) -> DataFrame:
    """msg_id, raw, score, verdict of every message, of signals as a long table; without signals the sum is 0."""
    raw = signals.groupBy("msg_id").agg(F.sum("contribution").alias("raw"))
    return scored(messages.select("msg_id").join(raw, "msg_id", "left").withColumn("raw", F.coalesce("raw", F.lit(0.0))))
