"""Sensitive-data detectors and rules, as Column expressions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as T
from .rule_table import FALSE, RuleTable, rules_that_hold

# Patterns of numbers and names.
CARD = r"(4[0-9]{3}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|5[1-5][0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|35[0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|6(?:011|5[0-9]{2})[-\s]?[0-9]{4}[-\s]?[0-9]{4}[-\s]?[0-9]{4}|3[47][0-9]{2}[-\s]?[0-9]{6}[-\s]?[0-9]{5})"
IBAN = r"(\b[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}\b)"
BIC = r"(\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b)"
SSN = r"(\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b)"
IPV4 = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
CODENAME = r"(?i)(?:project|operation|プロジェクト)\s+[A-Z][A-Z0-9]{2,}"


def _digits(c: Column) -> Column:
    return F.regexp_replace(T.fold_digits(c), "[^0-9]+", "")


def _windows(digits: Column, width: int, test) -> Column:
    """Whether any window of ``width`` digits passes; ``test`` gets a function from place (0-based) to digit.

    Digits are split once into an array, so a window costs the same wherever it lies.
    """
    def within(d: Column) -> Column:
        return F.exists(F.sequence(F.lit(0), F.size(d) - width), lambda i: test(lambda k: F.get(d, i + k)))

    numbers = F.when(F.length(digits) >= width, F.array(F.split(digits, "").cast("array<int>")))
    return F.when(digits.isNotNull(), F.coalesce(F.exists(numbers, within), F.lit(False)))  # the array of one binds the digits


def personal_number(c: Column) -> Column:
    """Japanese personal number: 12 digits among all digits of the text joined, check digit modulo 11."""

    def valid(d):
        p = reduce(lambda a, b: a + b, [d(10 - k) * w for k, w in enumerate((2, 3, 4, 5, 6, 7, 2, 3, 4, 5, 6))]) % 11
        return d(11) == F.when(p < 2, 0).otherwise(11 - p)

    return _windows(_digits(c), 12, valid)


def corporate_number(c: Column) -> Column:
    """Japanese corporate number: 13 digits, the first not 0 and equal to 9 - (weighted sum modulo 9)."""

    def valid(d):
        s = reduce(lambda a, b: a + b, [d(12 - k) * (1 if k % 2 == 0 else 2) for k in range(12)])
        return (d(0) != 0) & (d(0) == 9 - s % 9)

    return _windows(_digits(c), 13, valid)


def payment_card(c: Column) -> Column:
    found = F.transform(F.regexp_extract_all(T.fold_digits(c), F.lit(CARD), 1), lambda m: F.regexp_replace(m, "[^0-9]", ""))
    return F.exists(found, lambda m: F.length(m).between(15, 16) & F.call_function("luhn_check", m))


def iban(c: Column) -> Column:
    found = F.transform(F.regexp_extract_all(c, F.lit(IBAN), 1), lambda m: F.regexp_replace(m, "[^A-Za-z0-9]", ""))

    def valid(m):
        turned = F.concat(F.substr(m, F.lit(5), F.length(m)), F.substr(m, F.lit(1), F.lit(4)))
        step = lambda acc, ch: F.when(ch.between("0", "9"), (acc * 10 + F.ascii(ch) - 48) % 97).otherwise((acc * 100 + F.ascii(ch) - 55) % 97)
        return F.length(m).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)

    return F.exists(found, valid)


def bank_code(c: Column) -> Column:
    return F.exists(F.regexp_extract_all(c, F.lit(BIC), 1), lambda m: F.substr(m, F.lit(5), F.lit(2)).isin(lx.COUNTRIES))


def social_security(c: Column) -> Column:
    def plausible(m):
        area = F.substr(m, F.lit(1), F.lit(3))
        return ~area.isin("000", "666") & ~area.startswith("9") & (F.substr(m, F.lit(5), F.lit(2)) != "00") & (F.substr(m, F.lit(8), F.lit(4)) != "0000")

    return F.exists(F.regexp_extract_all(T.fold_digits(c), F.lit(SSN), 1), plausible)


def ip_address(c: Column) -> Column:
    return F.rlike(T.fold_digits(c), F.lit(IPV4))


def confidential(c: Column) -> Column:
    low = F.lower(c)
    latin = [m for m in lx.CONFIDENTIAL if m.isascii()]
    closed = F.when(F.rlike(low, F.lit("(?:^|[^a-z])[a-z] [a-z](?:[^A-Za-z]|$)")), T.collapse_letters(low))  # few texts have letters spaced
    return T.any_of(low, lx.CONFIDENTIAL) | F.coalesce(T.any_of(closed, latin), F.lit(False))


def privilege(c: Column) -> Column:
    return T.any_of(F.lower(c), lx.PRIVILEGE)


def codename(c: Column) -> Column:
    return F.rlike(c, F.lit(CODENAME))


def source_code(c: Column) -> Column:
    return T.count_of(c, lx.CODE_MARKERS) >= 3


def medical(c: Column) -> Column:
    return T.any_of(F.lower(c), lx.MEDICAL)


CLASSIFIERS = {
    "jp_personal_number": personal_number, "jp_corporate_number": corporate_number, "payment_card": payment_card, "iban": iban, "bank_code": bank_code,
    "us_ssn": social_security, "ip_address": ip_address, "confidential": confidential, "privilege": privilege, "codename": codename, "source_code": source_code, "medical": medical,
}
RANK = {"allow": 0, "warn": 1, "block": 2}
MAX_DEPTH = 64


def _leaf(tree: dict, text: Column) -> Column:
    kind = tree["match"]
    if kind == "classifier":
        return CLASSIFIERS[tree["name"]](text)
    if kind == "regex":
        return F.rlike(text, F.lit(tree["pattern"]))
    if kind == "keywords":
        words = list(dict.fromkeys(w.lower() for w in tree["words"][:500]))
        return T.count_of(F.lower(text), words) >= tree.get("min", 1)
    if kind == "patterns":
        return reduce(lambda a, b: a | b, [F.rlike(text, F.lit(p)) for p in tree["patterns"]]) if tree["patterns"] else F.lit(False)
    if kind == "exact_data":
        return F.col(f"matches_{tree['set']}")
    if kind == "sender":
        return F.lower("from_addr").isin([a.lower() for a in tree["addresses"]])
    if kind == "recipient_domain":
        return F.exists("to_addrs", lambda a: T.address_domain(a).isin(tree["domains"]))
    if kind == "size":
        return F.col("size_bytes") >= tree["at_least"]
    if kind == "mime":
        return F.exists("mimes", lambda m: m.isin(tree["types"]))
    raise ValueError(f"unknown predicate {kind}")


def compile_condition(tree: dict, depth: int = 0, text: Column | None = None) -> Column:
    """A condition tree as one boolean Column over subject, body, from_addr, to_addrs, size_bytes, mimes.

    Nodes: {"and": [...]}, {"or": [...]}, {"not": node}, {"match": kind, ...}. Kinds: classifier (name), regex
    (pattern), keywords (words, min), pattern_group (name), exact_data (set: rows have a boolean column matches_<set>,
    as :func:`with_data_matches` adds), sender (addresses), recipient_domain (domains), size (at_least), mime (types).
    Empty lists and trees deeper than 64 are false. ``text`` replaces subject and body.
    """
    if depth > MAX_DEPTH:
        return F.lit(False)
    inner = lambda x: compile_condition(x, depth + 1, text)
    if "and" in tree:
        return reduce(lambda a, b: a & b, map(inner, tree["and"])) if tree["and"] else F.lit(False)
    if "or" in tree:
        return reduce(lambda a, b: a | b, map(inner, tree["or"])) if tree["or"] else F.lit(False)
    if "not" in tree:
        return ~inner(tree["not"])
    return _leaf(tree, F.concat_ws("\n", F.col("subject"), F.col("body")) if text is None else text)


def resolved(tree: dict, groups: dict[str, list[str]], columns: list[str]) -> dict:
    """The tree with pattern groups put in by name; groups and data sets that are not known are false."""
    if tree.get("match") == "pattern_group":
        return {"match": "patterns", "patterns": groups.get(tree["name"], [])}
    if tree.get("match") == "exact_data" and f"matches_{tree['set']}" not in columns:
        return {"or": []}
    if "match" in tree:
        return tree
    return {k: resolved(v, groups, columns) if k == "not" else [resolved(x, groups, columns) for x in v] for k, v in tree.items()}


def with_data_matches(rows: DataFrame, tokens: DataFrame, set_: str, key: str, text: str, salt: str, min_matches: int = 1) -> DataFrame:
    """Adds matches_<set>: whether a row's text holds enough of a registered data set."""
    hit = data_matches(rows, tokens, key, text, salt, min_matches).select(key, F.lit(True).alias(f"matches_{set_}"))
    return rows.join(hit, key, "left").withColumn(f"matches_{set_}", F.coalesce(f"matches_{set_}", F.lit(False)))


def _predicate(leaf: dict) -> dict:
    """A leaf in the form that a rule table keeps."""
    kind = leaf["match"]
    if kind == "keywords":
        return {"match": kind, "words": [w for w in dict.fromkeys(w.lower() for w in leaf["words"][:500]) if w], "min": leaf.get("min", 1)}
    if kind in ("regex", "patterns"):
        return {"match": "patterns", "patterns": [leaf["pattern"]] if kind == "regex" else leaf["patterns"]}
    if kind == "sender":
        return {"match": kind, "values": [a.lower() for a in leaf["addresses"]]}
    if kind in ("recipient_domain", "mime"):
        return {"match": kind, "values": leaf["domains" if kind == "recipient_domain" else "types"]}
    if kind not in ("classifier", "exact_data", "size"):
        raise ValueError(f"unknown predicate {kind}")
    return leaf


def _condition(tree: dict, number, depth: int = 0) -> tuple:
    """A tree as a rule table keeps it; ``number`` gives a leaf's number."""
    if depth > MAX_DEPTH:
        return FALSE
    for kind in ("and", "or"):
        if kind in tree:
            return (kind, [_condition(x, number, depth + 1) for x in tree[kind]]) if tree[kind] else FALSE
    return ("not", _condition(tree["not"], number, depth + 1)) if "not" in tree else ("leaf", number(tree))


def evaluate_rules(rows: DataFrame, rules: list[dict] | DataFrame, direction: str, groups: dict[str, list[str]] | None = None) -> DataFrame:
    """Findings (the columns of ``rows``, rule_id, action, priority, rank), one row a rule that holds on the text or on its
    percent-decoded form.

    ``rules``: dictionaries, or a table (id, direction, enabled, priority, action, condition as JSON) of thousands; nulls of
    enabled and direction stand for true and both. Words that are empty match nothing.
    """
    spark, columns = rows.sparkSession, rows.columns
    given = [{k: v for k, v in r.asDict().items() if v is not None} for r in rules.collect()] if isinstance(rules, DataFrame) else rules
    live = sorted((r for r in given if r.get("enabled", True) and r.get("direction", "both") in (direction, "both")), key=lambda r: (r["priority"], r["id"]))
    trees = [resolved(json.loads(r["condition"]) if isinstance(r["condition"], str) else r["condition"], groups or {}, columns) for r in live]
    leaves: list[dict] = []
    numbers: dict[str, int] = {}

    def number(leaf: dict) -> int:
        made = _predicate(leaf)
        key = json.dumps(made, sort_keys=True)
        if key not in numbers:
            numbers[key] = len(leaves)
            leaves.append(made)
        return numbers[key]

    conditions = [_condition(t, number) for t in trees]
    kinds = {x["match"] for x in leaves}
    table = RuleTable(leaves, conditions, [i for i, x in enumerate(leaves) if x["match"] in ("classifier", "exact_data")])
    rows = rows.withColumn("__raw", F.concat_ws("\n", F.col("subject"), F.col("body")))
    rows = rows.withColumn("__dec", F.when(F.contains("__raw", F.lit("%")), T.percent_decode(F.col("__raw")))).withColumn("__dec", F.nullif("__dec", "__raw"))

    def flags(text: str) -> Column:
        made = [F.coalesce(_leaf(leaves[i], F.col(text)), F.lit(False)) for i in table.flags]
        return F.array(*made) if made else F.array().cast("array<boolean>")

    nothing = F.lit(None).cast("string")
    read = kinds & {"keywords", "patterns"}  # else no text goes to the workers
    plain = {"sender": F.lower("from_addr")} if "sender" in kinds else {}
    plain |= {"recipient_domain": F.transform("to_addrs", T.address_domain)} if "recipient_domain" in kinds else {}
    plain |= {"size": F.col("size_bytes").cast("long")} if "size" in kinds else {}
    plain |= {"mime": F.col("mimes")} if "mime" in kinds else {}
    rows = rows.withColumns({"__raw_flags": flags("__raw"), "__dec_flags": F.when(F.col("__dec").isNotNull(), flags("__dec"))})
    # one row each: a generator keeps the flags, which a projection has made, apart from what follows
    rows = rows.select("*", F.explode(F.array(F.struct(F.col("__raw_flags").alias("raw"), F.col("__dec_flags").alias("dec")))).alias("__flags"))
    held = rules_that_hold(spark, table, F.col("__raw") if read else nothing, F.col("__dec") if read else nothing, F.col("__flags.raw"), F.col("__flags.dec"), plain)
    named = spark.createDataFrame([(k, r["id"], r["action"], r["priority"], RANK[r["action"]]) for k, r in enumerate(live)], "__rule int, rule_id string, action string, priority int, rank int")
    return rows.withColumn("__held", held).select(*columns, F.explode("__held").alias("__rule")).join(named, "__rule").select(*columns, "rule_id", "action", "priority", "rank")


def verdicts(findings: DataFrame, key: str) -> DataFrame:
    """The highest action a key's findings call for, with the rules in order and the first of the highest rank."""
    return findings.groupBy(key).agg(
        F.max_by("action", "rank").alias("verdict"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("priority", "rule_id"))), lambda s: s["rule_id"]), ",").alias("rules"),
        F.min_by("rule_id", F.struct(-F.col("rank"), "priority", "rule_id")).alias("reported_rule"),
    )


def _rule(id_: str, direction: str, priority: int, action: str, condition: dict | str) -> dict:
    return {"id": id_, "direction": direction, "priority": priority, "action": action, "condition": {"match": "classifier", "name": condition} if isinstance(condition, str) else condition}


# The default rules.
DEFAULT_RULES = [
    _rule("default-001", "outbound", 10, "block", "jp_personal_number"),
    _rule("default-002", "outbound", 10, "block", "payment_card"),
    _rule("default-003", "outbound", 20, "warn", "confidential"),
    _rule("default-004", "outbound", 30, "warn", {"match": "size", "at_least": 50 * 1024 * 1024}),
    _rule("default-005", "outbound", 15, "block", {"and": [{"match": "classifier", "name": "source_code"}, {"match": "recipient_domain", "domains": ["gmail.com", "yahoo.co.jp", "yahoo.com", "hotmail.com", "outlook.com", "icloud.com"]}]}),
    _rule("default-006", "outbound", 10, "block", "us_ssn"),
    _rule("default-007", "outbound", 10, "block", "medical"),
    _rule("default-008", "outbound", 20, "warn", "privilege"),
    _rule("default-009", "outbound", 20, "warn", "codename"),
    _rule("default-010", "outbound", 20, "warn", "iban"),
    _rule("default-011", "outbound", 20, "warn", "bank_code"),
    _rule("default-in-001", "inbound", 20, "warn", "jp_personal_number"),
    _rule("default-in-002", "inbound", 20, "warn", "payment_card"),
    _rule("default-in-003", "inbound", 20, "warn", "confidential"),
    _rule("default-in-004", "inbound", 20, "warn", "us_ssn"),
    _rule("default-in-005", "inbound", 20, "warn", "medical"),
    _rule("default-in-006", "inbound", 20, "warn", "privilege"),
    _rule("default-in-007", "inbound", 20, "warn", "codename"),
    _rule("default-in-008", "inbound", 20, "warn", "iban"),
    _rule("default-in-009", "inbound", 20, "warn", "bank_code"),
]


def excerpt(c: Column, word: str) -> Column:
    """Text around the first hit of a keyword: 30 characters before to 50 after; else the first 80; ellipses where cut."""
    at = F.locate(word, F.lower(c))
    start = F.when(at > 0, F.greatest(F.lit(1), at - 30)).otherwise(F.lit(1))
    end = F.when(at > 0, F.least(F.length(c), at - 1 + 50)).otherwise(F.least(F.length(c), F.lit(80)))
    cut = F.substr(c, start, end - start + 1)
    return F.when(F.length(c) <= 80, c).when(start == 1, F.concat(cut, F.lit("…"))).otherwise(F.concat(F.lit("…"), cut, F.lit("…")))


def escalate(verdicts_: DataFrame, suspicious: DataFrame, key: str = "msg_id") -> DataFrame:
    """Outbound verdicts of warn or more become block where a recipient looks misdirected; adds n_recipients."""
    per = suspicious.groupBy(key).agg(F.count("*").alias("n_recipients"))
    out = verdicts_.join(per, key, "left").withColumn("n_recipients", F.coalesce("n_recipients", F.lit(0)))
    return out.withColumn("verdict", F.when((F.col("n_recipients") > 0) & F.col("verdict").isin("warn", "block"), "block").otherwise(F.col("verdict")))


#: Bits of the filter of registered tokens: 2 MB, whatever is registered.
FILTER_BITS = 1 << 24


def _slots(token: Column, salt: str) -> list[Column]:
    """Two places of a token in the filter."""
    return [F.pmod(F.xxhash64(F.lit(salt), F.lit(k), token), F.lit(FILTER_BITS)) for k in (1, 2)]


def token_filter(tokens: DataFrame, salt: str) -> Column:
    """The filter of the tokens (column t) as an array of longs: one scalar of fixed size. Words of no token are there too."""
    words = tokens.select(F.explode(F.array(*_slots(F.col("t"), salt))).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at % 64 AS INT))").alias("bits"))
    every = tokens.sparkSession.range(FILTER_BITS // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    one = words.union(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return one.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")).scalar()


def maybe_in(words: Column, token: Column, salt: str) -> Column:
    """Whether the filter may hold a token; it never says no of one that it holds."""
    a, b = (F.getbit(F.get(words, F.shiftright(s, 6).cast("int")), (s % 64).cast("int")) == 1 for s in _slots(token, salt))
    return a & b


def data_matches(rows: DataFrame, tokens: DataFrame, key: str, text: str, salt: str, min_matches: int = 1) -> DataFrame:
    """Exact data match: distinct registered tokens in a text, by salted SHA-256; texts under the minimum drop out.

    ``tokens`` has a column token. A filter of fixed size over the registered tokens sorts out all but candidates where the
    text is read; only these are hashed, shuffled and joined by hash.
    """
    plain = lambda c: F.lower(F.trim(c))
    sealed = lambda c: F.sha2(F.concat(F.lit(salt).cast("binary"), F.lit(b"\x00"), c.cast("binary")), 256)
    registered = tokens.where(F.trim("token") != "").select(plain(F.col("token")).alias("t")).distinct()
    words = token_filter(registered, salt)
    known = registered.select(sealed(F.col("t")).alias("h"))
    found = F.transform(F.filter(F.split(F.col(text), r"[\s,;]+"), lambda t: F.octet_length(t) >= 3), plain)
    parts = rows.select(key, F.explode(F.array_distinct(found)).alias("t")).where(maybe_in(words, F.col("t"), salt))
    parts = parts.select(key, sealed(F.col("t")).alias("h")).distinct()
    return parts.join(known, "h").groupBy(key).agg(F.count("*").alias("matches")).where(F.col("matches") >= min_matches)


def misdirected(recipients: DataFrame, known: DataFrame, ours: str) -> DataFrame:
    """msg_id, address, reason, similar_to of suspicious recipients; ``recipients`` (msg_id, address), ``known`` (domain).

    Look-alikes are searched among known domains within two edits; keys of one-character deletions block the
    search, so domains are never paired with all others.
    """
    r = recipients.withColumn("domain", T.address_domain(F.col("address"))).where(F.col("domain").isNotNull())
    ours = ours.lower()
    per = r.groupBy("msg_id").agg(F.count("*").alias("n"), F.max(F.col("domain") == ours).alias("own"), F.min((F.col("domain") == ours) | F.col("domain").isin(lx.FREE_MAIL)).alias("closed"))
    k = known.select(F.lower("domain").alias("domain")).where(F.col("domain") != ours).distinct()
    fresh = r.where(F.col("domain") != ours).join(k, "domain", "left_anti")
    doms = fresh.select("domain").distinct()
    near = similar_domains(doms, k, 2)
    first = near.groupBy("domain").agg(F.min("other").alias("similar_to"))
    out = fresh.join(first, "domain", "left").join(per, "msg_id")
    inside = (F.col("n") > 1) & F.col("own") & F.col("closed") & F.col("domain").isin(lx.FREE_MAIL)
    reason = F.when(F.col("similar_to").isNotNull(), "lookalike").when(inside, "free_mail_inside")
    return out.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("msg_id", "address", "reason", "similar_to")


def similar_domains(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Pairs (domain, other) 1..k edits apart, blocked by k+1 chunks: one chunk survives k edits, shifted at most k."""

    def chunks(c: Column) -> Column:
        n = F.length(c)
        parts = []
        for i in range(k + 1):
            lo, hi = F.floor(n * i / (k + 1)), F.floor(n * (i + 1) / (k + 1))
            parts.append(F.struct(F.lit(i).alias("i"), n.alias("n"), F.substr(c, (lo + 1).cast("int"), (hi - lo).cast("int")).alias("g")))
        return F.array(*parts)

    right = b.select(F.col("domain").alias("other")).withColumn("x", F.explode(chunks(F.col("other")))).select("other", "x.*")
    probes = []
    c = F.col("domain")
    for dn in range(-k, k + 1):
        n = F.length(c) + dn
        for i in range(k + 1):
            lo, hi = F.floor(n * i / (k + 1)), F.floor(n * (i + 1) / (k + 1))
            for s in range(-k, k + 1):
                probes.append(F.when((n > 0) & (lo + s >= 0), F.struct(F.lit(i).alias("i"), n.alias("n"), F.substr(c, (lo + 1 + s).cast("int"), (hi - lo).cast("int")).alias("g"))))
    left = a.select("domain").withColumn("x", F.explode(F.array_distinct(F.array_compact(F.array(*probes))))).select("domain", "x.*")
    return left.join(right, ["i", "n", "g"]).where(T.within_edits(F.col("domain"), F.col("other"), k)).select("domain", "other").distinct()
