"""Detectors over message and document texts. Rows stay where they are: none of these shuffles but by request."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as T
from ..functions.matching import Hits, term_hits

MEMORY_BASE = {"user": 0.9, "system": 0.6, "mail": 0.3}


def char_entropy(c: Column) -> Column:
    """Shannon entropy of a text's characters, in bits; null stays null.

    An Arrow batch function: a fold over sorted characters inside the JVM takes some fifty times as long, and a
    grouping by (row, character) would shuffle what belongs to one row.
    """

    @F.pandas_udf("double")
    def bits(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if not t:
                out.append(None if t is None else 0.0)
                continue
            codes = np.sort(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32))
            edges = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1], [True]]))
            p = np.diff(edges) / len(codes)
            out.append(float(-(p * np.log2(p)).sum()) + 0.0)
        return pd.Series(out, dtype="float64")

    return bits(c)


SCREENED = [p.lower() for p in lx.OVERRIDE_PHRASES + lx.SPECIAL_TOKENS]


def screened_forms(c: Column) -> dict[str, Column]:
    """The forms of a text that the screen reads. A form is null where a cheap test shows that it holds nothing of its own."""
    token = r"[A-Za-z0-9+/]{20}"
    bare = F.when(F.rlike(c, F.lit(f"[{T.EMOJI}]")), T.strip_emoji(c))
    plain = F.when(F.contains(c, F.lit("&")), T.decode_entities(c))
    entities = F.when(plain != c, plain)
    decoded = lambda x: F.when(F.rlike(x, F.lit(token)), F.lower(F.array_join(T.decode_base64_tokens(x), "\n")))
    return {"n": T.normalise(c, True), "s": T.normalise_spaced(c, True), "bn": T.normalise(bare, True), "bs": T.normalise_spaced(bare, True), "b64": decoded(c), "ent": F.lower(entities), "eb64": decoded(entities)}


def screen_risks(c: Column, hits: dict[str, Hits]) -> Column:
    """The risks (kind, detail) of a text from what was found in its forms."""
    phrases, tokens = [p.lower() for p in lx.OVERRIDE_PHRASES], [t.lower() for t in lx.SPECIAL_TOKENS]
    kind = lambda name, found: F.transform(found, lambda h: F.struct(F.lit(name).alias("kind"), h.alias("detail")))
    first = lambda k: F.slice(hits[k].all_of(phrases), 1, 1)
    tags = F.when(F.rlike(c, F.lit(r"[\x{E0020}-\x{E007E}]")), T.tag_payload(c))
    return F.concat(
        kind("override_phrase", hits["n+s"].all_of(phrases)),
        kind("special_token", hits["n"].all_of(tokens)),
        kind("emoji_separated", hits["bn+bs"].all_of(phrases)),
        kind("base64", first("b64")),
        kind("tag_payload", F.array_compact(F.array(tags))),
        kind("entity", first("ent")),
        kind("base64", F.when(hits["b64"].any_of(phrases), F.array().cast("array<string>")).otherwise(first("eb64"))),  # entities, then base64
    )


def with_screen_risks(df: DataFrame, text: str, out: str = "risks") -> DataFrame:
    """Adds the risks; the forms of a text are read in one pass."""
    forms = screened_forms(F.col(text))
    made = df.withColumn("__hits", term_hits(list(forms.values()), SCREENED))
    at = {k: i for i, k in enumerate(forms)}
    hits = {k: Hits("__hits", SCREENED, [at[x] for x in k.split("+")]) for k in ("n", "n+s", "bn+bs", "b64", "ent", "eb64")}
    return made.withColumn(out, screen_risks(F.col(text), hits)).drop("__hits")


def screen(df: DataFrame, text: str = "body") -> DataFrame:
    """Adds risks (array of kind, detail), entropy and verdict: blocked, suspicious or clean."""
    out = with_screen_risks(df, text).withColumn("entropy", char_entropy(F.col(text)))
    high = (F.col("entropy") > 4.5) & (F.octet_length(text) > 40)
    return out.withColumn("verdict", F.when(F.size("risks") > 0, "blocked").when(high, "suspicious").otherwise("clean"))


def audit(df: DataFrame, text: str = "body") -> DataFrame:
    """Adds the findings of the output audit as flags, and safe."""
    c = F.col(text)
    low = T.normalise(c, screener=True)
    words = F.split(low, r"\s+")
    edge = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"
    mail = lambda w: F.contains(w, F.lit("@")) & F.contains(w, F.lit(".")) & F.rlike(F.regexp_replace(w, edge, ""), F.lit(r"^.+@[^@]*\.[^@]*$"))
    url = lambda w: (w.startswith("http://") | w.startswith("https://")) & T.any_of(w, lx.EXFILTRATION_PARAMS)
    out = (
        df.withColumn("instruction", T.any_of(low, lx.INSTRUCTION_MARKERS))
        .withColumn("mail_target", F.exists(words, mail))
        .withColumn("url_target", F.exists(words, url))
        .withColumn("escape", F.contains(c, F.lit("\x1b")))
        .withColumn("lone_cr", F.rlike(c, F.lit(r"\r(?!\n)")))
        .withColumn("tags", T.tag_payload(c).isNotNull())
        .withColumn("forged", T.any_of(low, lx.CLEARANCE_CLAIMS))
    )
    return out.withColumn("safe", ~(F.col("instruction") | F.col("mail_target") | F.col("url_target") | F.col("escape") | F.col("lone_cr") | F.col("tags") | F.col("forged")))


def preflight(df: DataFrame, text: str = "body") -> DataFrame:
    """Adds gate: block on bidi overrides, zero-width characters or injection; advisory on entropy; else clean."""
    c = F.col(text)
    out = screen(df, text).withColumn("bidi", F.rlike(c, F.lit(r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"))).withColumn("zero_width", F.rlike(c, F.lit(r"[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]")))
    return out.withColumn("gate", F.when(F.col("bidi") | F.col("zero_width") | (F.col("verdict") == "blocked"), "block").when(F.col("verdict") == "suspicious", "advisory").otherwise("clean"))


def memory_score(source: Column, content: Column) -> Column:
    """Trust of a memory write: base by source, less 0.2 a pattern that is not negated and 0.2 over 500 bytes."""
    count = lambda form, p: F.regexp_count(form, F.lit(rf"\Q{p}\E(?!{'|'.join(lx.MEMORY_NEGATIONS)})"))
    a, b = T.both_forms(content)
    hits = sum((F.greatest(count(a, p), count(b, p)) for p in lx.MEMORY_PATTERNS[1:]), F.greatest(count(a, lx.MEMORY_PATTERNS[0]), count(b, lx.MEMORY_PATTERNS[0])))
    base = F.when(source == "user", 0.9).when(source == "system", 0.6).otherwise(0.3)
    score = base - 0.2 * hits - F.when(F.octet_length(content) > 500, 0.2).otherwise(0.0)
    return F.when((source == "mail") & (hits > 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def verification(c: Column) -> Column:
    forms = T.both_forms(c)
    money, haste = T.count_of(forms, lx.FINANCIAL), T.count_of(forms, lx.VERIFY_URGENCY)
    return F.when((money > 0) & (haste > 0), "strong").when((money > 0) | (haste > 0), "optional").otherwise("none")


def persuasion(c: Column, forms: list[Column] | None = None) -> Column:
    """Families of persuasion with any phrase, 0 to 6; ``forms`` are the normal forms where they are at hand."""
    per = [sum((T.any_of(f, terms).cast("int") for terms in lx.PERSUASION.values()), F.lit(0)) for f in forms or T.both_forms(c)]
    return F.greatest(*per)


def content_flags(c: Column, forms: list[Column] | None = None) -> dict[str, Column]:
    forms = forms or T.both_forms(c)
    return {"money_urgency": T.any_of(forms, lx.URGENCY) & T.any_of(forms, lx.MONEY), "route_change": T.any_of(forms, lx.ROUTE_CHANGE), "channel_move": T.any_of(forms, lx.CHANNEL_MIGRATION)}


def language(c: Column) -> Column:
    n = F.length(c)
    kept = lambda cls: F.length(F.regexp_replace(c, f"[^{cls}]+", "")) / n  # noqa: E731  runs at a time
    return F.when(n == 0, "other").when(kept(r"\x{3041}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}") > 0.15, "japanese").when(kept("A-Za-z") > 0.40, "english").otherwise("other")


def style(df: DataFrame, text: str = "body") -> DataFrame:
    """Adds paragraphs, sentences, commas, chars, signature_lines, formality and the ratios built from them."""
    c, low = F.col(text), F.lower(F.col(text))
    times = lambda form, terms: sum((F.regexp_count(form, F.lit(rf"\Q{t}\E")) for t in terms), F.lit(0))
    polite, casual = times(c, lx.POLITE[0]) + times(low, lx.POLITE[1]), times(c, lx.CASUAL[0]) + times(low, lx.CASUAL[1])
    lines = F.split(F.regexp_replace(c, r"\n$", ""), "\n")
    out = (
        df.withColumn("paragraphs", F.size(F.filter(F.split(c, "\n\n"), lambda p: F.rlike(p, F.lit(r"\S")))))
        .withColumn("sentences", F.regexp_count(c, F.lit("[。．.!?！？]")))
        .withColumn("commas", F.regexp_count(c, F.lit("[、，,]")))
        .withColumn("chars", F.length(c))
        .withColumn("signature_lines", F.size(F.filter(F.slice(lines, F.greatest(F.lit(1), F.size(lines) - 4), F.lit(5)), lambda x: F.rlike(x, F.lit(r"\S")))))
        .withColumn("formality", F.when(polite + casual == 0, 0.5).otherwise(polite / (polite + casual)))
    )
    return (
        out.withColumn("sentences_per_paragraph", F.when(F.col("paragraphs") > 0, F.col("sentences") / F.col("paragraphs")).otherwise(F.col("sentences").cast("double")))
        .withColumn("chars_per_sentence", F.when(F.col("sentences") > 0, F.col("chars") / F.col("sentences")).otherwise(F.col("chars").cast("double")))
        .withColumn("punctuation_density", F.when(F.col("chars") > 0, F.col("commas") * 100.0 / F.col("chars")).otherwise(0.0))
    )


QR_BLOCKS = r"█▀▄▌▐░▒▓■□▪▫◼◻●○◾◽⬛⬜\x{1F7E5}\x{1F7E6}　\x{2800}-\x{28FF}"


def block_code(c: Column, least: int = 8) -> Column:
    """Whether ``least`` lines in a row are block characters by half and 8 characters long; blank lines end a run."""
    trimmed = F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    dense = lambda x: (F.length(x) >= 8) & (F.length(F.regexp_replace(x, f"[^{QR_BLOCKS}]", "")) / F.length(x) >= 0.5)
    state = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a, x):
        run = F.when(dense(x), a["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(trimmed, state, step, lambda a: a["best"] >= least)


def phones(df: DataFrame, key: str, text: str = "body") -> DataFrame:
    """key, number, high_risk: runs with 10 to 15 digits, with the lines around them."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("i", "line"), F.split(F.col(text), "\n").alias("all"))
    around = F.concat_ws(" ", F.when(F.col("i") > 0, F.get("all", F.col("i") - 1)), F.col("line"), F.get("all", F.col("i") + 1))
    found = lines.select(key, around.alias("context"), F.explode(F.regexp_extract_all("line", F.lit(r"([0-9+() -]+)"), 1)).alias("run"))
    haste = T.any_of(F.lower("context"), HASTE)
    return found.where(F.length(F.regexp_replace("run", "[^0-9]", "")).between(10, 15)).select(key, F.regexp_replace("run", "[^0-9+]", "").alias("number"), haste.alias("high_risk"))


HASTE = ["至急", "緊急", "今すぐ", "本日中", "急いで", "すぐに", "urgent", "asap", "immediately", "right now", "as soon as"]


def pressed_phone(c: Column) -> Column:
    """Whether a text has a phone number of high risk, as :func:`phones` finds them; the text stays one row."""
    lines, digits = F.split(c, "\n"), lambda run: F.length(F.regexp_replace(run, "[^0-9]", "")).between(10, 15)
    around = lambda i: F.lower(F.concat_ws(" ", F.when(i > 0, F.get(lines, i - 1)), F.get(lines, i), F.get(lines, i + 1)))
    hit = lambda i: F.exists(F.regexp_extract_all(F.get(lines, i), F.lit(r"([0-9+() -]+)"), 1), digits) & F.exists(F.lit(HASTE), lambda t: F.contains(around(i), t))
    return F.coalesce(F.when(F.rlike(c, F.lit(r"(?:[0-9][+() -]*+){10}")), F.exists(F.sequence(F.lit(0), F.size(lines) - 1), hit)), F.lit(False))


def has_wallet(c: Column) -> Column:
    """Whether a word of the text is a wallet address, as :func:`wallets` finds them."""
    bare = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    maybe = F.rlike(c, F.lit(r"0[xX][0-9A-Fa-f]{40}|bc1[A-Za-z0-9]{23}|[13][A-Za-z0-9]{26}"))
    return F.coalesce(F.when(maybe, F.exists(F.split(c, r"\s+"), lambda w: F.rlike(bare(w), F.lit(f"{ETH}|{BTC}")))), F.lit(False))


def leads_to(c: Column, hosts: list[str], maybe: Column) -> Column:
    """Whether a word's host is, or lies under, a listed host, as :func:`links_by_host` finds them; looked at where ``maybe``."""
    host = lambda w: T.pivot_host(F.rtrim(w, F.lit(".,)]!?;")))
    words = F.filter(F.split(c, r"\s+"), lambda w: F.contains(w, F.lit(".")) & F.exists(F.lit(hosts), lambda h: F.contains(w, h)))
    return F.coalesce(F.when(maybe, F.exists(words, lambda w: F.exists(F.lit(hosts), lambda h: (host(w) == h) | F.endswith(host(w), F.concat(F.lit("."), h))))), F.lit(False))


def links_by_host(df: DataFrame, key: str, hosts: dict[str, str], text: str = "body") -> DataFrame:
    """key, url, kind of words whose host is, or lies under, a listed host; joined on the host's suffixes."""
    words = df.select(key, F.explode(F.filter(F.split(F.col(text), r"\s+"), lambda w: F.contains(w, F.lit(".")))).alias("w")).select(key, F.rtrim("w", F.lit(".,)]!?;")).alias("url"))
    parts = words.withColumn("host", T.pivot_host(F.col("url"))).withColumn("parts", F.split("host", r"\."))
    suffixes = parts.select(key, "url", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "."))).alias("suffix"))
    listed = df.sparkSession.createDataFrame(list(hosts.items()), "suffix string, kind string")  # a fixed, short list
    return suffixes.join(F.broadcast(listed), "suffix").select(key, "url", "kind")


def channel_links(df: DataFrame, key: str, text: str = "body") -> DataFrame:
    """Off-channel links with what their addresses tell: tenant, workspace, meeting_id, has_password, is_bot, high_risk."""
    u, kind = F.col("url"), F.col("kind")
    found = lambda pattern, k: F.when((kind == k) & F.rlike(u, F.lit(pattern)), F.regexp_extract(u, pattern, 1))
    return links_by_host(df, key, lx.MEETING_HOSTS, text).withColumns({
        "tenant": found(r"teams\.microsoft\.com/l/meetup-join/.*?tenantId=([^&]*)", "teams"), "workspace": found(r"https://(.*?)\.slack\.com", "slack"),
        "meeting_id": F.when(kind == "zoom", F.coalesce(found(r"/j/([0-9]*)", "zoom"), F.lit("unknown"))), "has_password": (kind == "zoom") & (F.contains(u, F.lit("pwd=")) | F.contains(u, F.lit("&p="))),
        "is_bot": (kind == "telegram") & (F.contains(u, F.lit("_bot")) | F.contains(u, F.lit("bot?"))), "high_risk": kind.isin("whatsapp", "telegram", "signal"),
    })


ETH, BTC = r"^0[xX][0-9A-Fa-f]{40}$", r"^bc1[A-Za-z0-9]{23,59}$|^[13][A-Za-z0-9]{26,33}$"


def wallets(df: DataFrame, key: str, text: str = "body") -> DataFrame:
    words = df.select(key, F.explode(F.split(F.col(text), r"\s+")).alias("w")).select(key, F.regexp_replace("w", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("address"))
    eth, btc = F.rlike("address", F.lit(ETH)), F.rlike("address", F.lit(BTC))
    return words.withColumn("currency", F.when(eth, "ETH").when(btc, "BTC")).where("currency IS NOT NULL").select(key, "currency", "address")


def redact(c: Column) -> Column:
    """Card numbers, mail local parts, bearer tokens and phone numbers taken out, in this order."""
    c = F.translate(c, lx.FULL_WIDTH, lx.HALF_WIDTH)
    c = F.regexp_replace(c, r"(?:[ -]*[0-9]){16}|(?:[ -]*[0-9]){13,15}[ -]*", "[REDACTED-CC]")
    c = F.regexp_replace(c, r"(?<![A-Za-z0-9._-])([._-]*+[A-Za-z0-9][A-Za-z0-9._-]{2})[A-Za-z0-9._-]++@", "$1***@")
    c = F.regexp_replace(c, r"Bearer \S*", "Bearer [REDACTED]")
    return F.regexp_replace(c, r"[0-9](?:[-() ]*[0-9]){9,10}[-() ]*+(?![0-9])", "[TEL-REDACTED]")


# Names of columns that hold personal data.
SENSITIVE_FIELDS = [
    "email", "e_mail", "mail", "subject", "body", "content", "message", "password", "passwd", "secret", "token", "api_key", "bearer", "authorization",
    "auth", "phone", "address", "name", "full_name", "display_name", "credit_card", "card_number", "cvv", "my_number", "マイナンバー", "個人番号",
]


def redact_columns(df: DataFrame) -> DataFrame:
    """Redact the string columns whose names are on the sensitive list; drop the others on it."""
    out = df
    for f in df.schema:
        if f.name.lower() in SENSITIVE_FIELDS:
            out = out.withColumn(f.name, redact(F.col(f.name))) if f.dataType.simpleString() == "string" else out.drop(f.name)
    return out
