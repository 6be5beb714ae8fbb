"""URL and domain risk as Column expressions and one suffix join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as T
from .containing import hosts_under, one_edit

# --- Fixed values -----------------------------------------------------------------------------------------
AUTH_DOMAINS = ["microsoft.com", "microsoftonline.com", "live.com", "outlook.com", "office.com", "google.com", "accounts.google.com", "github.com", "apple.com"]
KIT_PATTERNS = ["tycoon", "2fa-relay", "mfa-bypass", "auth-relay", "token-relay", "0365", "microsoft365", "m365-", "office365-"]
PROXY_PATHS = ["/relay", "/proxy", "/token-relay", "/auth-relay", "/mfa-relay", "/forward"]
TOKEN_PARAMS = ["id_token", "access_token", "session_token", "auth_token"]
OAUTH_PARAMS = ["code", "state", "nonce"]
HOMOGLYPH_LETTERS = [
    "а", "е", "і", "о", "р", "с", "х", "у", "ѕ", "є", "ј", "г", "ο", "ρ", "ν", "ω", "α", "օ", "ո", "ơ", "ɡ",
]
FOLDED_LETTERS = {
    "а": "a", "е": "e", "і": "i", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "ѕ": "s", "є": "e", "ј": "j", "г": "r", "А": "a", "Е": "e",
    "О": "o", "Р": "p", "С": "c", "Х": "x", "У": "y", "І": "i", "В": "b", "М": "m", "Н": "h", "К": "k", "Т": "t", "ο": "o", "ρ": "p", "ν": "v",
    "ω": "w", "α": "a", "Ο": "o", "Α": "a", "Β": "b", "Ε": "e", "Η": "h", "Κ": "k", "Μ": "m", "Ν": "n", "Ρ": "p", "Τ": "t", "Χ": "x", "օ": "q",
    "ո": "o", "ơ": "o", "ɡ": "g",
}
TRUSTED = ["amazon.com", "amazon.co.jp", "google.com", "microsoft.com", "apple.com", "github.com", "stripe.com", "anthropic.com"]
FREE_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".click", ".download", ".loan"]
CODE_SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly", "shorturl.at", "rb.gy", "s.id", "tiny.cc", "lnkd.in", "t.ly", "shrtco.de", "qrco.de", "qr.codes", "scanova.io", "qrfy.com", "flowcode.com"]
REWRITERS = ["safelinks.protection.outlook.com", "urldefense.com", "urldefense.proofpoint.com", "linkprotect.cudasvc.com", "secure-web.cisco.com", "clicktime.trendmicro.com", "protection.sophos.com", "websense.com", "wsed.org", "mimecastprotect.com", "avanan.net"]
DIGIT_SWAPS = ["amaz0n", "amaz", "g00gle", "micr0soft", "paypa1", "0ffice"]
LINK_SHORTENERS = ["bit.ly", "t.co", "tinyurl.com", "goo.gl", "ow.ly", "buff.ly", "dlvr.it", "ift.tt", "short.link", "rebrand.ly", "cutt.ly", "tiny.cc", "is.gd", "rb.gy", "clck.ru", "qr.ae", "po.st", "shorturl.at"]
REDIRECT_KEYS = ["redirect", "url", "to", "dest", "link", "next", "continue", "r"]
PLATFORMS = {
    "drive.google.com": "Google Drive", "docs.google.com": "Google Drive", "sheets.google.com": "Google Drive", "1drv.ms": "Microsoft OneDrive", "onedrive.live.com": "Microsoft OneDrive",
    "sharepoint.com": "Microsoft SharePoint", "docusign.net": "DocuSign", "docusign.com": "DocuSign", "adobesign.com": "Adobe Sign", "echosign.com": "Adobe Sign", "dropbox.com": "Dropbox", "db.tt": "Dropbox",
    "box.com": "Box", "boxcloud.com": "Box", "notion.so": "Notion", "notion.site": "Notion", "smartsheet.com": "Smartsheet",
}
# ----------------------------------------------------------------------------------------------------------
HOMOGLYPHS = "".join(HOMOGLYPH_LETTERS)
FOLD_FROM, FOLD_TO = "".join(FOLDED_LETTERS), "".join(FOLDED_LETTERS.values())


def _any(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cs)


def _total(cs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cs)


def urls(df: DataFrame, key: str, text: str = "body") -> DataFrame:
    """key, pos, url of the http(s) words of a text, trailing marks dropped."""
    words = df.select(key, F.posexplode(F.split(F.col(text), r"\s+")).alias("pos", "w"))
    return words.where(F.rlike("w", F.lit("^https?://"))).select(key, "pos", F.rtrim("w", F.lit(".,)]!?;")).alias("url"))


def with_proxy_score(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds score, the proxy-phishing score 0 to 100; the cleaned URL and its host are taken once a row."""
    df = df.withColumn("__low", F.lower(F.regexp_replace(url, r"\p{Cntrl}", "")))
    df = df.withColumn("__host", proxy_host(F.col("__low")))
    return df.withColumn("score", proxy_points(F.col("__low"), F.col("__host"))).drop("__low", "__host")


def proxy_points(low: Column, host: Column) -> Column:
    legit = _any([T.host_is(host, d) for d in AUTH_DOMAINS])
    param = lambda p: F.rlike(low, F.lit(rf"[?&#]{p}="))
    points = (
        [F.when(param(p), 25).otherwise(0) for p in TOKEN_PARAMS]
        + [F.when(~legit & param(p), 15).otherwise(0) for p in OAUTH_PARAMS]
        + [F.when(_any([F.contains(host, F.lit(d)) & ~T.host_is(host, d) for d in AUTH_DOMAINS]), 50).otherwise(0)]
        + [F.when(F.contains(low, F.lit(p)), 30).otherwise(0) for p in KIT_PATTERNS]
        + [F.when(F.contains(low, F.lit(p)), 15).otherwise(0) for p in PROXY_PATHS]
        + [F.when(T.any_of(low, ["redirect=", "next=", "url="]) & F.contains(low, F.lit("http")), 20).otherwise(0)]
    )
    return F.least(F.lit(100), _total(points))


def proxy_host(low: Column) -> Column:
    return F.regexp_extract(low, r"^(?:https?://)*([^/?#]*)", 1)


def proxy_verdict(score: Column) -> Column:
    return F.when(score >= 50, "dangerous").when(score >= 20, "caution").otherwise("safe")


def fold_homoglyphs(c: Column) -> Column:
    return F.lower(F.translate(c, lx.FULL_WIDTH[:-1] + FOLD_FROM, lx.HALF_WIDTH[:-1] + FOLD_TO))


def _scripts(c: Column) -> Column:
    return _total([F.rlike(c, F.lit(cls)).cast("int") for cls in ("[A-Za-z]", r"[\x{0400}-\x{04FF}]", r"[\x{0370}-\x{03FF}]", r"[\x{0530}-\x{058F}]")])


def idn_risk(domain: Column, name: bool = False) -> Column:
    """0.4 a punycode label (not for display names), 0.5 for look-alike characters, 0.4 for mixed scripts; 1 at most."""
    labels = F.size(F.filter(F.split(F.lower(domain), r"\."), lambda x: x.startswith("xn--"))) * (0.0 if name else 0.4)
    glyphs = F.when(F.rlike(domain, F.lit(rf"[{HOMOGLYPHS}\x{{FF01}}-\x{{FF5E}}]")), 0.5).otherwise(0.0)
    return F.least(F.lit(1.0), labels + glyphs + F.when(_scripts(domain) >= 2, 0.4).otherwise(0.0))


def lookalike(domain: Column, ours: str) -> Column:
    """What it resembles of our own domain, at one edit, and then of the watched brands, within two."""
    tests = [F.when(T.one_edit_apart(domain, F.lit(ours)), F.lit(ours))]
    tests += [F.when((domain != w) & T.within_edits(domain, F.lit(w), 2), F.lit(w)) for w in lx.WATCHED_DOMAINS]
    return F.coalesce(*tests)


def lookalikes(domains: DataFrame, ours: str, contacts: DataFrame) -> DataFrame:
    """The distinct domains (column domain) with resembles: ours, then a watched brand, then the least contact domain at one
    edit; null if there is none. ``contacts`` (domain) is a table of any size."""
    domains = domains.select("domain").where("domain IS NOT NULL").distinct()
    near = one_edit(domains.select(F.col("domain").alias("x")), contacts.select(F.lower("domain").alias("x"))).groupBy("a").agg(F.min("b").alias("__contact"))
    return domains.join(near, F.col("domain") == F.col("a"), "left").select("domain", F.coalesce(lookalike(F.col("domain"), ours), "__contact").alias("resembles"))


def _trusted(host: Column) -> Column:
    return _any([T.host_is(host, t) for t in TRUSTED])


def _brand_inside(host: Column) -> Column:
    return _any([host.startswith(f"{t}.") | F.contains(host, F.lit(f".{t}.")) for t in TRUSTED])


def with_reputation(df: DataFrame, url: str = "url", malicious: DataFrame | None = None) -> DataFrame:
    """Adds reputation; the host is taken once a row. ``malicious`` (domain) lists hosts and is a table of any size."""
    df, bad = df.withColumn("__host", T.url_host(F.col(url))), F.lit(False)
    if malicious is not None:
        listed = malicious.select(F.lower("domain").alias("__bad")).where("__bad <> ''").distinct()
        df, bad = df.join(listed, F.col("__host") == F.col("__bad"), "left"), F.col("__bad").isNotNull()
    return df.withColumn("reputation", reputation(F.col(url), bad, F.col("__host"))).drop("__host", "__bad")


def reputation(url: Column, bad: Column | None = None, host: Column | None = None) -> Column:
    """trusted, neutral, suspicious or malicious, of an unwrapped URL; rules in order. ``bad``: whether a block list has the host."""
    host = T.url_host(url) if host is None else host
    folded = F.replace(host, F.lit("-"), F.lit("."))
    number = F.rlike(host, F.lit(r"^(?:[0-9]+|0[xX][0-9A-Fa-f]+)(?:\.(?:[0-9]+|0[xX][0-9A-Fa-f]+))*$"))
    swap = _any([F.contains(host, F.lit(b)) & ~F.contains(host, F.lit(b.replace("0", "o").replace("1", "l"))) for b in DIGIT_SWAPS])
    rules = [
        (_any([T.host_is(host, r) for r in REWRITERS]) | (host.startswith("protect-") & host.endswith(".mimecast.com")), "suspicious"),
        (F.contains(url, F.lit("@")) | F.rlike(host, F.lit(r"(?:^|\.)-|-(?:\.|$)")), "suspicious"),
        ((folded != host) & (_trusted(folded) | _brand_inside(folded)), "suspicious"),
        (F.lit(False) if bad is None else bad, "malicious"),
        (_trusted(host), "trusted"),
        (number, "suspicious"),
        (F.rlike(host, F.lit(r"(?:^|\.)xn--|[^\x00-\x7F]")), "suspicious"),
        (_any([T.host_is(host, s) for s in CODE_SHORTENERS]), "suspicious"),
        (_any([host.endswith(t) for t in FREE_TLDS]), "suspicious"),
        (_brand_inside(host), "suspicious"),
        (_any([T.within_edits(host, F.lit(t), 3) for t in TRUSTED]), "suspicious"),
        (swap, "suspicious"),
    ]
    out = F.when(rules[0][0], rules[0][1])
    for test, verdict in rules[1:]:
        out = out.when(test, verdict)
    return out.otherwise("neutral")


def decoded(value: Column) -> Column:
    """URL-decoded with stray percent signs kept, and the short HTML unescape."""
    tidy = F.regexp_replace(value, r"%(?![0-9A-Fa-f]{2})", "%25")
    out = F.try_url_decode(tidy)
    for a, b in (("&amp;", "&"), ("&#38;", "&"), ("&#x26;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _web(c: Column) -> Column:
    return F.when(c.startswith("http://") | c.startswith("https://"), c)


def unwrap_once(url: Column) -> Column:
    """The link inside one layer of a gateway, redirector or translator; null if there is none."""
    return F.transform(F.array(T.url_host(url)), lambda host: _unwrapped(url, host))[0]


def _unwrapped(url: Column, host: Column) -> Column:
    p = lambda name: _web(decoded(T.query_param(url, name)))
    under = lambda d: T.host_is(host, d)
    google = (host == "google.com") | host.endswith(".google.com") | host.startswith("google.") | F.contains(host, F.lit(".google."))
    dashes = _web(decoded(F.translate(T.query_param(url, "u"), "-_", "%/")))
    target = decoded(T.query_param(url, "domain"))
    site = F.when(F.rlike(target, F.lit(r"^[^/?&#@ ]*\.[^/?&#@ ]*$")), F.concat(F.lit("https://"), target))
    bing = T.query_param(url, "u")
    b64 = F.translate(F.substring(bing, 3, 100000), "-_", "+/")
    inner = F.decode(F.try_to_binary(F.rpad(b64, (F.ceil(F.length(b64) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")), "UTF-8")
    goog = F.replace(F.replace(F.replace(F.regexp_extract(host, r"^(.*)\.translate\.goog$", 1), F.lit("--"), F.lit("\x01")), F.lit("-"), F.lit(".")), F.lit("\x01"), F.lit("-"))
    return (
        F.when(under("safelinks.protection.outlook.com"), p("url"))
        .when(host.isin("urldefense.com", "urldefense.proofpoint.com"), F.when(F.contains(url, F.lit("/v3/")), v3(url)).when(F.contains(url, F.lit("/v2/")), dashes).otherwise(p("u")))
        .when((host.startswith("protect-") & host.endswith(".mimecast.com")) | under("mimecastprotect.com"), site)
        .when(google & T.any_of(url, ["/url?", "/imgres?", "/translate?"]), F.coalesce(p("q"), p("url"), p("imgurl"), p("u")))
        .when(under("slack-redir.net"), p("url"))
        .when(under("bing.com"), F.when(bing.startswith("a1"), _web(inner)))
        .when(under("linkedin.com"), F.when(F.contains(url, F.lit("/slink?")), p("url")))
        .when(under("youtube.com"), F.when(F.contains(url, F.lit("/redirect")), F.coalesce(p("q"), p("url"))))
        .when(host.endswith(".translate.goog"), F.when(F.contains(goog, F.lit(".")), F.concat(F.lit("https://"), goog)))
        .when(host.isin("l.facebook.com", "lm.facebook.com", "l.instagram.com"), p("u"))
    )


RUN_CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"


def v3(url: Column) -> Column:
    """Version 3 of one gateway: stars in the mangled URL stand for characters of the encoded tail, `**X` for a run."""
    parts = F.regexp_extract(url, r"/v3/__(.*?)__;", 1)
    slash = F.regexp_replace(parts, r"^([A-Za-z0-9+.-]+):/(?=[^/])", "$1://")
    b64 = F.translate(F.regexp_extract(url, r"__;([^!]*)", 1), "-_", "+/")
    tail = F.coalesce(F.decode(F.try_to_binary(F.rpad(b64, (F.ceil(F.length(b64) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")), "UTF-8"), F.lit(""))
    tokens = F.regexp_extract_all(decoded(slash), F.lit(r"(\*\*[A-Za-z0-9_-]|\*|[^*]+)"), 1)
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a, t):
        n = F.when(t.startswith("**"), F.instr(F.lit(RUN_CODES), F.substring(t, 3, 1)) + 1).when(t == "*", 1).otherwise(0)
        return F.struct(F.concat(a["out"], F.when(n > 0, F.substr(tail, a["at"] + 1, n)).otherwise(t)).alias("out"), (a["at"] + n).cast("int").alias("at"))

    return F.when(parts != "", _web(F.aggregate(tokens, state, step, lambda a: F.when(a["at"] <= F.length(tail), a["out"]))))


def unwrap(url: Column) -> Column:
    """Up to two layers off; the URL itself if it is not wrapped."""
    once = F.coalesce(unwrap_once(url), url)
    return F.transform(F.array(once), lambda u: F.coalesce(unwrap_once(u), u))[0]


def payload_reputation(text: Column) -> Column:
    scheme = F.rlike(F.lower(F.ltrim(text)), F.lit("^(?:blob:|data:|javascript:)"))
    web = text.startswith("http://") | text.startswith("https://")
    return F.when(web, reputation(text)).when(scheme, "suspicious").otherwise("neutral")


def code_count_risk(n: Column) -> Column:
    return F.when(n <= 1, "normal").when(n == 2, "elevated").otherwise("split_suspected")


def shortened(url: Column) -> Column:
    return T.any_of(F.lower(url), [f"://{d}" for d in LINK_SHORTENERS])


def actual_host(url: Column) -> Column:
    """Lower-case host without user part and port."""
    return F.lower(F.regexp_extract(F.regexp_replace(F.regexp_extract(url, r"^(?:https?://)*([^/?]*)", 1), "^.*@", ""), "^([^:]*)", 1))


def _first_platform(host: Column, test) -> Column:
    """The platform of the first listed domain that ``test`` (host, domain) holds for; the host is taken once a row."""
    at = lambda h: F.array_position(F.transform(T.array_of(list(PLATFORMS)), lambda d: test(h, d)), True).cast("int")
    return F.get(F.transform(F.array(host), lambda h: F.get(T.array_of(list(PLATFORMS.values())), at(h) - 1)), F.lit(0))


def _lies_under(host: Column, domain: Column) -> Column:
    return F.coalesce((host == domain) | F.endswith(host, F.concat(F.lit("."), domain)), F.lit(False))


def platform(url: Column, host: Column | None = None) -> Column:
    return _first_platform(host if host is not None else actual_host(url), _lies_under)


def impersonated(url: Column, host: Column | None = None) -> Column:
    return _first_platform(host if host is not None else actual_host(url), lambda h, d: F.coalesce(F.contains(h, d), F.lit(False)) & ~_lies_under(h, d))


def redirect_host(url: Column) -> Column:
    """Host of the first web address that a redirect parameter of the URL holds, percent escapes decoded."""
    value = lambda p: T.url_decoded(F.regexp_extract(p, rf"^(?:{'|'.join(REDIRECT_KEYS)})=(.*)$", 1))
    targets = F.filter(F.transform(F.split(F.regexp_extract(url, r"\?(.*)$", 1), "&"), value), lambda v: F.rlike(v, F.lit("^https?://")))
    return F.when(F.contains(url, F.lit("?")), actual_host(F.get(targets, F.lit(0))))


def with_link_risk(df: DataFrame, familiar: Column, blocked: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Adds risk (safe, caution, warn, suspicious or block; null for other links) and reasons of a collaboration link.

    ``blocked`` (domain): a table of domains known as malicious, matched against the host and the host of a redirect
    parameter, with their subdomains. ``familiar``: whether the sender often shares links of the platform.
    """
    u = F.col(url)
    df = df.withColumns({"__host": actual_host(u), "__to": redirect_host(u) if blocked is not None else F.lit(None).cast("string"), "__familiar": familiar})
    df, familiar = df.withColumn("__platform", F.coalesce(platform(u, F.col("__host")), impersonated(u, F.col("__host")))), F.col("__familiar")
    host_hit = redirect_hit = F.lit(False)
    if blocked is not None:
        listed = hosts_under(df.select(F.explode(F.array("__host", "__to")).alias("host")), blocked)
        for c, n in (("__host", "__bad"), ("__to", "__bad_to")):
            df = df.join(listed.select(F.col("host").alias(n)), F.col(c) == F.col(n), "left")
        host_hit = F.col("__bad").isNotNull()
        redirect_hit = ~host_hit & F.col("__bad_to").isNotNull()
    name, domain = (lambda i, v=v: F.get(T.array_of(list(v)), i) for v in (PLATFORMS.values(), PLATFORMS))
    imitates = F.exists(F.sequence(F.lit(0), F.lit(len(PLATFORMS) - 1)), lambda i: (F.col("__platform") == name(i)) & F.contains(u, domain(i)) & ~_lies_under(F.col("__host"), domain(i)))
    fake = ~host_hit & ~redirect_hit & F.coalesce(imitates, F.lit(False))
    plain = ~host_hit & ~redirect_hit & ~fake
    login = T.any_of(F.lower(u), ["login", "signin", "auth"])
    injected = T.any_of(T.both_forms(u, True), [p.lower() for p in lx.OVERRIDE_PHRASES]) | T.any_of(T.normalise(u, True), [t.lower() for t in lx.SPECIAL_TOKENS])
    long, short, other = F.octet_length(u) > 8192, shortened(u), F.col("__platform").isNull()
    risk = (
        F.when(long, "suspicious").when(short, "warn").when(other, None).when(host_hit | redirect_hit | injected, "block").when(fake, "suspicious").when(login, "warn").when(familiar, "safe").otherwise("caution")
    )
    found = {"blocked_host": host_hit, "blocked_redirect": redirect_hit, "imitation": fake, "familiar": plain & familiar, "unfamiliar": plain & ~familiar, "login_words": login, "prompt_injection": injected}
    reasons = F.when(long, F.array(F.lit("overlong"))).when(short, F.array(F.lit("shortener"))).when(~other, F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()])))
    return df.withColumns({"risk": risk, "reasons": reasons}).drop("__host", "__to", "__platform", "__familiar", "__bad", "__bad_to")
