"""Scans of HTML, SVG and style sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as T

# --- Fixed values -----------------------------------------------------------------------------------------
CAPTCHA = ["verify you are human", "i am not a robot", "click the box", "captcha", "ロボットではありません", "人間であることを確認"]
MADE_LINK = ['createelement("a")', "createelement('a')", "createelement(`a`)"]
BLOB_URIS = ["url.createobjecturl", "blob:"]
DECODERS = ["atob(", "frombase64", "textdecoder", "uint8array.from"]
SHELLS = ["mshta", "powershell", "cmd.exe", "wscript", "cscript"]
OBFUSCATION = ["unescape(", "decodeuricomponent(", "string.fromcharcode(", "charcodeat(", r"\x", r"\u00"]
EXECUTABLES = ["data:application/x-msdownload", "data:application/octet-stream", "data:application/x-executable", "data:application/bat"]
CLIPBOARD = ["navigator.clipboard.write", "clipboarddata.setdata", 'execcommand("copy")', "execcommand('copy')", "execcommand(`copy`)"]
RUN_LURES = [
    "win+r", "win + r", "windows+r", "windows + r", "windows key", "press the windows", "run dialog", "open run", "ファイル名を指定して実行", "コマンドプロンプトを開", "ターミナルを開",
    "address bar", "アドレスバー", "エクスプローラー", "ctrl+v", "ctrl + v", "press ctrl", "paste into", "paste it in", "paste the copied", "copy-paste", "貼り付け",
    "to verify", "verify yourself", "prove you are human", "fix this problem", "complete the verification",
]
TRACKERS = [
    "mailchimp.com", "list-manage.com", "salesforce.com", "pardot.com", "exacttarget.com", "sendgrid.net", "sendgrid.com", "mailgun.org",
    "mandrillapp.com", "klaviyo.com", "constantcontact.com", "campaignmonitor.com", "getresponse.com", "aweber.com", "hubspot.com", "marketo.com",
    "eloqua.com", "google-analytics.com", "analytics.google.com", "doubleclick.net", "facebook.com", "fb.com", "linkedin.com", "twitter.com",
    "mailtrack.io", "streak.com", "yesware.com", "boomeranggmail.com", "mixmax.com", "outreach.io", "salesloft.com", "groove.co", "cirrusinsight.com",
    "blastmail.jp", "cuenote.jp", "wowma.jp",
]
TRACKING_PATTERNS = ["/track/", "/pixel/", "/open/", "/click/", "/beacon/", "track=", "pixel=", "open=", "utm_", "trk=", "/t/", ".gif?", "tracking", "analytics"]
SVG_HANDLERS = ["onload", "onerror", "onclick", "onmouseover", "onfocus", "onanimationstart", "onbegin", "onend", "onrepeat", "onactivate"]
SVG_ENCODED = ["base64,", "atob(", "fromcharcode"]
SVG_ENTITIES = ["<!doctype", "<!entity"]
SVG_SCHEMES = ["javascript:", "vbscript:", "data:text/html"]
HIDDEN = [
    "display=\"none\"", "display='none'", "display: none", "display:none", "visibility=\"hidden\"", "visibility='hidden'", "visibility: hidden",
    "visibility:hidden", "opacity=\"0\"", "opacity='0'", "opacity: 0", "opacity:0", "font-size=\"0\"", "font-size='0'", "font-size: 0", "font-size:0",
]
# ----------------------------------------------------------------------------------------------------------


def smuggling(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds one flag a signal, n_signals and risk: clean, caution, high or critical."""
    df = df.withColumn("__low", F.lower(F.col(html)))
    low = F.col("__low")
    made_link = T.any_of(low, MADE_LINK)
    comments = F.regexp_extract_all(html, F.lit(r"(?s)(<!--.*?(?:-->|$))"), 1)
    size = F.octet_length(html)
    flags = {
        "blob_uri": T.any_of(low, BLOB_URIS),
        "base64_eval": T.any_of(low, DECODERS),
        "auto_download": made_link & F.contains(F.regexp_replace(low, r"\s", ""), F.lit(".click()")),
        "fake_captcha": T.any_of(low, CAPTCHA),
        "shell": T.any_of(low, SHELLS),
        "obfuscation": T.count_of(low, OBFUSCATION) >= 2,
        "data_executable": T.any_of(low, EXECUTABLES),
        "clipboard": T.any_of(low, CLIPBOARD),
        "run_lure": T.any_of(low, RUN_LURES),
        "comment_padding": (size >= 16384) & (F.aggregate(comments, F.lit(0).cast("long"), lambda s, c: s + F.octet_length(c)) * 2 >= size),
    }
    out = df.withColumns(flags).withColumn("n_signals", sum((F.col(k).cast("int") for k in flags), F.lit(0)))
    c = F.col
    critical = (c("blob_uri") & c("auto_download")) | c("shell") | c("data_executable") | (c("run_lure") & (c("clipboard") | c("fake_captcha")))
    risk = F.when(c("n_signals") == 0, "clean").when(critical, "critical").when(c("blob_uri") | c("base64_eval") | (c("n_signals") >= 2), "high").otherwise("caution")
    return out.withColumn("risk", risk).drop("__low")


def _attr(tag: Column, name: str) -> Column:
    double = F.regexp_extract(tag, rf'(?s)(?:^|\s){name}="([^"]*)"', 1)
    single = F.regexp_extract(tag, rf"(?s)(?:^|\s){name}='([^']*)'", 1)
    return F.when(F.rlike(tag, F.lit(rf'(?s)(?:^|\s){name}="')), double).when(F.rlike(tag, F.lit(rf"(?s)(?:^|\s){name}='")), single)


def tracking_pixels(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, src, domain, kind of images that track: by size, by host, by the pattern of their address."""
    tags = df.select(key, F.explode(F.regexp_extract_all(html, F.lit(r"(?s)(<img[^>]*(?:>|$))"), 1)).alias("tag"))
    src = tags.select(key, _attr(F.col("tag"), "src").alias("src"), _attr(F.col("tag"), "width").alias("w"), _attr(F.col("tag"), "height").alias("h"))
    src = src.where(F.rlike("src", F.lit("^https?://"))).withColumn("domain", F.lower(F.regexp_extract("src", "^https?://([^/:]*)", 1)))
    size = lambda n: F.col("w").try_cast("int").eqNullSafe(n) & F.col("h").try_cast("int").eqNullSafe(n)
    known = F.exists(F.array(*[F.lit(t) for t in TRACKERS]), lambda t: (F.col("domain") == t) | F.endswith(F.col("domain"), F.concat(F.lit("."), t)))
    kind = F.when(size(1) | size(0), "open_tracking").when(known, "marketing_platform").when(T.any_of(F.lower("src"), TRACKING_PATTERNS), "open_tracking")
    return src.withColumn("kind", kind).where("kind IS NOT NULL").select(key, "src", "domain", "kind")


def svg(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds flags of the SVG risks and safe (nothing that executes or injects)."""
    df = df.withColumn("__c", F.col(content)).withColumn("__low", F.lower("__c"))
    low = F.col("__low")
    visible = F.array_join(
        F.concat(
            F.flatten(F.array(*[F.regexp_extract_all("__c", F.lit(rf"(?is)<{t}[^>]*>(.*?)</{t}"), 1) for t in ("title", "desc", "text", "tspan")])),
            F.regexp_extract_all("__c", F.lit(r"(?s)<!--(.*?)-->"), 1),
            F.regexp_extract_all("__c", F.lit(r"(?s)<!\[CDATA\[(.*?)\]\]>"), 1),
        ),
        "\n",
    )
    df = df.withColumn("__v", visible).withColumn("__n", T.normalise(F.col("__v"), True)).withColumn("__s", T.normalise_spaced(F.col("__v"), True))
    out = df.withColumns(
        {
            "script": F.contains(low, F.lit("<script")),
            "handler": F.rlike(low, F.lit(rf"(?:{'|'.join(SVG_HANDLERS)})\s*=")),
            "scheme": T.any_of(low, SVG_SCHEMES),
            "foreign_object": F.contains(low, F.lit("<foreignobject")),
            "external": F.rlike(low, F.lit(r"""href=["']http""")),
            "encoded": T.any_of(low, SVG_ENCODED),
            "entity": T.any_of(low, SVG_ENTITIES),
            "hidden": T.any_of(low, HIDDEN),
            "injection": T.any_of([F.col("__n"), F.col("__s")], [p.lower() for p in lx.OVERRIDE_PHRASES]) | T.any_of(F.col("__n"), [t.lower() for t in lx.SPECIAL_TOKENS]),
        }
    )
    c = F.col
    return out.withColumn("safe", ~(c("script") | c("handler") | c("scheme") | c("foreign_object") | c("encoded") | c("entity") | c("injection"))).drop("__c", "__low", "__v", "__n", "__s")


CSS_URL = r"""(?i)url *\((?!\s*["']?(?:data:|about:|cid:|#|["']?\s*\)))[^)]*\)"""


def clean_css(df: DataFrame, css: str = "css") -> DataFrame:
    """Adds sanitized and removed: comments, import, expression and binding lines go; outside addresses become blank."""
    bare = F.regexp_replace(css, r"(?s)/\*.*?\*/", " ")
    lines = F.split(F.regexp_replace(bare, r"\n$", ""), "\n")
    bad = lambda x: F.rlike(F.lower(x), F.lit(r"@import|expression\(|-moz-binding|^\s*behavior"))
    kept = F.array_join(F.filter(lines, lambda x: ~bad(x)), "\n")
    return df.withColumn("__k", kept).withColumn("sanitized", F.regexp_replace("__k", CSS_URL, "url(about:blank)")).withColumn("removed", F.size(F.filter(lines, bad)) + F.regexp_count("__k", F.lit(CSS_URL))).drop("__k")
