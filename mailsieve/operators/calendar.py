"""Calendar invites as lines: property findings, level, and sequence regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as T

# --- Fixed values -----------------------------------------------------------------------------------------
URGENCY = ["account suspended", "verify now", "immediate action required", "your account will be deleted", "click to confirm", "password expiring", "アカウントが停止", "至急確認"]
RELAYS = ["forms.gle", "docs.google.com/forms", "docs.google.com/drawings", "docs.google.com/presentation", "drive.google.com", "forms.office.com", "sway.office.com", "1drv.ms"]
REDIRECTS = ["url=http", "dest=http", "to=http", "link=http", "redirect=http", "r=http", "next=http", "continue=http"]
FREE_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".click", ".download"]
IMITATIONS = ["amaz0n", "paypa1", "g00gle", "micr0soft", "0ffice365"]
BRANDS = ["microsoft.com", "google.com", "zoom.us", "teams.microsoft.com"]
FREE_PROVIDERS = ["gmail.com", "yahoo.com", "hotmail.com", "outlook.com", "qq.com"]
SPOOF_METHODS = ["CANCEL", "REPLY", "DECLINE", "COUNTER", "DECLINECOUNTER", "REFRESH", "ADD"]
# ----------------------------------------------------------------------------------------------------------


def suspicious_url(url: Column) -> Column:
    low = F.lower(url)
    host = F.regexp_extract(low, r"^(?:https?://)*([^/?]*)", 1)
    relay = (T.any_of(low, RELAYS) & T.any_of(F.regexp_extract(low, r"(\?.*)$", 1), REDIRECTS)) | F.contains(low, F.lit("docs.google.com/drawings"))
    fake = F.lit(False)
    for b in BRANDS:
        fake = fake | (F.contains(low, F.lit(b)) & ~host.endswith(b) & (host != ""))
    return relay | T.any_of(low, FREE_TLDS) | T.any_of(low, IMITATIONS) | fake


def scan(df: DataFrame, ics: str = "ics") -> DataFrame:
    """Adds risks (array of kinds) and level: safe, caution or danger."""
    lines = F.transform(F.split(F.col(ics), "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"\r$", "")))
    df = df.withColumn("__l", lines)
    L = F.col("__l")
    first = lambda field: F.get(F.transform(F.filter(L, lambda x: F.upper(x).startswith(f"{field}:")), lambda x: F.trim(F.substr(x, F.lit(len(field) + 2)))), F.lit(0))
    value = lambda x: F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1))
    direct = F.transform(F.filter(L, lambda x: F.rlike(F.upper(F.trim(x)), F.lit("^(?:URL[:;]|ATTACH;)"))), value)
    inline = F.transform(F.filter(L, lambda x: F.rlike(F.upper(F.trim(x)), F.lit("^(?:DESCRIPTION|LOCATION):"))), lambda x: F.regexp_extract(x, r"(http\S*)", 1))
    urls = F.filter(F.concat(direct, inline), lambda u: u.startswith("http"))
    organizer = F.get(F.filter(L, lambda x: F.upper(x).startswith("ORGANIZER")), F.lit(0))
    mail = F.when(F.contains(F.lower(organizer), F.lit("mailto:")), F.trim(F.regexp_extract(F.lower(organizer), r'mailto:([^"]*)', 1))).otherwise(F.lower(organizer))
    words = F.lower(F.concat_ws(" ", first("DESCRIPTION"), first("SUMMARY")))
    meeting = [first(f) for f in ("CONFERENCE", "LOCATION", "X-GOOGLE-CONFERENCE", "X-ZOOM-JOIN-URL")]
    binary = F.exists(L, lambda x: F.contains(F.upper(x), F.lit("ATTACH")) & F.contains(F.upper(x), F.lit("ENCODING=BASE64")) & F.contains(F.upper(x), F.lit("VALUE=BINARY")) & (value(x) != ""))
    cn = lambda x: F.regexp_extract(x, r'(?i);CN=(?:"([^"]*)"|([^;:]*))', 0)
    unc = F.exists(L, lambda x: F.rlike(F.upper(x), F.lit("^(?:ATTENDEE|ORGANIZER)")) & (F.contains(cn(x), F.lit("\\\\")) | F.contains(cn(x), F.lit("//"))))
    screened = F.concat_ws("\n", first("DESCRIPTION"), first("SUMMARY"))
    injected = T.any_of(T.both_forms(screened, True), [p.lower() for p in lx.OVERRIDE_PHRASES]) | T.any_of(T.normalise(screened, True), [t.lower() for t in lx.SPECIAL_TOKENS])
    method = F.upper(first("METHOD"))
    leading = F.size(F.filter(F.slice(L, 1, F.greatest(F.lit(0), F.coalesce(F.array_position(F.transform(L, lambda x: x.startswith("BEGIN:VCALENDAR")), True), F.lit(0)).cast("int") - 1)), lambda x: (x != "") & ~F.rlike(x, F.lit("^[ \t]"))))
    broken = F.exists(L, lambda x: F.upper(x).startswith("X-") & (~F.contains(x, F.lit(":")) | F.exists(F.slice(F.split(F.regexp_extract(x, "^([^:]*)", 1), ";"), 2, 1000), lambda p: (F.trim(p) != "") & ~F.contains(p, F.lit("=")))))
    attach = F.exists(L, lambda x: F.upper(F.trim(x)).startswith("ATTACH") & (F.contains(F.upper(x), F.lit("VALUE=URI")) | value(x).startswith("http")) & (value(x) != "") & ~F.upper(value(x)).startswith("CID:"))
    found = {
        "suspicious_url": F.exists(urls, suspicious_url),
        "suspicious_organizer": F.coalesce(F.array_contains(F.transform(F.array(*[F.lit(p) for p in FREE_PROVIDERS]), lambda p: F.endswith(mail, p)), True), F.lit(False)),
        "urgency": T.any_of(words, URGENCY),
        "meeting_link": F.coalesce(F.exists(F.array_compact(F.array(*meeting)), lambda u: u.startswith("http") & suspicious_url(u)), F.lit(False)),
        "binary_attachment": binary,
        "unc_path": unc,
        "prompt_injection": injected,
        "malformed": (leading > 0) | broken,
        "external_attach": attach,
        "method_spoof": F.coalesce(method.isin(SPOOF_METHODS), F.lit(False)),
    }
    out = df.withColumns({f"__{k}": F.coalesce(v, F.lit(False)) for k, v in found.items()})
    companions = [F.col(f"__{k}") for k in ("suspicious_url", "suspicious_organizer", "urgency", "meeting_link", "binary_attachment", "unc_path", "prompt_injection")]
    any_ = companions[0]
    for c in companions[1:]:
        any_ = any_ | c
    risks = F.array_compact(F.array(*[F.when(F.col(f"__{k}"), F.lit(k)) for k in found], F.when(F.coalesce(method.isin("REQUEST", "PUBLISH"), F.lit(False)) & any_, F.lit("auto_registration"))))
    hard = ["suspicious_url", "meeting_link", "unc_path", "binary_attachment", "auto_registration", "prompt_injection"]
    level = F.when(F.size("risks") == 0, "safe").when(F.arrays_overlap("risks", F.array(*[F.lit(h) for h in hard])), "danger").otherwise("caution")
    return out.withColumn("risks", risks).withColumn("level", level).drop("__l", *(f"__{k}" for k in found))


def sequence_regressions(events: DataFrame) -> DataFrame:
    """uid, ts, sequence, known of events whose sequence lies below the highest one before (ties by id)."""
    before = Window.partitionBy("uid").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("known", F.max("sequence").over(before)).where("known > 0 AND sequence < known")
