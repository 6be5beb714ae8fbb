"""Attachment checks over name, declared type and bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as T

# --- Fixed values -----------------------------------------------------------------------------------------
MAGIC = [
    ("4D5A", "application/x-dosexec"), ("7F454C46", "application/x-elf"), ("25504446", "application/pdf"), ("504B0304", "application/zip"), ("504B0506", "application/zip"),
    ("D0CF11E0A1B11AE1", "application/x-ole-storage"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"),
    ("2321", "text/x-shellscript"), ("CAFEBABE", "application/x-mach-binary"), ("CFFAEDFE", "application/x-mach-binary"), ("CEFAEDFE", "application/x-mach-binary"),
    ("377ABCAF271C", "application/x-7z-compressed"), ("526172211A07", "application/x-rar-compressed"), ("1F8B", "application/gzip"),
]
DANGEROUS = (
    "exe com jar lnk url scf scr pif application gadget msp msi cmd bat ps1 vbs js jse vbe wsf wsh hta docm xlsm pptm xls doc iso img vhd vhdx dotm xltm potm ppsm sldm ppam xlam xla xll xlm xlsb docb vsdm "
    "mpa accde one onepkg chm reg sct wsc slk iqy website library-ms search-ms settingcontent-ms theme mht mhtml cpl msc inf diagcab xbap appref-ms"
).split()
RUNNABLE = ["application/x-dosexec", "application/x-elf", "application/x-mach-binary", "text/x-shellscript"]
EXOTIC = ["message/external-body", "message/partial", "message/delivery-status", "message/disposition-notification"]
MEDIA_EXTENSIONS = "mp4 mov avi mkv webm mp3 wav m4a ogg flac aac wmv".split()
PDF_ACTIVE = ["/JavaScript", "/JS", "/OpenAction", "/AA", "/Launch"]
PDF_EMBEDDED = ["/EmbeddedFile", "/RichMedia", "/XFA", "/SubmitForm", "/ImportData"]
# ----------------------------------------------------------------------------------------------------------


def detected_type(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 12))
    out = F.when(head.startswith(MAGIC[0][0]), MAGIC[0][1])
    for sig, mime in MAGIC[1:]:
        out = out.when(head.startswith(sig), mime)
    low = F.lower(F.decode(F.substring(content, 1, 8192), "ISO-8859-1"))
    webp = head.startswith("52494646") & head.endswith("57454250")
    return out.when(webp, "image/webp").when(F.contains(low, F.lit("<svg")) | (F.contains(low, F.lit("<?xml")) & F.contains(low, F.lit("svg"))), "image/svg+xml")


def type_mismatch(declared: Column, detected: Column) -> Column:
    said = F.lower(F.coalesce(declared, F.lit("")))
    return F.coalesce(detected.isin(RUNNABLE), F.lit(False)) & ~T.any_of(said, ["dosexec", "x-elf", "mach-binary", "shellscript", "octet-stream"])


def polyglot(content: Column) -> Column:
    tail = F.decode(F.substr(content, F.greatest(F.lit(1), F.octet_length(content) - 65535)), "ISO-8859-1")
    marked = F.contains(tail, F.lit("PK\x03\x04")) | F.contains(tail, F.lit("PK\x05\x06"))
    return F.coalesce(detected_type(content).isin("image/jpeg", "image/png", "application/pdf"), F.lit(False)) & marked


def filename_risks(name: Column, declared: Column) -> dict[str, Column]:
    low = F.lower(name)
    stem = F.when(F.contains(name, F.lit(".")), F.regexp_extract(name, r"^(.*)\.", 1)).otherwise(name)
    base = F.trim(F.substring_index(F.lower(F.coalesce(declared, F.lit(""))), ";", 1))
    return {
        "dangerous_extension": F.substring_index(low, ".", -1).isin(DANGEROUS),
        "bidi_override": F.rlike(name, F.lit(r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]")),
        "control_chars": F.rlike(name, F.lit(r"[\x00-\x1F\x7F-\x{9F}]")),
        "stream_marker": F.contains(name, F.lit(":")),
        "trailing_dot_or_space": F.rlike(name, F.lit(r"[. ]$")),
        "mixed_script": F.rlike(name, F.lit(r"[\x{0370}-\x{03FF}\x{0400}-\x{052F}\x{1C80}-\x{1C8F}]")) & F.rlike(stem, F.lit("[A-Za-z]")),
        "nested_mail": low.endswith(".eml") | low.endswith(".msg") | F.lower(F.coalesce(declared, F.lit(""))).isin("message/rfc822", "application/vnd.ms-outlook"),
        "exotic_message": base.isin(EXOTIC),
    }


def _token(text: Column, tokens: list[str]) -> Column:
    return F.rlike(text, F.lit(rf"(?:{'|'.join(tokens)})(?![A-Za-z])"))


def pdf_markers(content: Column) -> dict[str, Column]:
    text = F.decode(content, "ISO-8859-1")
    return {"pdf_encrypted": _token(text, ["/Encrypt"]), "pdf_active": _token(text, PDF_ACTIVE), "pdf_embedded": _token(text, PDF_EMBEDDED)}


def metadata_risks(name: Column, content: Column) -> dict[str, Column]:
    ext, text, head = F.lower(F.substring_index(name, ".", -1)), F.decode(content, "ISO-8859-1"), F.hex(F.substring(content, 1, 4))
    field = lambda f: (ext == "pdf") & F.rlike(text, F.lit(rf"{f}\s*(?:\([^)]+\)|<[0-9A-Fa-f\s]*[0-9A-Fa-f][0-9A-Fa-f\s]*>)"))
    exif = ext.isin("jpg", "jpeg", "tif", "tiff", "heic") & head.startswith("FFD8") & F.contains(text, F.lit("Exif\x00\x00"))
    return {
        "pdf_author": field("/Author"),
        "pdf_creator": field("/Creator"),
        "exif_gps": exif & F.contains(text, F.lit("\x88%")),
        "exif_device": exif & (F.contains(text, F.lit("\x01\x0f")) | F.contains(text, F.lit("\x01\x10"))),
        "office_author": ext.isin("docx", "xlsx", "pptx") & (head == "504B0304") & F.rlike(text, F.lit(r"(?s)dc:creator[^>]*>[^<]+<")),
    }


def encrypted_zip(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """key, zip_encrypted: walks local headers by their sizes; the general flag's bit 0 marks an encrypted entry."""
    kind = dict(df.dtypes)[key]

    def walk(b: bytes | None) -> bool:
        at = 0 if b is None else b.find(b"PK\x03\x04")
        while b is not None and at >= 0 and at + 30 <= len(b):
            if b[at + 6] & 1:
                return True
            size = int.from_bytes(b[at + 18 : at + 22], "little")
            after = at + 30 + int.from_bytes(b[at + 26 : at + 28], "little") + int.from_bytes(b[at + 28 : at + 30], "little") + size
            at = b.find(b"PK\x03\x04", after if size and after <= len(b) else at + 4)
        return False

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "zip_encrypted": [walk(b) for b in pdf[content]]})

    return df.select(key, content).mapInPandas(run, f"`{key}` {kind}, zip_encrypted boolean")


def mime_depth(text: Column) -> Column:
    """Deepest nesting of multipart boundaries: a boundary parameter opens, a closing boundary line ends."""
    lines = F.split(text, "\n")
    state = F.struct(F.lit(0).alias("d"), F.lit(0).alias("best"))

    def step(a, x):
        x = F.rtrim(x)
        opens = F.rlike(F.lower(x), F.lit(r"content-type:\s*multipart/")).cast("int")
        closes = F.rlike(x, F.lit(r"^--.+--$")).cast("int")
        d = F.greatest(F.lit(0), a["d"] + opens - closes)
        return F.struct(d.alias("d"), F.greatest(a["best"], d).alias("best"))

    return F.aggregate(lines, state, step, lambda a: a["best"])


def scan(df: DataFrame, key: str = "id") -> DataFrame:
    """All checks of one attachment row: risks (array of names), detected type and is_dangerous."""
    name, declared, content = F.col("filename"), F.col("declared_mime"), F.col("content")
    df = df.withColumn("detected_mime", detected_type(content))
    checks = filename_risks(name, declared) | {"type_mismatch": type_mismatch(declared, F.col("detected_mime")), "polyglot": polyglot(content), "shortcut": F.hex(F.substring(content, 1, 8)) == "4C00000001140200"}
    checks |= pdf_markers(content) | metadata_risks(name, content)
    risks = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    hard = ["dangerous_extension", "bidi_override", "type_mismatch", "polyglot", "shortcut", "pdf_active", "exotic_message"]
    return df.withColumn("risks", risks).withColumn("is_dangerous", F.arrays_overlap("risks", F.array(*[F.lit(h) for h in hard])))


def roll_up(scanned: DataFrame, key: str = "msg_id") -> DataFrame:
    return scanned.groupBy(key).agg(F.count("*").alias("n_attachments"), F.count_if("is_dangerous").alias("n_dangerous"), F.sum(F.size("risks")).alias("n_risks"))


def media_advisory(attachments: DataFrame, bodies: DataFrame) -> DataFrame:
    """msg_id, filename, severity of audio and video attachments; severity from money and haste in the body."""
    media = F.substring_index(F.lower("filename"), ".", -1).isin(MEDIA_EXTENSIONS) | F.coalesce(F.rlike("declared_mime", F.lit("^(audio|video)/")), F.lit(False))
    forms = T.both_forms(F.col("body"))
    flags = bodies.select("msg_id", T.any_of(forms, lx.FINANCIAL).alias("money"), T.any_of(forms, lx.VERIFY_URGENCY).alias("haste"))
    severity = F.when(F.col("money") & F.col("haste"), "high").when(F.col("money") | F.col("haste"), "medium").otherwise("low")
    return attachments.where(media).join(flags, "msg_id", "left").select("msg_id", "filename", severity.alias("severity"))
