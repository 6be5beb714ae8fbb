"""Mail files: a folder of raw messages as rows, with failures kept apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "path string, error string, message_id string, in_reply_to string, from_addr string, reply_to string, return_path string, to_addrs array<string>, subject string, body string, html string, spf string, dkim string, dmarc string, arc string, "
    "dkim_header string, attachments array<struct<filename:string,declared_mime:string,content:binary>>"
)


def _verdict(results: str, name: str) -> str:
    """One method's result in the authentication header; none if it is not named, or has none."""
    low = results.lower()
    at = low.find(f"{name}=")
    words = low[at + len(name) + 1 :].split(";")[0].split() if at >= 0 else []
    return words[0] if words else "none"


def _addresses(fields: list) -> list[str]:
    """Addresses of the recipient fields, with names where they have one; a comma inside quotes parts nothing."""
    from email.utils import getaddresses

    pairs = [(name.strip(), address.strip()) for name, address in getaddresses([str(f) for f in fields], strict=False)]
    quoted = lambda n: '"' + n.replace("\\", "\\\\").replace('"', '\\"') + '"' if any(c in n for c in ',;:<>@"()[]\\') else n
    return [f"{quoted(name)} <{address}>" if name else address for name, address in pairs if address]


def _text(part) -> str | None:
    """A text part, decoded; an unknown or wrong charset is read as UTF-8 with replacements."""
    if part is None:
        return None
    try:
        return part.get_content()
    except (LookupError, UnicodeError, ValueError):
        return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")


def _parse(path: str, raw: bytes) -> dict:
    from email import message_from_bytes, policy

    m = message_from_bytes(raw, policy=policy.default)
    if not m.keys():
        raise ValueError("no header lines")
    results = " ; ".join(str(h) for h in m.get_all("Authentication-Results", []))
    parts = [p for p in m.walk() if not p.is_multipart()]
    text = next((p for p in parts if p.get_content_type() == "text/plain" and not p.get_filename()), None)
    html = next((p for p in parts if p.get_content_type() == "text/html" and not p.get_filename()), None)
    files = [{"filename": p.get_filename() or "", "declared_mime": p.get_content_type(), "content": p.get_payload(decode=True) or b""} for p in parts if p.get_filename()]
    one = lambda k: None if m[k] is None else str(m[k])
    return {
        "path": path, "error": None, "message_id": one("Message-ID"), "in_reply_to": one("In-Reply-To"), "from_addr": one("From"), "reply_to": one("Reply-To"), "return_path": one("Return-Path"),
        "to_addrs": _addresses(m.get_all("To", [])), "subject": one("Subject"), "body": _text(text), "html": _text(html),
        "spf": _verdict(results, "spf"), "dkim": _verdict(results, "dkim"), "dmarc": _verdict(results, "dmarc"), "arc": _verdict(results, "arc"), "dkim_header": one("DKIM-Signature"), "attachments": files,
    }


def parse_mail(files: DataFrame) -> DataFrame:
    """Rows of :data:`SCHEMA` from (path, content); a file that can't be read becomes a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append(_parse(path, raw))
                except Exception as e:  # a bad file must not stop the folder
                    rows.append(dict.fromkeys(names) | {"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def read_mail(spark: SparkSession, folder: str, pattern: str = "*.eml") -> tuple[DataFrame, DataFrame]:
    """Messages, and failures as (path, error). Files of no length are left out by the file source itself.

    Parsed rows are kept on the executors' disks, so that both outputs share one parse; what is lost is parsed again.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    rows = parse_mail(files).persist(StorageLevel.DISK_ONLY)
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("path", "error")


def attachments(messages: DataFrame, key: str = "path") -> DataFrame:
    """One row an attachment: key, filename, declared_mime, content, size_bytes."""
    out = messages.select(F.col(key), F.explode("attachments").alias("a")).select(key, "a.*")
    return out.withColumn("size_bytes", F.octet_length("content"))
