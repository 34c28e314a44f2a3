"""Raw messages to rows."""

from __future__ import annotations

import re
from datetime import UTC
from email import message_from_bytes, policy
from email.header import decode_header, make_header
from email.utils import parseaddr, parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from lectern.functions import text
from lectern.functions.vector import vectorised

MESSAGE = "struct<from_addr:string,from_name:string,subject:string,message_id:string,raw_html:string,body_text:string,received_at:string,attachments:array<struct<filename:string,content_type:string,size:int>>,links:array<string>>"
#: The largest message taken in.
MOST_BYTES = 25 << 20
_LINK = re.compile(text.LINK, re.ASCII)


def sender(given: str) -> tuple[str, str]:
    """Address and name of a sender's text; a text that is no address stands for itself."""
    name, address = parseaddr(given)
    return (address, name) if re.fullmatch(r"[^@\s]+@[^@\s]+", address) else (given.strip(), "")


def parse(raw: bytes) -> dict | None:
    """The first HTML and the first plain text part, attachments' data, and the links of the markup or else the text; None if there
    are no headers. A sender that is no address is kept as it stands; the date is in UTC."""
    m = message_from_bytes(raw, policy=policy.compat32)
    if not m.keys():
        return None
    try:
        subject = str(make_header(decode_header(m.get("Subject", ""))))
    except Exception:
        subject = m.get("Subject", "")
    html = plain = ""
    attachments = []
    for part in m.walk():
        if part.is_multipart():
            continue
        body = part.get_payload(decode=True) or b""
        if part.get_filename() or part.get_content_disposition() == "attachment":
            attachments.append({"filename": part.get_filename() or "", "content_type": part.get_content_type(), "size": len(body)})
        elif part.get_content_type() == "text/html" and not html:
            html = body.decode(errors="replace")
        elif part.get_content_type() == "text/plain" and not plain:
            plain = body.decode(errors="replace")
    address, name = sender(m.get("From", ""))
    try:
        date = parsedate_to_datetime(m["Date"]) if m["Date"] else None
        date = date and date.replace(tzinfo=date.tzinfo or UTC).astimezone(UTC).isoformat()
    except (TypeError, ValueError):
        date = None
    found = dict.fromkeys(u.rstrip(".,);") for u in _LINK.findall(html or plain))
    return {"from_addr": address, "from_name": name, "subject": subject, "message_id": re.sub("^<|>$", "", m.get("Message-ID", "").strip()), "raw_html": html, "body_text": plain, "received_at": date, "attachments": attachments, "links": list(found)[:50]}


@vectorised(MESSAGE)
def parse_udf(x: pd.Series) -> pd.DataFrame:
    empty = dict.fromkeys(("from_addr", "from_name", "subject", "message_id", "raw_html", "body_text", "received_at", "attachments", "links"))
    return pd.DataFrame([parse(bytes(v)) or empty for v in x], columns=list(empty))


def read(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """Messages from files, a file each; larger ones are left out before they are read."""
    return parsed(spark.read.format("binaryFile").load(path), most)


def parsed(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Messages from rows of files (path, length, content), of a table or a stream."""
    read = files.filter(F.col("length") <= most).select("path", parse_udf("content").alias("m"))
    return read.filter("m.from_addr is not null").select("path", "m.*")


@vectorised("struct<from_addr:string,from_name:string>")
def sender_udf(x: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([sender(v or "") for v in x], columns=["from_addr", "from_name"])


def drops(rows: DataFrame) -> DataFrame:
    """Messages from rows of html, subject, from, from_name, message_id, received_at. Without html, or with a time that has not
    date, time and zone, they are left out; a given name comes before the one in the sender."""
    time = text.time_bound(F.col("received_at"))
    full = (F.coalesce(text.stripped(F.col("html")), F.lit("")) != "") & (F.coalesce("received_at", F.lit("")) == "") | (text.stripped(F.col("html")) != "") & F.col("received_at").contains("T") & time.isNotNull()
    named = rows.filter(full).withColumn("_who", sender_udf("from"))
    name = F.coalesce(F.nullif("from_name", F.lit("")), F.col("_who.from_name"))
    return named.select(F.col("_who.from_addr").alias("from_addr"), name.alias("from_name"), "subject", "message_id", F.col("html").alias("raw_html"), F.lit("").alias("body_text"), time.alias("received_at"))


def read_drops(spark: SparkSession, path: str) -> DataFrame:
    """HTML drops as JSON lines."""
    return drops(spark.read.schema("html string, subject string, `from` string, from_name string, message_id string, received_at string").json(path))


#: Extensions of files with markup and with text. Fixed values.
MARKUP, PLAIN = (".html", ".htm"), (".txt", ".md", ".markdown", ".text")


def read_fixtures(spark: SparkSession, path: str, most: int = 24_000) -> DataFrame:
    """Files of a folder by name: source name, kind (html or text) and the body as it is scored."""
    files = spark.read.text(f"{path}/*", wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value"))
    ending = F.lower(F.regexp_extract("file", r"(\.[^.]*)\z", 1))
    kept = files.withColumn("kind", F.when(ending.isin(*MARKUP), "html").when(ending.isin(*PLAIN), "text")).filter("kind is not null")
    body = F.when(F.col("kind") == "html", text.clean_html(F.col("value"), most)).otherwise(text.truncate(text.collapse(F.col("value")), most))
    return kept.select("file", text.source_title(F.col("file")).alias("source_name"), "kind", body.alias("body")).orderBy("file")
