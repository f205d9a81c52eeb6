"""Web archive derivatives: linked metadata and plain-text conversion records of response records.

Each response gives a metadata record (source headers, title, links, digests) and, when its payload is text, a conversion record.
Both name the response in refers_to, and carry its target URI, date and payload digest. Record ids are derived from the response's id and the record
type, so a repeated run names the same records. Records are read and written with Spark's text source, whose line separator can be a record's.
"""
import base64
import hashlib
import html
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadtide.llm.common import map_batches, ship

VERSION = "WARC/1.1"
RECORD = ("warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, "
          "payload_digest string, content string")
#: Elements whose content is no text (beside the head), and elements that end a line of text.
DROPPED = ("script", "style", "noscript", "template", "svg", "title")
BLOCKS = frozenset("address article aside blockquote br caption dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol "
                   "option p pre section table tbody td tfoot th thead title tr ul".split())
COMMENT = r"<!--.*?(?:-->|\Z)"
ATTRIBUTES = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"


def _whole(name, tags):
    return rf"<(?P<{name}>{tags})(?=[\s/>])[^>]*+>.*?(?:</(?P={name})\s*+>|\Z)"


#: A head ends at its end tag or, like a browser's, before the first text or element that can't stand in it.
HEAD = (rf"<head(?=[\s/>])[^>]*+>(?:\s++|{COMMENT}|<[!?][^>]*+>|{_whole('inner', 'script|style|noscript|template|title|noframes')}"
        rf"|<(?:base|basefont|bgsound|link|meta|head|html)(?=[\s/>]){ATTRIBUTES}>|</(?!(?:head|body|html|br)[\s>])[a-z][^>]*+>)*+(?:</head\s*+>)?")
#: A self-closing svg is empty.
DROP = re.compile(rf"{COMMENT}|<svg(?=[\s/>]){ATTRIBUTES}(?<=/)>|{HEAD}|{_whole('outer', '|'.join(DROPPED))}", re.S | re.I)
TITLE = re.compile(r"<title(?=[\s>])[^>]*+>(.*?)(?:</title\s*+>|\Z)", re.S | re.I)
TAG = re.compile(r"<(?:/?([a-zA-Z][a-zA-Z0-9]*+)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[!?][^>]*+>)")
LINK = re.compile(r"<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
BLANK = re.compile(r"[ \t\r\f\v\xa0]+")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(response_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{kind} {response_id}'.encode()).digest(), version=4)}>"


def plain_text(page: str) -> str:
    """Text of a page: a line for each block, blanks collapsed, no empty lines."""
    body = TAG.sub(lambda m: "\n" if m[1] and m[1].lower() in BLOCKS else "", DROP.sub(" ", page.replace("\n", " ")))
    lines = (BLANK.sub(" ", html.unescape(x)).replace("\n", " ").strip() for x in body.split("\n"))
    return "\n".join(x for x in lines if x)


def title_of(page: str) -> str:
    m = TITLE.search(page)
    return " ".join(html.unescape(m[1]).split()) if m else ""


def parse_http(block: bytes):
    """Status line, headers in order, payload. Without an end of headers everything is payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    return status, [tuple(p.strip() for p in x.partition(":")[::2]) for x in lines if ":" in x], payload


def decoded(headers: dict, payload: bytes) -> str:
    """Payload as text: content coding taken off, charset by header, then by the page, else UTF-8."""
    coding = headers.get("content-encoding", "").lower()
    try:
        if coding in ("gzip", "x-gzip"):
            payload = zlib.decompress(payload, 31)
        elif coding == "deflate":
            payload = zlib.decompress(payload)
    except zlib.error:
        pass                                                         # a broken coding: the bytes as they are
    # Twice the 1024 bytes in which HTML lets a page declare its encoding; readers look no further.
    m = CHARSET.search(headers.get("content-type", "").encode("latin-1", "replace")) or CHARSET.search(payload[:2048])
    try:
        return payload.decode(m[1].decode() if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def clean_line(s: str) -> str:
    return " ".join(s.split())


def derive(record_id: str, uri: str, date: str, block: bytes, known_digest: str | None) -> list:
    """Rows of the metadata record and the conversion record of one response."""
    status, headers, payload = parse_http(block or b"")
    named = {k.lower(): v for k, v in headers}
    kind = named.get("content-type", "text/html").split(";")[0].strip().lower()
    source = known_digest or digest(payload)
    fields, rows = [], []
    if status:
        fields.append(("http-status", clean_line(status)))
    fields += [(f"http-header-{k.lower()}", clean_line(v)) for k, v in headers]
    fields.append(("payload-digest", source))
    text = None
    if kind.startswith("text/") or kind in ("application/xhtml+xml", "application/xml"):
        page = decoded(named, payload)
        is_page = kind in ("text/html", "application/xhtml+xml")
        text = plain_text(page) if is_page else page
        if is_page:
            title = title_of(page)
            fields += [("title", title)] if title else []
            fields += [("outlink", clean_line(html.unescape(next(x for x in m.groups() if x is not None)))) for m in LINK.finditer(DROP.sub(" ", page))]
            text = f"{title}\n{text}" if title and text else title or text
        fields.append(("conversion", derived_id(record_id, "conversion")))
        fields.append(("conversion-digest", digest(text.encode("utf-8", "replace"))))
    content = "".join(f"{k}: {v}\r\n" for k, v in fields)
    rows.append(("metadata", derived_id(record_id, "metadata"), record_id, uri, date, "application/warc-fields", digest(content.encode()), source, content))
    if text is not None:
        rows.append(("conversion", derived_id(record_id, "conversion"), record_id, uri, date, "text/plain; charset=UTF-8",
                     digest(text.encode("utf-8", "replace")), source, text))
    return rows


def derivatives(responses: DataFrame) -> DataFrame:
    """The RECORD columns: metadata and conversion records of ``responses`` (record_id, target_uri, date, block as binary, payload_digest or null).

    Other columns are ignored. Rows without a record_id have nothing to refer to and give none. A null block is an empty one: its
    conversion is empty. Repeated rows give repeated records. A payload that is no text has a metadata record only.
    """
    def run(batch):
        rows = [r for x in zip(*(batch.column(i).to_pylist() for i in range(5))) for r in derive(*x)]
        return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

    names = [c.split()[0] for c in RECORD.split(", ")]
    cols = responses.filter("record_id IS NOT NULL").select("record_id", "target_uri", "date", "block", "payload_digest")
    return map_batches(cols, run, RECORD)


def responses_from_pages(pages: DataFrame, date: str) -> DataFrame:
    """Response records of crawled pages (page_id, url, html). The table has no crawl time, so the caller names one for all."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    h = F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("-"))))
    dashed = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return pages.select(F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
                        F.concat(F.encode(head, "UTF-8"), body).alias("block"), F.lit(None).cast("string").alias("payload_digest"))


HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
           "content_type": "Content-Type", "block_digest": "WARC-Block-Digest", "payload_digest": "WARC-Payload-Digest"}


def write_records(records: DataFrame, path: str, compression: str = "none") -> None:
    """Write records with text content as archive files, one a partition. Content and headers are UTF-8."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c))) for c, name in HEADERS.items() if c in records.columns]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(F.coalesce("content", F.lit(""))).cast("string"))
    head = F.concat_ws("\r\n", F.lit(VERSION), *lines, size)
    records.select(F.concat(head, F.lit("\r\n\r\n"), F.coalesce("content", F.lit(""))).alias("value")).write.text(path, compression=compression, lineSep="\r\n\r\n")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """RECORD columns of archive files, block (the content's bytes) and complete.

    Records are split where a version line starts. One whose content holds such a line, or is cut short, has less content than its length says: complete is false.
    """
    raw = spark.read.text(path, lineSep=VERSION + "\r\n").filter("length(value) > 0")
    value = F.col("value")
    head = F.substring_index(value, "\r\n\r\n", 1)
    size = F.regexp_extract(head, r"(?im)^content-length:[ \t]*(\d+)", 1).cast("long")
    block = F.substring(value.cast("binary"), F.octet_length(head) + 5, size.cast("int"))
    fields = [F.nullif(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit("")).alias(c) for c, name in HEADERS.items()]
    return raw.select(*fields, F.decode(block, "UTF-8").alias("content"), block.alias("block"), (F.octet_length(block) == size).alias("complete"))


ship(__name__)
