"""WARC derivatives: metadata and plain-text conversion records made from response records.

``responses`` turns pages into response records (WARC/1.1, ISO 28500); ``derive`` makes of each response a metadata record
(its payload is JSON: HTTP status and headers, title, language, links) and a conversion record (text/plain). Both refer
to the response by WARC-Refers-To, with its target URI, date and digest preserved, and carry block digests of their own.
Record ids are name-based UUIDs of the content, so a repeated or retried task writes the same records.
``write`` stores the records, one row per file member, and ``read`` parses them back from their bytes.

Defined cases: null html is an empty payload; a null URL gives an empty target URI; malformed HTML is read as browsers do,
but that an unclosed svg, template or noscript hides nothing; repeated pages give repeated records with equal ids; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.session import scratch_path

#: Elements whose content is not text, those without tags inside, and those that end a line.
HIDDEN = frozenset(("noscript", "template", "svg"))
RAW = ("script", "style", "title", "textarea")
BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table td th title tr ul".split())
EPOCH = "2024-01-01T00:00:00Z"
RECORD = "page_id long, kind string, record_id string, record binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324 - the format's usual digest


def record_id(kind: str, *parts: bytes) -> str:
    h = hashlib.sha256(kind.encode())
    for p in parts:
        h.update(len(p).to_bytes(8, "little") + p)
    return f"<urn:uuid:{uuid.UUID(bytes=h.digest()[:16], version=5)}>"


def build(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record: version, headers, block and the two closing line ends."""
    lines = ["WARC/1.1", *(f"{k}: {_one_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(headers["Content-Length"])
    if len(rest) < n + 4 or rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value) if "\n" in value or "\r" in value else value


#: Attributes of a tag; quotes count after ``=`` only.
_INSIDE = r"((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)"
#: A comment, another declaration or bogus comment, an element without tags inside, or a tag.
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    rf"|<({'|'.join(RAW)})(?=[\s/>]){_INSIDE}>(.*?)(?:</\1(?=[\s/>])[^>]*>?|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*){_INSIDE}(>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_PLAIN = re.compile(r"/(?!/)[\w%~/.-]*")
_ATTRIBUTE = re.compile(r"([^\s=/][^\s=/]*)\s*(?:=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>][^\s>]*)))?")


def _attribute(attributes: str, name: str) -> str | None:
    """The first value of an attribute, if it has one."""
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() == name:
            return unescape(m[2] or m[3] or m[4] or "") or None
    return None


def _ends(html: str, name: str) -> dict[int, int]:
    """Where each element of the name that is closed starts, and the place behind its end tag."""
    starts, ends = [], {}
    for m in re.finditer(rf"<(/?){name}(?=[\s/>])[^>]*>?", html, re.IGNORECASE):
        if not m[1]:
            starts.append(m.start())
        elif starts:
            ends[starts.pop()] = m.end()
    return ends


def extract(html: str, url: str = "") -> tuple[str, dict]:
    """Plain text (one line per block) and the page's metadata; links are resolved against its base or ``url``.

    The title is that of the first title element outside hidden ones. A hidden element that is never closed hides
    nothing, but for scripts and styles, which run to the end as browsers read them.
    """
    text, links, title, lang, base, at = [], [], None, None, url, 0
    closed: dict[str, dict[int, int]] = {}
    found = _TAG.finditer(html)
    while (m := next(found, None)) is not None:
        start = m.start()
        if start > at:
            text.append(html[at:start])
        at = m.end()
        raw, _, inner, end, name, inside, over = m.groups()
        if raw:
            raw = raw.lower()
            if raw == "title":
                title = inner if title is None else title
            elif raw == "textarea":
                text.append(inner)
        # a tag that the text's end cuts off is dropped
        if name and over or raw in BLOCKS:
            name = (name or raw).lower()
            if name in BLOCKS:
                text.append("\n")
            if end or raw:
                continue
            if name in ("a", "area"):
                links.append(_attribute(inside, "href"))
            elif name == "html" and lang is None:
                lang = _attribute(inside, "lang")
            elif name == "base" and base == url:
                base = _joined(url, _attribute(inside, "href"))
            elif name in HIDDEN and not inside.endswith("/"):
                if name not in closed:
                    closed[name] = _ends(html, name)
                if start in closed[name]:
                    at = closed[name][start]
                    found = _TAG.finditer(html, at)
    text.append(html[at:])
    lines = (" ".join(x.split()) for x in unescape("".join(text)).split("\n") if x)
    origin = _joined(base, "/")[:-1]
    whole = lambda x: origin + x if _PLAIN.fullmatch(x) and "/." not in x else _joined(base, x)
    about = {"title": " ".join(unescape(title or "").split()), "lang": lang, "links": [whole(x) for x in links if x]}
    return "\n".join(x for x in lines if x), about


def _joined(base: str, link: str | None) -> str:
    try:
        return urljoin(base, (link or "").strip())
    except ValueError:  # a malformed address stays as it is
        return link or ""


def response_record(url: str, html: str, date: str = EPOCH) -> tuple[list[tuple[str, str]], bytes]:
    """A response's headers and block."""
    payload = html.encode("utf-8", "replace")
    block = f"{STATUS}\r\n{''.join(f'{k}: {v}\r\n' for k, v in _http(payload))}\r\n".encode() + payload
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", url.encode("utf-8", "replace"), payload)), ("WARC-Date", date), ("WARC-Target-URI", _one_line(url)),
        ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return headers, block


STATUS = "HTTP/1.1 200 OK"


def _http(payload: bytes) -> list[tuple[str, str]]:
    return [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]


def derived_records(source: dict[str, str], block: bytes) -> list[tuple[str, str, bytes]]:
    """(kind, id, bytes) of the metadata and the conversion record of a response, from its headers and its block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    status, *http = head.decode("latin-1").split("\r\n")
    refers, url, date = source["WARC-Record-ID"], source["WARC-Target-URI"], source["WARC-Date"]
    text, page = extract(payload.decode("utf-8", "replace"), url)
    about = {
        "envelope": {k: v for k, v in source.items() if k.startswith("WARC-") or k in ("Content-Type", "Content-Length")},
        "http": {"status": status, "headers": dict(h.split(": ", 1) for h in http if ": " in h)},
        "html": page,
    }
    out = []
    for kind, content_type, body in (
        ("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True).encode("utf-8", "replace")),
        ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")),
    ):
        rid = record_id(kind, refers.encode(), body)
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Refers-To", refers),
            ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("WARC-Source-Payload-Digest", source.get("WARC-Payload-Digest", "")),
            ("WARC-Block-Digest", digest(body)), ("Content-Type", content_type),
        ]
        out.append((kind, rid, build(headers, body)))
    return out


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))


def _each(batch: pd.DataFrame) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    for url, html in zip(batch["url"], batch["html"], strict=True):
        yield response_record(url if isinstance(url, str) else "", html if isinstance(html, str) else "")


def _rows(batch: pd.DataFrame, made: list[list[tuple[str, str, bytes]]]) -> pd.DataFrame:
    """The records made of each row of ``batch``, with its page id."""
    rows = [r for each in made for r in each]
    out = pd.DataFrame(rows, columns=["kind", "record_id", "record"])
    out.insert(0, "page_id", batch["page_id"].repeat([len(each) for each in made]).to_numpy())
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One response record per page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _rows(batch, [[("response", dict(h)["WARC-Record-ID"], build(h, b))] for h, b in _each(batch)])

    return _pages(pages, id_col, url_col, html_col).mapInPandas(run, RECORD)


def derive(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of stored response records; other kinds give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _rows(batch, [derived_records(*parse(bytes(r))) for r in batch["record"]])

    return records.where("kind = 'response'").select("page_id", "record").mapInPandas(run, RECORD)


def derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What ``derive(responses(pages))`` gives, without moving the responses between processes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _rows(batch, [derived_records(dict(h) | {"Content-Length": str(len(b))}, b) for h, b in _each(batch)])

    return _pages(pages, id_col, url_col, html_col).mapInPandas(run, RECORD)


def write(records: DataFrame, path: str) -> None:
    """Store the records as gzip members by kind; the members of a folder, joined in any order, are a valid .warc.gz."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(record=[gzip.compress(bytes(r), 1, mtime=0) for r in batch["record"]])

    records.mapInPandas(run, RECORD).write.partitionBy("kind").option("compression", "none").parquet(path)


def read(spark, path: str) -> DataFrame:
    """The stored records with what their headers say and the digest of the block that was read."""
    fields = "page_id long, kind string, record_id string, refers_to string, target_uri string, block_digest string, source_digest string, n_bytes long, digest_ok boolean, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, member in zip(batch["page_id"].tolist(), batch["record"], strict=True):
                h, block = parse(gzip.decompress(bytes(member)))
                kind = h["WARC-Type"]
                rows.append((
                    page_id, kind, h["WARC-Record-ID"], h.get("WARC-Refers-To"), h["WARC-Target-URI"], h["WARC-Block-Digest"],
                    h.get("WARC-Source-Payload-Digest", h.get("WARC-Payload-Digest")), len(block), digest(block) == h["WARC-Block-Digest"], block.decode("utf-8") if kind != "response" else None,
                ))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")]).assign(page_id=batch["page_id"].values)

    return spark.read.schema(RECORD).parquet(path).select("page_id", "record").mapInPandas(run, fields)


def derivative_files(pages: DataFrame) -> DataFrame:
    """Write the derived records of ``pages`` to the shared folder and read them back."""
    path = scratch_path(pages.sparkSession, "warc")
    write(derivatives(pages), path)
    return read(pages.sparkSession, path)
