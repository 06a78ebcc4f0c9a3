"""Operator 9: WARC derivatives.

Every response becomes two records that refer to it: a ``metadata`` record (application/warc-fields: the
source's status, headers, digests, title, language and links) and a ``conversion`` record (text/plain: the
page as text). Both keep the response's identifier in WARC-Refers-To with its target URI and date, carry the
source's payload digest and headers, and have ids that follow from the response's id, so a rerun gives equal
records and the two derivatives name each other (WARC-Concurrent-To). One map over responses, no shuffle.

``write`` stores records as WARC files through Spark's own text writer: a record ends in two line breaks,
which is the writer's line separator, so any file system that Spark reaches will do.

Defined results: a null or empty payload is an empty document (both records are made, with the digest of no
bytes); a null URI or date gives records without that header; line breaks inside header values become
spaces; repeated responses with the same id give equal records; only the named columns are read, in a table with any others.
Pages may be long or hostile: every step takes time linear in the page. A tag ends at its first ``>``, one without it is
text; a comment or script without an end runs to the end of the page; titles, languages and links inside either do not count.

The given ``pages`` hold no HTTP responses: ``responses`` makes the status line, the headers and the date up (constants, with the true
length). ``derive`` takes whatever status and headers its rows have.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import lean

CRAWL_DATE = "2026-01-01T00:00:00Z"
_DROPPED = re.compile(r"<!--|<(script|style|noscript|template)\b[^>]*+>", re.I)
_ENDS = {k: re.compile(rf"</{k}\s*+>", re.I) for k in ("script", "style", "noscript", "template")}
_BREAK = re.compile(r"<(?:/?(?:p|div|h[1-6]|li|ul|ol|table|tr|article|section|header|footer|nav|main|aside|blockquote|pre|title|head|body|form|dl|dt|dd)\b[^>]*+|[bh]r\b[^>]*+)>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*+>")
_GAP = re.compile(r"[^\S\n]+")
_LINES = re.compile(r"\s*\n\s*")
_TITLE, _TITLE_END = re.compile(r"<title\b[^>]*+>", re.I), re.compile(r"</title", re.I)
_HTML, _LANG = re.compile(r"<html\b[^>]*+>", re.I), re.compile(r"(?<![\w-])lang\s*+=\s*+[\"']?([A-Za-z0-9-]+)", re.I)
_A = re.compile(r"<a\b[^>]*+>", re.I)
_HREF = re.compile(r"(?<![\w-])href\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,}+;?")


def _resolve(text: str) -> str:
    """Entities resolved; a number beyond all code points is U+FFFD, however long."""
    return entities.unescape(_HUGE.sub("\ufffd", _ZEROS.sub("&#", text)))


def _shown(page: str) -> tuple[str, str]:
    """The page without comments and scripts, cut behind its last ``>``: in the first part every tag that opens
    also ends, so a search never runs to the end of the page more than once."""
    parts, i, last = [], 0, page.rfind(">") + 1
    while m := _DROPPED.search(page, i, last):
        parts.append(page[i:m.start()])
        if m[1]:
            end = _ENDS[m[1].lower()].search(page, m.end())
            i = end.end() if end else len(page)
        else:
            end = page.find("-->", m.end())
            i = end + 3 if end >= 0 else len(page)
        if i == len(page):
            break
    rest = page[i:]
    lone = rest.find("<!--", max(last - i, 0))      # a comment that opens behind the last tag
    whole = " ".join([*parts, rest if lone < 0 else rest[:lone]])
    cut = whole.rfind(">") + 1
    return whole[:cut], whole[cut:]


def _text(tags: str, tail: str) -> str:
    flat = [_GAP.sub(" ", x.replace("\n", " ").replace("\r", " ")) for x in (tags, tail)]
    t = _resolve(_TAG.sub("", _BREAK.sub("\n", flat[0])) + flat[1])
    return _LINES.sub("\n", _GAP.sub(" ", t)).strip()


def plain_text(page: str) -> str:
    """Visible text of a page: a line per block, white space collapsed, entities resolved."""
    return _text(*_shown(page))


def facts(page: str) -> tuple[str | None, str | None, list[str], str]:
    """(title, language, links, visible text) of a page."""
    tags, tail = _shown(page)
    title = None
    if (m := _TITLE.search(tags)) and (end := _TITLE_END.search(tags, m.end())):
        title = _resolve(tags[m.end():end.start()])
    lang = next((x[1] for m in _HTML.finditer(tags) if (x := _LANG.search(m[0]))), None)
    hrefs = (_HREF.search(m[0]) for m in _A.finditer(tags))
    return title, lang, [x for h in hrefs if h and (x := _resolve(h[1] or h[2] or h[3] or ""))], _text(tags, tail)


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _uuid(*parts: str) -> str:
    h = hashlib.sha256("\n".join(parts).encode("utf-8", "replace")).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}>"


def _head(fields: list[tuple[str, str | None]]) -> str:
    return "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v is not None)


def responses(pages: DataFrame, crawl_date: str = CRAWL_DATE) -> DataFrame:
    """Response records of a table of pages (page_id, url, html): ids follow from page id and url."""
    h = F.sha2(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")),
                           F.coalesce("html", F.lit(""))), 256)
    part = lambda a, n: F.substring(h, a, n)
    rid = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3),
                   F.lit("-"), part(21, 12), F.lit(">"))
    return pages.select("page_id", rid.alias("record_id"), F.col("url").alias("target_uri"), F.lit(crawl_date).alias("date"),
                        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                                 F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("\r\n")).alias("http_headers"),
                        F.col("html").alias("payload"))


def _records(rid: str, uri: str | None, date: str | None, http: str | None, page: str | None) -> list[dict]:
    page = page or ""
    payload = _digest(page.encode("utf-8", "replace"))
    status, _, rest = (http or "").partition("\r\n")
    title, lang, links, text = facts(page)
    fields = [("source-record-id", rid), ("source-payload-digest", payload), ("source-status", status or None)]
    for line in rest.split("\r\n"):
        if ":" in line:
            name, value = line.split(":", 1)
            fields.append((f"source-header-{name.strip().lower()}", value))
    fields += [("title", title), ("language", lang), *[("outlink", x) for x in links]]
    ids = {k: _uuid(rid, k) for k in ("metadata", "conversion")}
    out = []
    for kind, ctype, block in (("metadata", "application/warc-fields", _head(fields)), ("conversion", "text/plain; charset=utf-8", text)):
        raw = block.encode("utf-8", "replace")
        other = ids["conversion" if kind == "metadata" else "metadata"]
        head = "WARC/1.1\r\n" + _head([
            ("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", uri),
            ("WARC-Refers-To-Date", date), ("WARC-Concurrent-To", other), ("WARC-Target-URI", uri), ("WARC-Date", date),
            ("WARC-Source-Payload-Digest", payload), ("WARC-Block-Digest", _digest(raw)), ("Content-Type", ctype), ("Content-Length", str(len(raw)))])
        out.append({"record_type": kind, "warc_id": ids[kind], "refers_to": rid, "concurrent_to": other, "uri": uri, "warc_date": date,
                    "source_digest": payload, "block_digest": _digest(raw), "content_length": len(raw), "header": head,
                    "block": raw.decode("utf-8")})
    return out


_OUT = ("record_type string, warc_id string, refers_to string, concurrent_to string, uri string, warc_date string, "
        "source_digest string, block_digest string, content_length bigint, header string, block string")


def derive(source: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two records per response (record_id, target_uri, date, http_headers, payload), with ``id_col``."""
    source = source.select(id_col, "record_id", "target_uri", "date", "http_headers", "payload")
    types = {"content_length": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("record_id", "target_uri", "date", "http_headers", "payload")]
            for i in range(0, b.num_rows, 500):
                rows, src = [], []
                for j in range(i, min(i + 500, b.num_rows)):
                    got = _records(cols[0][j] or "", *(c[j] for c in cols[1:]))
                    rows += got
                    src += [j] * len(got)
                names = list(rows[0])
                yield pa.RecordBatch.from_arrays(
                    [b.column(id_col).take(pa.array(src)), *(pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names)],
                    names=[id_col, *names])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, {_OUT}")


def write(records: DataFrame, path: str) -> None:
    """WARC files (one a task); each record is header, empty line, block and two line breaks."""
    records.select(F.concat("header", F.lit("\r\n"), "block").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
