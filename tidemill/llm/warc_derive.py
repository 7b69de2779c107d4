"""WARC derivatives: metadata and plain-text conversion records for each response.

Every page becomes a response record (HTTP headers and payload); from it two records
are derived, as in WAT and WET files: a ``metadata`` record (JSON with the source's
headers, title, links and digests) and a ``conversion`` record (the plain text). Both
refer to the response by ``WARC-Refers-To`` and keep its target and date.

Record ids are name-based UUIDs of the page's id, url and content and of the record's
type, so a task that runs again derives the same ids and links never break. Digests are
``sha1:`` with base 32, of the payload and of each record's block.

Defined cases
    * null html has an empty payload; both records are written, with empty text
    * null url: the record has no WARC-Target-URI header and the column is null
    * repeated rows give repeated records with the same ids (they are the same response)
    * html of any length is converted whole; an empty table gives an empty result
    * extra columns are ignored
"""

from __future__ import annotations

import base64
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import ASCII_LOWER, table

NAME = "op2_warc_derive"
SQL = None
#: The pages carry no capture time.
DATE = "1970-01-01T00:00:00Z"
SOFTWARE = "tidemill"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tidemill:warc")

#: Elements that end a line of text.
_BREAK = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is not text of the page; that of the first two is no mark-up either.
_RAW, _HIDDEN = frozenset(["script", "style"]), frozenset(["script", "style", "noscript", "template", "svg"])
_LINKS = frozenset(["a", "img", "link", "script", "iframe", "area"])
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)")
_SPECIAL = re.compile("[\"'>]")
#: Blanks that are not a single space already.
_BLANK = re.compile(r"[^\S\n]{2,}+|[^\S\n ]")
_LINES = re.compile(r" ?\n[ \n]*")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))")


class Page:
    """Text, title, links and metas of a page by one scan; every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page = page
        # A-Z only, so that places stay; a table for str.translate is looked up at every character
        self.low = page.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).decode("utf-8", "surrogatepass")
        self.known: dict[int, int] = {}  # quote that opens outside of others: end of its tag
        self.last: int | None = None  # the last quote or end of a tag
        self.closed: dict[str, int] = {}  # name of an element: its next closing tag
        self.text: list[str] = []
        self.links: list[dict[str, str]] = []
        self.metas: list[dict[str, str]] = []
        self.title: str | None = None
        self._scan()

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, outside of quotes; -1 if there is none. Quotes that were followed once are remembered."""
        if self.last is None:
            self.last = max(map(self.page.rfind, "\"'>"))
        if at > self.last:
            return -1
        m = _SPECIAL.search(self.page, at)
        if m and m[0] == ">":
            return m.start()
        passed = []
        while (m := _SPECIAL.search(self.page, at)) and m[0] != ">" and m.start() not in self.known:
            passed.append(m.start())
            close = self.page.find(m[0], m.start() + 1)
            if close < 0:
                m = None
                break
            at = close + 1
        end = -1 if m is None else m.start() if m[0] == ">" else self.known[m.start()]
        self.known.update(dict.fromkeys(passed, end))
        return end

    def _closing(self, name: str, at: int) -> int:
        """Place of an element's closing tag; the end of the page if there is none. The scan goes forward, so a place holds until it is passed."""
        if self.closed.get(name, -1) < at:
            k = self.low.find(f"</{name}", at)
            self.closed[name] = len(self.page) if k < 0 else k
        return self.closed[name]

    def _scan(self) -> None:
        page, low, at, shown, head = self.page, self.low, 0, 0, False
        while True:
            j = page.find("<", at)
            stop = len(page) if j < 0 else j
            if at >= shown:
                self.text.append(page[at:stop])
            if j < 0:
                return
            if page.startswith("<!--", j):
                k = page.find("-->", j + 4)
                at = len(page) if k < 0 else k + 3
                continue
            if low.startswith("<!doctype", j) or page.startswith("<?", j):
                k = page.find(">", j)
                at = len(page) if k < 0 else k + 1
                continue
            m = _NAME.match(page, j)
            end = self._end(m.end()) if m else -1
            if end < 0:  # no tag
                if at >= shown or j >= shown:
                    self.text.append("<")
                at = j + 1
                continue
            name, at = m[1].lower(), end + 1
            if name in _BREAK and j >= shown:
                self.text.append("\n")
            if page[j + 1] != "/":
                at = self._opened(name, page[m.end() : end], at)
                if name in _HIDDEN or name == "head" and not head:
                    close = self._closing(name, at)
                    if name != "head" or close < len(page):
                        head = head or name == "head"
                        shown = max(shown, close)

    def _opened(self, name: str, inside: str, at: int) -> int:
        """Take what an opening tag says; where the scan goes on."""
        if name in _LINKS or name == "meta":
            pairs = [(k.lower(), html.unescape(a or b or c)) for k, a, b, c in _ATTRIBUTE.findall(inside)]
            if name == "meta":
                self.metas.append(dict(pairs))
            for k, v in pairs:
                if name != "meta" and k in ("href", "src"):
                    self.links.append({"tag": name, "attribute": k, "url": v})
                    break
        if name == "title" and self.title is None and (close := self._closing(name, at)) < len(self.page):
            self.title = html.unescape(self.page[at:close]).strip()
        return self._closing(name, at) if name in _RAW else at

    def plain_text(self) -> str:
        """Visible text: block elements end lines, inline mark-up vanishes, entities are decoded."""
        return _LINES.sub("\n", _BLANK.sub(" ", html.unescape("".join(self.text)))).strip()


def plain_text(page: str) -> str:
    return Page(page).plain_text()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, payload: bytes, kind: str) -> str:
    name = json.dumps([page_id, url, hashlib.sha256(payload).hexdigest(), kind])
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def http_block(payload: bytes) -> tuple[dict[str, str], bytes]:
    headers = {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))}
    head = "HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    return headers, head.encode() + payload


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A WARC/1.1 record with its two closing line ends."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def derive(page_id: int | None, url: str | None, page: str | None, date: str = DATE) -> list[tuple]:
    """The metadata and the conversion record of a page: rows of COLUMNS."""
    page = page or ""
    payload = page.encode("utf-8", "surrogatepass")
    source, response = http_block(payload)
    refers, payload_digest = record_id(page_id, url, payload, "response"), digest(payload)
    seen = Page(page)
    links, text = seen.links, seen.plain_text()
    envelope = {
        "Envelope": {
            "WARC-Header-Metadata": {
                "WARC-Type": "response", "WARC-Record-ID": refers, "WARC-Target-URI": url, "WARC-Date": date,
                "WARC-Payload-Digest": payload_digest, "WARC-Block-Digest": digest(response), "Content-Length": str(len(response)),
                "Content-Type": "application/http; msgtype=response",
            },
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": {"Status": "200", "Version": "HTTP/1.1", "Reason": "OK"},
                    "Headers": source,
                    "HTML-Metadata": {
                        "Head": {"Title": seen.title, "Metas": seen.metas},
                        "Links": links,
                    },
                    "Entity-Digest": payload_digest, "Entity-Length": str(len(payload)),
                },
            },
        },
    }
    out = []
    for kind, content, block in (
        ("metadata", "application/json", json.dumps(envelope, ensure_ascii=False).encode("utf-8", "surrogatepass")),
        ("conversion", "text/plain", text.encode("utf-8", "surrogatepass")),
    ):
        own, block_digest = record_id(page_id, url, payload, kind), digest(block)
        headers = [
            ("WARC-Type", kind), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Record-ID", own), ("WARC-Refers-To", refers),
            ("WARC-Payload-Digest", payload_digest if kind == "metadata" else None), ("WARC-Block-Digest", block_digest),
            ("Content-Type", content), ("Content-Length", str(len(block))),
        ]
        out.append((page_id, kind, own, refers, url, date, content, len(block), block_digest, payload_digest, len(links), block.decode("utf-8", "replace"), record(headers, block)))
    return out


COLUMNS = (
    "page_id long, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, "
    "content_length long, block_digest string, source_payload_digest string, n_links long, block string, record binary"
)
KINDS = [pa.int64(), *[pa.string()] * 6, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def warc_derive(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Two rows for each page, COLUMNS; ``record`` is the whole WARC record."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [r for p in zip(*(c.to_pylist() for c in part.columns)) for r in derive(*p, date)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names)

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, COLUMNS)


def write_warc(derived: DataFrame, folder: str) -> None:
    """Write the records as Parquet, one binary record a row, a folder for each type.

    Joining the ``record`` column of a folder's rows gives a valid WARC file.
    """
    derived.select("warc_type", "record_id", "record").write.partitionBy("warc_type").parquet(folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derive(table(spark, sf_dir, "pages")).drop("record")
