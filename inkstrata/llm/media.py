"""Interleaved document sequences: text and media in page order, payloads resolved by digest.

``sequence`` parses a document's HTML into ordered items, each a text or a media
reference with its caption, and joins the references to a media table by digest, so
position and caption stay with the media they belong to. The media table is content
addressed: equal payloads are stored once.

Payloads are kept as PNG: 8-bit grey samples, a row of ``WIDTH`` samples each,
so any byte string padded to whole rows comes back byte for byte.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bytes_of, unused, utf8

WIDTH = 576
PAD = 255
SCHEME = "digest:"
ITEM = "position int, kind string, text string, digest string, caption string"
FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(text: bytes) -> bytes:
    """Filled up with bytes 255 to a positive multiple of the row width."""
    return text + bytes([PAD]) * (-len(text) % WIDTH if text else WIDTH)


def to_png(samples: bytes) -> bytes:
    """A grey 8-bit PNG of rows of ``WIDTH`` samples."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    plain = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(plain, 1)) + chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of a PNG of the kind that ``to_png`` writes; anything else is an error."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, size, data = 8, (0, 0), b""
    while at < len(stored):
        n, kind = struct.unpack_from(">I4s", stored, at)
        body = stored[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", stored, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
            if body[8:13] != bytes([8, 0, 0, 0, 0]):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature_of(samples: bytes) -> str:
    """Mean and 16-bin histogram of the samples."""
    x = np.frombuffer(samples, np.uint8)
    return f"mean={int(x.sum(dtype=np.int64)) * 1000 // len(x)};hist=" + ",".join(map(str, np.bincount(x >> 4, minlength=16)))


BLOCKS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "section", "article", "blockquote", "tr", "dt", "dd", "pre", "table", "caption", "ul", "ol", "dl", "main", "header", "footer", "nav", "aside", "address", "form")
# What words of two of them never run together in, though they are one text.
CELLS = ("td", "th", "br", "option")
# What ends a caption whose own end is missing.
AFTER_CAPTION = ("figure", "section", "article", "main", "body", "html")


class _Items(HTMLParser):
    """Ordered text and media items; a figure's caption goes to the media inside it.

    A caption ends at its own end tag, or at the end or beginning of what can't be in one. One
    that belongs to no media is text. Several captions of a figure are joined by a space.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.figure: int | None = None
        self.caption: list[str] | None = None
        self.said: str | None = None  # the captions of a figure whose media may follow
        self.captioned: set[int] = set()  # positions of media whose caption is a figure's

    def give(self, media: list[dict], text: str) -> None:
        """A figure's caption in place of what an image says of itself, or after the captions before it."""
        for item in media:
            item["caption"] = f"{item['caption']} {text}" if item["position"] in self.captioned else text
            self.captioned.add(item["position"])

    def end_caption(self) -> None:
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        if not text:
            return
        media = [x for x in self.items[self.figure :] if x["kind"] == "media"] if self.figure is not None else []
        self.give(media, text)
        if not media and self.figure is not None:
            self.said = f"{self.said} {text}" if self.said else text
        elif not media:
            self.words.append(text)
            self.end_text()

    def end_figure(self) -> None:
        self.end_caption()
        self.end_text()
        media = [x for x in self.items[self.figure :] if x["kind"] == "media"] if self.figure is not None else []
        if self.said is not None:
            own = [x for x in media if x["position"] in self.captioned]
            self.give([x for x in media if x["position"] not in self.captioned], self.said)
            for item in own:  # said before the media and after it
                item["caption"] = f"{self.said} {item['caption']}"
            if not media:
                self.words.append(self.said)
                self.end_text()
        self.figure = self.said = None

    def end_text(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"position": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in AFTER_CAPTION:
            self.end_caption()
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figcaption":
            self.end_caption()
            self.end_text()
            self.caption = []
        elif tag == "figure":
            self.end_figure()
            self.figure = len(self.items)
        elif tag in ("img", "audio", "video", "source"):
            at = dict(attrs)
            src = at.get("src") or ""
            if src:
                self.end_text()
                self.items.append({"position": len(self.items), "kind": "media", "text": None, "digest": src.removeprefix(SCHEME) if src.startswith(SCHEME) else None, "caption": at.get("alt") or None})
        elif tag in BLOCKS or tag in CELLS:
            (self.words if self.caption is None else self.caption).append(" ")
            if tag in BLOCKS:
                self.end_text()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.end_caption()
        elif tag == "figure":
            self.end_figure()
        elif tag in CELLS:
            (self.words if self.caption is None else self.caption).append(" ")
        elif tag in AFTER_CAPTION or tag in BLOCKS:
            if tag in AFTER_CAPTION:
                self.end_caption()
            elif self.caption is not None:
                self.caption.append(" ")
            self.end_text()

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def items_of(html: str) -> list[dict]:
    parser = _Items()
    parser.feed(html)
    parser.close()
    parser.end_figure()
    return parser.items


def _parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
    for pages in batches:
        yield pa.array([items_of(h or "") for h in pages.to_pylist()], kind)


def items(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """A row per item (position, kind, text, digest, caption) of every page, beside the page's other columns.

    Null or empty pages have no items. References that aren't ``digest:`` have a null
    digest and resolve to nothing. Columns that clash with an item's are replaced.
    """
    names = [f.split()[0] for f in ITEM.split(", ")]
    others = [c for c in pages.columns if c.lower() not in names and c != html_col]
    listed = unused(pages, "_items")
    made = attach(pages, listed, _parse, f"array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>", F.col(html_col).cast("string"))
    own = made.select(*[F.col(f"`{c}`") for c in others], F.explode(listed).alias(listed))
    return own.select(*[F.col(f"`{c}`") for c in others], *[F.col(listed)[n].alias(n) for n in names])


def store(payloads: DataFrame, digest: Column, payload: Column) -> DataFrame:
    """digest, media: every different payload once, as PNG; copies are folded before they move."""

    def draw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for blobs in batches:
            yield pa.array([to_png(padded(b)) for b in bytes_of(blobs)], pa.binary())

    rows = payloads.select(digest.alias("digest"), payload.alias("_payload"))
    return attach(rows, "media", draw, "binary", F.col("_payload")).select("digest", "media").dropDuplicates(["digest"])


def _read_back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for stored in batches:
        rows = []
        for m in bytes_of(stored):
            samples = from_png(m)
            rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(samples)))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in FEATURES.split(", ")])


def described(media: DataFrame) -> DataFrame:
    """The media table with what is read back from the stored bytes."""
    made = attach(media, "_f", _read_back, FEATURES, F.col("media"))
    return made.select("digest", "media", *[F.col("_f")[f.split()[0]].alias(f.split()[0]) for f in FEATURES.split(", ")])


def sequence(pages: DataFrame, media: DataFrame, html_col: str = "html") -> DataFrame:
    """All items of all pages with the columns of their media beside them, null where nothing resolves.

    ``media`` has one row per digest. A column of it that is called as an item's comes as ``media_`` and its name; a
    page's other columns give way to the media's. References to one digest may be a large share of all rows: they are the
    streamed side of the join, which the engine splits where they pile up.
    """
    found = items(pages, html_col)
    own = {f.split()[0] for f in ITEM.split(", ")} - {"digest"}
    for c in media.columns:
        if c.lower() in own:
            media = media.withColumnRenamed(c, unused(found, f"media_{c}"))
    taken = {c.lower() for c in media.columns if c != "digest"}
    found = found.drop(*[c for c in found.columns if c.lower() in taken])
    return found.join(media, "digest", "left")


def pages_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", caption_col: str = "source") -> DataFrame:
    """A page for each document that refers to the document's bytes as media, captioned by its source."""
    raw = F.coalesce(utf8(text_col), F.lit(b""))
    caption = F.coalesce(F.replace(F.replace(F.col(caption_col).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(""))
    html = F.concat(F.lit("<article><p>Document "), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f'</p><figure><img src="{SCHEME}'), F.sha2(raw, 256), F.lit('"><figcaption>'), caption, F.lit("</figcaption></figure></article>"))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), html.alias("html"))


def media_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The media table of all documents' texts (null: empty), by the digest of the text's bytes."""
    raw = F.coalesce(utf8(text_col), F.lit(b""))
    return store(docs.select(raw.alias("raw")), F.sha2(F.col("raw"), 256), F.col("raw"))
