"""Media columns: documents as sequences of text and media references, whose payloads a join on digests resolves."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import by_value
from .common import bounded_batches, free_name, materialize, positional, with_hot

#: Samples of an image row; payloads are padded to a multiple of it with PAD, which UTF-8 never has.
WIDTH, PAD, SIGNATURE, LEVEL = 576, b"\xff", b"\x89PNG\r\n\x1a\n", 6
SCHEME = "sha256:"
#: Digests that a task remembers; beyond them it starts anew, which stores a repeated text again and loses nothing.
SEEN = 1 << 18
VOID = {"img", "br", "hr", "meta", "link", "input", "source", "wbr"}
#: Elements whose text is not the page's, and what a head may hold; anything else ends it.
HIDDEN = {"script", "style", "title", "template", "noscript"}
IN_HEAD = HIDDEN | {"base", "link", "meta"}
BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "br", "hr", "header", "footer", "main", "nav", "aside"}
SEQUENCE = "array<struct<position:int,kind:string,text:string,src:string,digest:string,caption:string>>"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
by_value(__name__)


def payload_of(text: str | None) -> bytes:
    """The UTF-8 bytes of a text (null: none), padded to a positive multiple of WIDTH."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + PAD * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def to_png(payload: bytes) -> bytes:
    """A grey image of 8-bit samples, WIDTH wide, no row filtered. Rows beyond PNG's 2^31 - 1 don't occur in a cell."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png wrote; anything damaged is an error."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        size, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit grey")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Rows, mean and deviation of the samples, and a 64-bit average hash of an 8 by 8 reduction."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    edges = np.linspace(0, len(samples), 9).astype(int)
    columns = samples.reshape(len(samples), 8, -1).sum(2, dtype=np.int64)
    cells = np.array([columns[a : max(b, a + 1)].mean(0) if a < len(samples) else columns[-1] for a, b in zip(edges[:-1], edges[1:], strict=True)])
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"grey8 {WIDTH}x{len(samples)} mean={samples.mean():.4f} sd={samples.std():.4f} ahash={bits}"


def media_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """digest and media of the texts of docs, stored in the shared folder and read back.

    digest: sha256 of the text's UTF-8 bytes, the content address that references use. Images are written where
    their texts are read and never shuffled: a task stores a text once (but see SEEN), texts that several tasks
    read are stored by each, and whoever needs one row for each digest takes the features, which are narrow."""
    bounded_batches(docs.sparkSession)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            digests, images = [], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest not in seen:
                    if len(seen) == SEEN:
                        seen.clear()
                    seen.add(digest)
                    digests.append(digest)
                    images.append(to_png(payload_of(text.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(images, pa.binary())], names=["digest", "media"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return materialize(docs.select(F.sha2(text, 256).alias("digest"), text.alias("text")).mapInArrow(draw, "digest string, media binary"), "media")


def media_features(store: DataFrame) -> DataFrame:
    """FEATURES, one row for each digest of the store, all from the stored bytes as read back.

    Of several stored copies of an image the least row stays, whichever codec wrote them; copies merge before
    the shuffle. The rows are narrow and not stored: whoever joins them stores what it joined."""
    bounded_batches(store.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stored = media.as_py()
                payload = from_png(stored)
                rows.append((digest, len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [c.split()[0] for c in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    values = F.struct(*[c.split()[0] for c in FEATURES.split(", ")[1:]]).alias("values")
    found = store.select("digest", "media").mapInArrow(look, FEATURES).select("digest", values)
    return found.groupBy("digest").agg(F.min("values").alias("values")).select("digest", "values.*")


class Sequencer(HTMLParser):
    """Text and media in the order of the page; a figure's caption goes with its media.

    Tags that are never closed, or closed in another order, lose no text: a head ends where the body's text
    or elements begin, a figure's end ends its caption too, the page's end ends all, and the caption of a
    figure without media is text."""

    def __init__(self, hidden: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hides, self.hidden, self.in_head = hidden, [], False
        self.figures: list[dict] = []

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "src": None, "digest": None, "caption": None})

    def caption(self) -> list[str] | None:
        """The words of the innermost open caption."""
        return next((f["open"] for f in reversed(self.figures) if f["open"] is not None), None)

    def end_caption(self, figure: dict) -> None:
        if figure["open"] is not None:
            figure["caption"] += [" ".join("".join(figure["open"]).split())]
            figure["open"] = None

    def end_figure(self) -> None:
        figure = self.figures[-1]
        self.end_caption(figure)
        self.figures.pop()
        text = " ".join(c for c in figure["caption"] if c)
        for item in figure["media"] if text else []:
            item["caption"] = text
        if text and not figure["media"]:
            self.put(text)
            self.part()

    def put(self, text: str) -> None:
        caption = self.caption()
        (self.words if caption is None else caption).append(text)

    def part(self) -> None:
        """A block begins or ends here."""
        if self.caption() is None:
            self.flush()
        else:
            self.put(" ")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.in_head = tag == "head" or self.in_head and tag in IN_HEAD
        if tag in self.hides:
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag in BLOCKS:
            self.part()
        if tag == "figure":
            self.figures.append({"media": [], "caption": [], "open": None})
        elif tag == "figcaption" and self.figures:
            self.end_caption(self.figures[-1])
            self.figures[-1]["open"] = []
        elif tag in ("img", "video", "audio"):
            found = dict(attrs)
            src = (found.get("src") or "").strip()
            if src:
                self.flush()
                digest = src.removeprefix(SCHEME) if src.startswith(SCHEME) else None
                item = {"kind": "media", "text": None, "src": src, "digest": digest, "caption": found.get("alt") or found.get("title")}
                self.items.append(item)
                if self.figures:
                    self.figures[-1]["media"].append(item)

    def handle_endtag(self, tag: str) -> None:
        self.in_head = self.in_head and tag != "head"
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
            return
        if tag == "figcaption" and self.figures:
            self.end_caption(self.figures[-1])
        elif tag == "figure" and self.figures:
            self.end_figure()
        if tag in BLOCKS:
            self.part()

    def handle_data(self, data: str) -> None:
        if not self.hidden and not (self.in_head and not data.strip()):
            self.in_head = False
            self.put(data)

    def finish(self) -> list[dict]:
        self.close()
        while self.figures:
            self.end_figure()
        self.flush()
        return [{"position": i, **item} for i, item in enumerate(self.items)]


def sequence(html: str | None) -> list[dict]:
    """The page's items with their positions from 0; no page or an empty one has none.

    Elements that hide their text but never end would hide the rest of the page: then they hide nothing.
    (Scripts and styles that never end have no text after them to lose.)"""
    hidden = set(HIDDEN)
    for _ in HIDDEN:
        parser = Sequencer(hidden)
        try:
            parser.feed(html or "")
            items = parser.finish()
        except AssertionError:  # the library knows no such declaration: it is text
            html = (html or "").replace("<![", "&lt;![")
            continue
        left = hidden.intersection(parser.hidden) - {"script", "style"}
        if not left:
            return items
        hidden -= left
    return items


def sequences(pages: DataFrame, html_col: str = "html", outline: bool = False) -> DataFrame:
    """pages with its html replaced by the column sequence (see SEQUENCE), one row for each row. Where pages has
    a column of that name, the new one takes a leading underscore. outline: the number of characters of each
    text instead of the text, for whoever needs places and media only."""
    bounded_batches(pages.sparkSession)
    kept, name = [c for c in pages.columns if c != html_col], free_name(pages, "sequence")
    kind = pa.list_(pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "src", "digest", "caption"))]))

    def items(html: str | None) -> list[dict]:
        found = sequence(html)
        return [i | {"text": str(len(i["text"]))} if i["text"] else i for i in found] if outline else found

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([items(h.as_py()) for h in batch.column(len(kept))], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], found], names=schema.names)

    schema = T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate([*(pages.schema[c].dataType for c in kept), T.DataType.fromDDL(SEQUENCE)])])
    return positional(pages, [*kept, html_col]).mapInArrow(parse, schema).toDF(*kept, name)


def resolve(pages: DataFrame, media: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """id_col and sequence of each row of pages, where each item also has `columns` of media (null where no payload
    has its digest): positions and captions stay in place. media: one row for each digest.

    pages are stored once, and a row is known by its place there, so rows that are equal stay apart. Only
    media items go to the join; references that many rows share are broadcast, fewer than HOT of them. A
    sequence is gathered by its own page only; an empty or null one is empty."""
    stored = materialize(pages.select(F.col(id_col).alias("id"), "sequence"), "pages").select("id", "sequence", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("line"))
    items = stored.select("id", "file", "line", F.explode_outer("sequence").alias("item")).withColumn("digest", F.col("item.digest"))
    shown = items.where(F.col("digest").isNotNull())
    asked = materialize(shown.groupBy("digest").agg(F.count("*").alias("asked")).join(media.select("digest", *columns), "digest"), "references")
    found = with_hot(shown, ["digest"], asked, "asked", columns)
    others = items.where(F.col("digest").isNull()).select("*", *[F.lit(None).cast(media.schema[c].dataType).alias(c) for c in columns])
    item = F.struct(*[F.col(f"item.{c}") for c in ("position", "kind", "text", "src", "digest", "caption")], *columns)
    gathered = found.unionByName(others).groupBy("file", "line").agg(F.first("id").alias("id"), F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), item))).alias("sequence"))
    return gathered.select(F.col("id").alias(id_col), "sequence")


def illustrated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and html: a page of a document's whole text, a paragraph for each line, with a picture of the text
    after the first line, referred to by its digest and captioned."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    name = escaped(F.coalesce(F.col(id_col).cast("string"), F.lit("without an id")))
    page = docs.select(F.col(id_col).alias("id"), name.alias("name"), F.sha2(text, 256).alias("digest"), escaped(text).alias("body")).withColumn("first", F.substring_index("body", "\n", 1))
    rest = F.replace(F.substring("body", F.length("first") + 1, F.length("body")), F.lit("\n"), F.lit("</p><p>"))
    html = F.concat(F.lit("<article><h1>Document "), "name", F.lit("</h1><p>"), "first", F.lit(f'</p><figure><img src="{SCHEME}'), "digest", F.lit('"><figcaption>Text of document '), "name", F.lit("</figcaption></figure><p>"), rest, F.lit("</p></article>"))
    return page.select(F.col("id").alias(id_col), html.alias("html"))
