"""Interleaved document sequences with media columns.

HTML becomes an ordered sequence of text and media references (position, caption); a media table
holds each payload once under its digest, as an image of 8-bit samples; a join by digest resolves the
references, and each page comes back as one array of structs in which every element keeps its position
and caption. Elements and short features pass through the join, never payloads; elements without a
digest are dealt by a key of their own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import blocks

#: Pixels in a row of the stored images (of three samples each), so payloads come in multiples of 192 bytes.
WIDTH, UNIT = 64, 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "media:sha256:"
MEDIA = "digest string, media binary"
FEATURES = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def padded(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of UNIT bytes."""
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, n_bytes: int) -> bytes:
    """An RGB image of 8-bit samples, WIDTH pixels wide, that holds the payload; n_bytes, its length unpadded, as a text chunk."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    raw = np.zeros((len(rows), UNIT + 1), np.uint8)  # each row begins with filter type 0
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> tuple[bytes, int]:
    """(payload, n_bytes) of such an image; chunks are checked."""
    if media[:8] != SIGNATURE:
        raise ValueError("not an image of this kind")
    at, data, n_bytes = 8, [], 0
    while at < len(media):
        size, = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("damaged image")
        if kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, UNIT + 1)
    if raw[:, 0].any():
        raise ValueError("rows with a filter")
    return raw[:, 1:].tobytes(), n_bytes


def feature_of(payload: bytes) -> str:
    """Hex of a 16-bin histogram of the samples in thousandths, then of an 8 x 8 grid of brighter or darker than the mean."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    cells = np.add.reduceat(x.astype(np.int64), np.arange(64) * len(x) // 64)
    bits = np.packbits(cells * 64 > int(x.sum(dtype=np.int64)))
    return "".join(f"{b:03x}" for b in bins.tolist()) + "-" + bits.tobytes().hex()


class Interleaver(HTMLParser):
    """Elements of a page in order: runs of text, and images with their caption (of the figure, before or after them, else the alt text).

    A caption ends with its tag or its figure, or where a heading, a section or another figure begins;
    what is then left of the page is text. A caption without a figure is text.
    """

    SKIP = frozenset({"script", "style", "template", "noscript"})
    BLOCK = frozenset("p div article section li ul ol table tr h1 h2 h3 h4 h5 h6 br hr blockquote pre figure figcaption nav header footer main aside title td th".split())
    #: Nothing of these begins in a caption.
    APART = frozenset("article section h1 h2 h3 h4 h5 h6 nav header footer main aside figure table figcaption".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[list] = []
        self.text: list[str] = []
        self.skip = 0
        self.caption: list[str] | None = None
        self.figures: list[list] = []  # of each open figure: its first element, its caption

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.out.append(["text", text, None, None])

    def end_caption(self):
        if self.caption is not None:
            text = " ".join("".join(self.caption).split())
            self.figures[-1][1] = " ".join(x for x in (self.figures[-1][1], text) if x)
            self.caption = None

    def end_figure(self):
        self.end_caption()
        if self.figures:
            start, caption = self.figures.pop()
            for x in self.out[start:]:
                if x[0] == "media" and caption and not x[4:]:
                    x[3] = caption
                    x.append(True)  # a figure inside keeps its own caption

    def handle_starttag(self, tag, attrs):
        if tag in self.APART:
            self.end_caption()
        if tag in self.SKIP:
            self.skip += 1
        elif tag in self.BLOCK:
            self.flush()
        if tag == "figure":
            self.figures.append([len(self.out), ""])
        elif tag == "figcaption" and self.figures:
            self.caption = []
        elif tag in ("img", "audio", "video", "source"):
            found = dict(attrs)
            if found.get("src"):
                self.flush()
                self.out.append(["media", None, found["src"], found.get("alt") or None])
        elif self.caption is not None and tag in self.BLOCK:
            self.caption.append(" ")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            self.end_caption()
        elif tag in self.BLOCK:
            self.flush()
        if tag == "figure":
            self.end_figure()

    def handle_data(self, data):
        if self.skip:
            return
        (self.text if self.caption is None else self.caption).append(data)

    def close(self):
        super().close()
        self.flush()
        while self.figures:
            self.end_figure()


def interleave(html: str | None) -> list[tuple]:
    """[(position, kind, text, src, caption), ...] of one page; null and empty pages have no elements."""
    parser = Interleaver()
    parser.feed(html or "")
    parser.close()
    return [(k, *x[:4]) for k, x in enumerate(parser.out)]


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(doc_id, row_id, position, kind, text, src, digest, caption): a row per element, one with nulls for a page without any. Repeated rows keep sequences of their own."""
    common.prepare(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for start, length in blocks(batch.column(2)):
                out = []
                for row, doc, html in zip(*(batch.column(k).slice(start, length).to_pylist() for k in range(3))):
                    out += [(row, doc, *x, x[3].removeprefix(SCHEME) if (x[3] or "").startswith(SCHEME) else None) for x in interleave(html) or [(None,) * 5]]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
                columns = list(zip(*out)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["row_id", "doc_id", "position", "kind", "text", "src", "caption", "digest"])

    return pages.select(F.monotonically_increasing_id().alias("row_id"), pages[id_col].cast("long").alias("doc_id"), pages[html_col].cast("string").alias("html")).mapInArrow(run, "row_id long, doc_id long, position int, kind string, text string, src string, caption string, digest string")


def store_media(texts: DataFrame, text_col: str) -> DataFrame:
    """The media table (digest, media) of all payloads, in the shared folder. A task stores a payload once; copies in other tasks share its digest."""
    common.prepare(texts.sparkSession)

    def run(batches):
        stored = set()
        for batch in batches:
            for start, length in blocks(batch.column(0)):
                digests, media = [], []
                for text in batch.column(0).slice(start, length).to_pylist():
                    data = (text or "").encode("utf-8", "surrogatepass")
                    payload = padded(data)
                    key = reference(payload, len(data))
                    if key not in stored:
                        if len(stored) >= 200_000:
                            stored.clear()
                        stored.add(key)
                        digests.append(key)
                        media.append(to_png(payload, len(data)))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    return common.written(texts.select(texts[text_col].cast("string")).mapInArrow(run, MEDIA), "media")


def reference(payload: bytes, n_bytes: int) -> str:
    """A payload's key: its digest, and the length unpadded, as texts may differ in spaces at their end only."""
    return f"{hashlib.sha256(payload).hexdigest()}-{n_bytes}"


def media_features(media: DataFrame) -> DataFrame:
    """A row per digest, computed from the stored bytes."""

    def run(batches):
        for batch, (start, length) in ((b, x) for b in batches for x in blocks(b.column(1))):
            out = []
            for digest, stored in zip(*(batch.column(k).slice(start, length).to_pylist() for k in range(2))):
                payload, n = from_png(stored)
                out.append((digest, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = list(zip(*out)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return common.written(media.mapInArrow(run, FEATURES).dropDuplicates(["digest"]), "features")


def resolve(elements: DataFrame, features: DataFrame) -> DataFrame:
    """elements with the features of their payload; text and unknown references keep nulls, and every row its position and caption.

    Text has no digest: each such element gets a key that nothing else has, so they don't meet in one task.
    """
    own = F.coalesce("digest", F.concat(F.lit("~"), F.xxhash64("row_id", "position").cast("string"))).alias("_key")
    return elements.select("*", own).join(features.withColumnRenamed("digest", "_key"), "_key", "left").drop("_key")


def assembled(elements: DataFrame) -> DataFrame:
    """(doc_id, elements): a row per page with its elements as array<struct<position, kind, text, src, digest, caption, ...>> in order; empty for a page without any.

    A page's elements come together in one row, as its HTML was; rows are told apart by row_id.
    """
    names = ["position", *(c for c in elements.columns if c not in ("row_id", "doc_id", "position"))]
    each = F.when(F.col("position").isNotNull(), F.struct(*names))  # collect_list leaves nulls out
    return elements.groupBy("row_id", "doc_id").agg(F.sort_array(F.collect_list(each)).alias("elements")).select("doc_id", "elements")


def interleaved(pages: DataFrame, media: DataFrame, id_col: str = "doc_id", html_col: str = "html") -> DataFrame:
    """(doc_id, elements) of every page, with the references to payloads of the media table (digest, media) resolved.

    Null and empty pages have no elements; a null id stays null; repeated rows each give a row; other
    columns are not read; an empty table gives none.
    """
    return assembled(resolve(sequences(pages, id_col, html_col), media_features(media)))


def wrap(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, html): a page that shows each text's payload as a figure."""

    def run(batches):
        for batch in batches:
            for start, length in blocks(batch.column(1)):
                ids, pages = batch.column(0).slice(start, length), []
                for doc, text in zip(ids.to_pylist(), batch.column(1).slice(start, length).to_pylist()):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    pages.append(f'<article><h1>document {doc}</h1><figure><img src="{SCHEME}{reference(padded(data), len(data))}"><figcaption>text of document {doc}</figcaption></figure></article>')
                yield pa.RecordBatch.from_arrays([ids, pa.array(pages, pa.string())], names=["doc_id", "html"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, html string")


def document_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text stored as media, shown on a page, parsed, resolved by digest, and its features read back.

    Null texts are empty and stored as one row of spaces; a null id stays null; repeated rows each
    give a row; other columns are not read; an empty table gives none.
    """
    pages = interleaved(wrap(docs, id_col, text_col), store_media(docs, text_col))
    shown = pages.select("doc_id", F.size("elements").alias("n_elements"), F.filter("elements", lambda x: x["kind"] == "media")[0].alias("m"))
    return shown.select("doc_id", "n_elements", "m.*").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "n_elements")


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(common.table(spark, sf_dir, "documents"))


def pages_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, n_text, n_media, sequence_sha256): every page as an interleaved sequence, with the digest of its elements in order."""
    pages = common.table(spark, sf_dir, "pages")
    none = spark.createDataFrame([], MEDIA)
    found = interleaved(pages, none, "page_id", "html")
    line = F.transform("elements", lambda x: F.concat_ws("\t", x["position"], x["kind"], F.coalesce(x["text"], F.lit("")), F.coalesce(x["src"], F.lit("")), F.coalesce(x["caption"], F.lit(""))))
    many = lambda kind: F.size(F.filter("elements", lambda x: x["kind"] == kind)).cast("long")
    return found.select(F.col("doc_id").alias("page_id"), many("text").alias("n_text"), many("media").alias("n_media"), F.sha2(F.encode(F.array_join(line, "\n"), "UTF-8"), 256).alias("sequence_sha256"))


def documents_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, n_text, n_media, payload_bytes, payloads_sha256, captions): pages that show the texts of up to four documents between paragraphs, interleaved and resolved.

    A page is for the documents whose id divided by four, rounded down, is the same. payloads_sha256 is of the
    payloads' digests, as read back, in order.
    """
    docs = common.table(spark, sf_dir, "documents")

    def run(batches):
        for batch in batches:
            for start, length in blocks(batch.column(1)):
                data = [(x or "").encode("utf-8", "surrogatepass") for x in batch.column(1).slice(start, length).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, length), pa.array([reference(padded(x), len(x)) for x in data], pa.string())], names=["doc_id", "ref"])

    refs = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ref string")
    part = F.concat(F.lit("<p>before "), F.col("doc_id"), F.lit(f'</p><figure><img src="{SCHEME}'), F.col("ref"), F.lit('"><figcaption>text '), F.col("doc_id"), F.lit("</figcaption></figure>"))
    pages = refs.groupBy(F.floor(F.col("doc_id") / 4).alias("page_id")).agg(F.sort_array(F.collect_list(F.struct("doc_id", part.alias("html")))).alias("parts"))  # four documents
    pages = pages.select("page_id", F.concat(F.array_join("parts.html", ""), F.lit("<p>end</p>")).alias("html"))
    found = interleaved(pages, store_media(docs, "text"), "page_id", "html")
    shown = F.filter("elements", lambda x: x["kind"] == "media")
    many = lambda kind: F.size(F.filter("elements", lambda x: x["kind"] == kind)).cast("long")
    told = found.select(F.col("doc_id").alias("page_id"), many("text").alias("n_text"), many("media").alias("n_media"), shown.alias("m"))
    total = F.aggregate("m.payload_bytes", F.lit(0).cast("long"), lambda a, x: a + x)
    return told.select("page_id", "n_text", "n_media", total.alias("payload_bytes"), F.sha2(F.encode(F.array_join("m.payload_sha256", ","), "UTF-8"), 256).alias("payloads_sha256"), F.array_join("m.caption", "; ").alias("captions"))
