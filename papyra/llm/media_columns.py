"""Interleaved documents: ordered text and media references, and the media that they refer to.

Media lie in a store, a table of digests and lossless greyscale PNG files of 8-bit samples. HTML is parsed into a
sequence of text and media-reference structs; references name their payload by its digest and are resolved by a
join on it, each with its own position and caption.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import columns_but, text_or_empty, written

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
LEVEL = 3
STEP = 64
SEQUENCE = "array<struct<position:int,kind:string,text:string,media:string,caption:string>>"


# -- payloads and files ------------------------------------------------------------------------------------------


def payload_of(text: Column) -> Column:
    """text as UTF-8 with zero bytes up to a positive multiple of WIDTH; a null text is empty."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.octet_length(data)
    pad = F.when(size == 0, WIDTH).otherwise((WIDTH - size % WIDTH) % WIDTH)
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), pad)))


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def write_png(payload: bytes) -> bytes:
    """A greyscale image, WIDTH samples a row, of a payload whose size is a multiple of WIDTH."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), dtype=np.uint8)  # a leading 0 a row: no filter
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _part(b"IHDR", header) + _part(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _part(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """The samples, [row, column], of a file that write_png made; ValueError if it is damaged."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at, shape, packed = 8, None, []
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"checksum of {kind!r} differs")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit greyscale file without filters")
    return np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(shape[1], shape[0] + 1)[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Mean sample and a 64-bit average hash: which of 8 by 8 areas are brighter than the mean."""
    rows = len(samples)
    edges = np.arange(8) * rows // 8
    columns = samples.reshape(rows, 8, WIDTH // 8).sum(axis=2, dtype=np.int64)
    ends = np.maximum(np.arange(1, 9) * rows // 8, edges + 1)
    sums = np.concatenate([np.zeros((1, 8), dtype=np.int64), np.cumsum(columns, axis=0)])
    areas = (sums[ends] - sums[edges]) / ((ends - edges) * (WIDTH // 8))[:, None]
    mean = float(sums[-1].sum()) / samples.size
    bits = np.packbits((areas > mean).ravel()).tobytes().hex()
    return f"{mean:.4f}:{bits}"


# -- store -------------------------------------------------------------------------------------------------------


def store(df: DataFrame, payload_col: str = "payload") -> DataFrame:
    """The media store of df's payloads: digest (SHA-256 of the payload) and stored (PNG), written to the shared folder.

    Payloads that are null or no positive multiple of WIDTH bytes fail. Each task writes what it reads: payloads
    are not shuffled, and a payload that several tasks hold is stored by each.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                made: dict[bytes, bytes] = {}
                for payload in batch.slice(start, STEP).column(0).to_pylist():
                    if (digest := hashlib.sha256(payload).digest()) not in made:
                        made[digest] = write_png(payload)
                yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.binary()), pa.array(list(made.values()), pa.binary())], names=["digest", "stored"])

    return written(df.select(payload_col).mapInArrow(run, "digest binary, stored binary"), "media", compression="none")


def describe(media: DataFrame) -> DataFrame:
    """What the store's files hold, read back: a row a digest, written to the shared folder.

    digest, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. Only these move; hot
    digests are reduced in each task before the shuffle.
    """

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part, rows = batch.slice(start, STEP), []
                for digest, stored in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    samples = read_png(stored)
                    payload = samples.tobytes()
                    rows.append(
                        (digest, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).digest(), feature_of(samples))
                    )
                kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                values = zip(*rows, strict=True) if rows else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(values, kinds, strict=True)], names=names)

    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    schema = "digest binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"
    rows = media.select("digest", "stored").mapInArrow(run, schema)
    return written(rows.groupBy("digest").agg(F.first(F.struct(*names[1:])).alias("media")).select("digest", "media.*"), "described")


# -- sequences ---------------------------------------------------------------------------------------------------


class _Sequence(HTMLParser):
    """Text, then media, as they come; a figure's caption belongs to the media of that figure, before or after it, and is text
    if there are none. A head whose end tag is left out ends where something begins that a head can't hold."""

    BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li tr article section figure figcaption header footer nav blockquote pre br ul ol table".split())
    SILENT = frozenset(("script", "style", "template"))
    HEAD = frozenset("html head title meta link base script style template noscript".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.silent, self.head, self.inner, self.caption, self.unseen = [], [], 0, False, None, None, []
        self.begin_figure(False)

    def begin_figure(self, inside: bool) -> None:
        self.inside, self.figure, self.words, self.waiting = inside, [], "", None

    def parse_marked_section(self, i, report=1):
        """The text of a CDATA section is text; other marked sections, which HTML hasn't, are passed over up to the next >."""
        if self.rawdata.startswith("<![CDATA[", i):
            end = self.rawdata.find("]]>", i)
            if end < 0:
                return -1
            self.handle_data(self.rawdata[i + 9 : end])
            return end + 3
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else -1

    def finish(self) -> None:
        """The end of the page: what was not closed is closed, and a template that never ended was none."""
        left, self.rawdata = self.rawdata, ""
        self.silent, unseen = 0, "".join(self.unseen)
        for data in (unseen, left.partition("<![CDATA[")[2]):
            if data:
                self.handle_data(data)
        self.close_caption()
        self.flush()

    def flush(self) -> None:
        if words := " ".join("".join(self.text).split()):
            self.out.append({"kind": "text", "text": words, "media": None, "caption": None})
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag == "head":
            self.head = True
        elif tag not in self.HEAD and not self.silent:
            self.head, self.inner = False, None
        elif self.head and tag in ("title", "noscript"):
            self.inner = tag
        if tag in self.SILENT:
            self.silent += 1
        if tag in self.BLOCKS:
            self.flush()
        if tag in ("figure", "figcaption"):
            self.close_caption()
        if tag == "figure":
            self.begin_figure(True)
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video") and (source := dict(attrs).get("src")):
            self.flush()
            if self.inside and self.waiting:  # the caption came first
                self.out = [x for x in self.out if x is not self.waiting]
                self.waiting = None
            self.out.append({"kind": "media", "text": None, "media": source, "caption": (self.inside and self.words) or dict(attrs).get("alt")})
            self.figure.append(self.out[-1])

    def handle_endtag(self, tag):
        if tag in self.SILENT and self.silent:
            self.silent -= 1
            if not self.silent:
                self.unseen = []
        if tag == "head":
            self.head = False
        if tag == self.inner:
            self.inner = None
        if tag == "figcaption" and self.caption is not None:
            self.close_caption()
        if tag == "figure":
            self.close_caption()
            self.begin_figure(False)
        if tag in self.BLOCKS:
            self.flush()

    def close_caption(self):
        if self.caption is None:
            return
        words, self.caption = " ".join("".join(self.caption).split()), None
        if not words:
            return
        self.words = f"{self.words} {words}".strip() if self.inside else words
        for media in self.figure:
            media["caption"] = self.words
        if not self.figure:
            self.flush()
            if self.inside and self.waiting:
                self.waiting["text"] = self.words
            else:
                self.waiting = {"kind": "text", "text": words, "media": None, "caption": None}
                self.out.append(self.waiting)

    def handle_data(self, data):
        if self.head and not self.silent and not self.inner and data.strip():
            self.head = False
        if self.silent and not self.cdata_elem:
            self.unseen.append(data)
        if self.silent or self.head:
            return
        (self.text if self.caption is None else self.caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    """position, kind (text or media), text, media (the reference as written) and caption of each element in order."""
    parser = _Sequence()
    parser.feed(html or "")
    try:
        parser.close()
    except AssertionError:
        pass  # a declaration that the end of the page cuts off
    parser.finish()
    return [{"position": i, **x} for i, x in enumerate(parser.out)]


def interleave(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df with html_col replaced by ``sequence``. A null or empty page has an empty sequence; broken HTML never fails.

    A column of df that is called sequence is replaced; other columns go through, whatever their names.
    """
    keep = columns_but(df, html_col, "sequence")
    element = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())]))

    def run(batches):
        for batch in batches:
            parsed = pa.array([parse_sequence(x) for x in batch.column(len(keep)).to_pylist()], type=element)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), parsed], names=[*keep, "sequence"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name in keep)
    return df.select(*(f"`{c}`" for c in keep), F.col(f"`{html_col}`").alias("__html")).mapInArrow(run, f"{kept}sequence {SEQUENCE}")


def resolve(sequences: DataFrame, described: DataFrame, scheme: str = "sha256:") -> DataFrame:
    """A row a media reference: the other columns of sequences, position, caption, and ``media``, what the store has.

    References are ``scheme`` and the payload's digest in hexadecimal; others, and digests that the store lacks, have a
    null media. Columns of sequences that are called position, caption or media are replaced. Both sides of the join come
    from a shuffle of their own, so Spark can split a hot digest.
    """
    keep = columns_but(sequences, "sequence", "position", "caption", "media")
    elements = sequences.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.explode("sequence").alias("element")).where("element.kind = 'media'")
    source = F.col("element.media")
    digest = F.when(source.startswith(scheme), F.expr(f"try_to_binary(substring(element.media, {len(scheme) + 1}), 'hex')"))
    own = described.select(F.col("digest").alias("stored_digest"), F.struct(*described.columns).alias("media"))
    return (
        elements.withColumn("digest", digest)
        .join(own, F.col("digest") == F.col("stored_digest"), "left")
        .select("row.*", F.col("element.position").alias("position"), F.col("element.caption").alias("caption"), "media")
    )


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a stored image in an interleaved document, resolved: id_col, n_bytes, position, caption, media.

    A null text counts as empty; null ids and rows that repeat an id are rows of their own; no rows, no rows out.
    """
    payload = payload_of(F.col(text_col).cast("string"))
    described = describe(store(docs.select(payload.alias("payload"))))
    pages = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.octet_length(F.encode(text_or_empty(text_col), "UTF-8")).cast("long").alias("n_bytes"))
    html = F.concat(
        F.lit("<article><p>A text of "), F.col("n_bytes").cast("string"), F.lit(' bytes</p><figure><img src="sha256:'),
        F.sha2(payload_of(F.col("t").cast("string")), 256), F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit("</figcaption></figure></article>"),
    )
    return resolve(interleave(pages.select("id", "n_bytes", html.alias("html"))), described).withColumnRenamed("id", id_col)
