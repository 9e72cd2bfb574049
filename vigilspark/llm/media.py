"""Media columns: documents as interleaved sequences of text and media references.

parse() turns HTML into an ordered array of structs, a text or a reference with its caption, without loss of position;
resolve() joins the references to stored payloads by digest and puts them back at their positions. store() keeps any
payload as 8-bit samples of a PCM wave file, in units of FRAME bytes, once for each digest, and describe() reads it back
for its features.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut, hot_keys, join_dealt, map_slices

FRAME, RATE = 64, 8000
ITEM = "struct<pos: int, kind: string, text: string, ref: string, caption: string>"
_MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "media", "embed": "media", "object": "media", "iframe": "media"}
_HIDDEN = ("script", "style", "template", "noscript")
_BREAKS = ("p", "br", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "table", "article", "section", "figure", "blockquote", "pre", "nav", "footer", "header")


class _Sequence(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figure: int | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append({"pos": len(self.items), "kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag in _MEDIA and (ref := a.get("src") or a.get("data")):
            self.flush()
            self.items.append({"pos": len(self.items), "kind": _MEDIA[tag], "text": None, "ref": ref, "caption": a.get("alt") or a.get("title") or None})
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = len(self.items)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in _HIDDEN:
            self.hidden -= 1

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            own = [x for x in self.items[self.figure or 0 :] if x["kind"] != "text"] if self.figure is not None else []
            if own and text:
                own[-1]["caption"] = text
            elif text:
                self.words.append(text)
            self.caption = None
        elif tag in _BREAKS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def sequence(html: str) -> list[dict]:
    parser = _Sequence()
    parser.feed(html)
    parser.close()
    if parser.caption:
        parser.words += parser.caption
    parser.flush()
    return parser.items


def parse(pages: DataFrame, html: str = "html", key: str = "page_id", more: str | None = None) -> DataFrame:
    """pages (key, html) -> (key, items array<struct<pos, kind, text, ref, caption>>), in order of appearance; null or empty: none.

    A caption is the figure's figcaption, else alt or title. Rows that repeat a key are sequences of their own. more: a
    string column that comes along, between key and items.
    """
    along = [more] if more else []

    def kernel(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        whole = data.tobytes()
        rows = [sequence(whole[at[d] : at[d + 1]].decode("utf-8", "replace")) for d in range(len(at) - 1)]
        kind = pa.list_(pa.struct([("pos", pa.int32()), *((c, pa.string()) for c in ("kind", "text", "ref", "caption"))]))
        return batch_of(batch, [key, *along], items=pa.array(rows, kind))

    schema = ", ".join([f"{key} {pages.schema[key].dataType.simpleString()}", *[f"{c} string" for c in along], f"items array<{ITEM}>"])
    return map_slices(pages.select(key, html, *along), kernel, schema, text=html)


def resolve(sequences: DataFrame, media: DataFrame, key: str = "page_id", kind: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """sequences (key, items) -> (key, items) with what media (digest, ...) has of each reference's digest added to the item as `media`.

    A reference is a digest; unknown ones keep a null `media`. Of rows that repeat a digest, the smallest is taken. kind
    restricts the join to items of that kind; the columns in more come along. References, not texts, meet the payloads; a
    digest that many documents share is dealt over SALTS copies of its row.
    """
    rows = sequences.withColumn("__row", F.monotonically_increasing_id())
    kept = cut(rows)  # ids stay the same if a task is run again
    others = [c for c in media.columns if c != "digest"]
    one = media.groupBy("digest").agg(F.min(F.struct(*others)).alias("media"))
    wanted = F.col("i.ref").isNotNull() & (F.lit(True) if kind is None else F.col("i.kind") == kind)
    refs = kept.select("__row", F.explode("items").alias("i")).where(wanted).select("__row", F.col("i.pos").alias("pos"), F.col("i.ref").alias("digest"))
    hot = hot_keys(refs.groupBy("digest").agg(F.count("*").alias("n")), "digest", refs.count())
    met = join_dealt(refs, one, "digest", hot).groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "media"))).alias("__media"))
    added = F.transform("items", lambda i: i.withField("media", F.col("__media")[i["pos"]]))
    return kept.join(met, "__row", "left").select(key, added.alias("items"), *more)


def padded(raw: bytes) -> bytes:
    """raw and bytes 0 up to a positive multiple of FRAME."""
    return raw + b"\0" * (-len(raw) % FRAME if raw else FRAME)


def to_wave(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def samples_of(stored: bytes) -> bytes:
    """The samples of a stored file, by its own header."""
    with wave.open(io.BytesIO(stored), "rb") as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return f.readframes(f.getnframes())


def feature(payload: bytes) -> str:
    """Mean, root mean square around 128 and share of crossings of 128, of the samples as unsigned bytes."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    above = x >= 0
    return f"{x.mean() + 128:.4f},{np.sqrt((x * x).mean()):.4f},{np.count_nonzero(above[1:] != above[:-1]) / max(1, len(x) - 1):.6f}"


def payloads(docs: DataFrame) -> DataFrame:
    """docs (digest, text) -> (digest, packed), a row for each digest: the text deflated, as it moves once to meet its copies."""

    def kernel(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        whole = data.tobytes()
        return batch_of(batch, ["digest"], packed=pa.array([zlib.compress(whole[at[d] : at[d + 1]], 1) for d in range(len(at) - 1)], pa.binary()))

    return map_slices(docs.select("digest", "text"), kernel, "digest string, packed binary").dropDuplicates(["digest"])


def store(packed: DataFrame) -> DataFrame:
    """packed (digest, packed) -> (digest, n_bytes, media binary), a file for each row. Lossless; equal texts give equal files."""

    def kernel(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        texts = [zlib.decompress(data[at[d] : at[d + 1]]) for d in range(len(at) - 1)]
        return batch_of(batch, ["digest"], n_bytes=pa.array([len(t) for t in texts], pa.int64()), media=pa.array([to_wave(padded(t)) for t in texts], pa.binary()))

    return map_slices(packed, kernel, "digest string, n_bytes long, media binary", text="packed")


_TOLD = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(stored: DataFrame) -> DataFrame:
    """stored (digest, n_bytes, media) -> (digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), read back from the files."""

    def kernel(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        whole, rows = data.tobytes(), []
        for d in range(len(at) - 1):
            file = whole[at[d] : at[d + 1]]
            payload = samples_of(file)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(file), hashlib.sha256(file).hexdigest(), feature(payload)))
        columns = list(zip(*rows, strict=True))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["digest", *(x.split()[0] for x in _TOLD.split(", "))])

    return map_slices(stored, kernel, f"digest string, {_TOLD}", text="media")


def digest(text: Column) -> Column:
    """What a payload goes by: the SHA-256 of its bytes; null: of none."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def with_payload(sequences: DataFrame, payload: Column) -> DataFrame:
    """sequences (key, items) with a last item of kind `payload` that refers to the document's own stored file."""
    own = F.struct(F.size("items").alias("pos"), F.lit("payload").alias("kind"), F.lit(None).cast("string").alias("text"), payload.alias("ref"), F.lit(None).cast("string").alias("caption"))
    return sequences.withColumn("items", F.array_append("items", own.cast(ITEM)))


def media_report(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> the description of each row's stored payload, met by digest, with the outline of its sequence.

    Every text is parsed as HTML to a sequence of texts and references, to which the reference to its own payload is
    added; each different payload is stored and described once; the references meet the files by digest. n_items and
    n_media tell of the parsed items; sequence_hash is a hash of their positions, kinds, texts, references, captions. Null and empty texts have no items and one frame of zeros as payload. Rows that repeat a doc_id are
    documents of their own. An empty table gives an empty one.
    """
    keyed = docs.select("doc_id", "text", digest(F.col("text")).alias("digest"))
    files = describe(store(payloads(keyed)))
    parsed = parse(keyed, html="text", key="doc_id", more="digest")
    # what is written and sent are outlines: texts of items stay behind their digests
    line = lambda i: F.concat_ws("\x1f", i["pos"].cast("string"), i["kind"], F.coalesce(i["text"], F.lit("")), F.coalesce(i["ref"], F.lit("")), F.coalesce(i["caption"], F.lit("")))
    told = parsed.select(
        "doc_id", "digest", F.transform("items", lambda i: i.withField("text", F.lit(None).cast("string"))).alias("items"),
        F.size("items").cast("long").alias("n_items"), F.size(F.filter("items", lambda i: i["ref"].isNotNull())).cast("long").alias("n_media"),
        F.xxhash64(F.array_join(F.transform("items", line), "\x1e")).alias("sequence_hash"),
    )
    met = resolve(with_payload(told, F.col("digest")).drop("digest"), files, key="doc_id", kind="payload", more=("n_items", "n_media", "sequence_hash"))
    own = F.element_at("items", -1)["media"]
    return met.select("doc_id", *[own[x.split()[0]].alias(x.split()[0]) for x in _TOLD.split(", ")], "n_items", "n_media", "sequence_hash")
