"""Bounded-space online packing of token sequences.

Each partition holds a fixed number of open windows. A document's full windows go out by themselves; what remains goes
to the open window that it fills best. Where none fits, the fullest goes out, topped up by a cut if that saves more than
TOP_UP tokens, and a new one opens. What is still open at the ends of the partitions is merged, window by window.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bound_batches, cut

TOKENIZER = "byte_bpe_50k.json"
SIZE, OPEN, TOP_UP = 1024, 32, 32
#: Partitions whose leftovers meet in one task.
FAN_IN_BITS = 8
#: Words whose ids a worker remembers, and the longest of them.
REMEMBER, REMEMBER_CHARS = 300_000, 64
assert sys.byteorder == "little" and array("I").itemsize == 4

_encoders: dict[str, "WordIds"] = {}


#: How byte-level BPE files write bytes: printable ones of Latin-1 as they are, the rest from U+0100 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def ranked(path: str) -> tiktoken.Encoding | None:
    """The same vocabulary as ranks, for a loop that merges a word some four times as fast; None where a file isn't a plain byte-level BPE whose merges come by id."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, pre = whole["model"], whole.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or whole.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    vocabulary = model["vocab"]
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    special = {x["content"] for x in whole.get("added_tokens", [])}
    ranks = {bytes(map(_BYTE_OF.__getitem__, t)): i for t, i in vocabulary.items() if t not in special}
    if made != sorted(set(made)) or len(ranks) != 256 + len(made) or sorted(ranks.values())[:256] != sorted(ranks[bytes([b])] for b in range(256)):
        return None
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class WordIds(dict):
    """Ids (little-endian, 4 bytes each) of a space and a word, for a byte-level BPE whose pre-tokens never run on into white space.

    Such a tokenizer can be cut before every run of white space, so the ids of a text are those of its pieces.
    """

    #: A space that doesn't begin a run of white space.
    inner = re.compile(r"[\s\x1c-\x1f] ")

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ranked = ranked(path)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.ranked.encode_ordinary(" " + word)).tobytes() if self.ranked else self.whole(" " + word)
        if len(word) <= REMEMBER_CHARS:
            if len(self) >= REMEMBER:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        first, *words = text.split(" ")
        if self.inner.search(text):
            pieces = [first]
            for w in words:
                if pieces[-1] and not pieces[-1][-1].isspace():
                    pieces.append(w)
                else:
                    pieces[-1] += " " + w
            first, *words = pieces
        return self.whole(first) + b"".join(map(self.__getitem__, words))


def encoder(path: str) -> WordIds:
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


class Windows:
    """The open windows of one partition."""

    def __init__(self, part: int, size: int, limit: int, top_up: int):
        self.size, self.limit, self.top_up = size, limit, top_up
        self.free: list[tuple[int, int]] = []  # room and id, sorted
        self.next = part << 33

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int) -> Iterator[tuple[int, int, int, bool]]:
        """Window, offset there, length and whether that window is still open, for the consecutive pieces of `length` tokens."""
        while length >= self.size:
            yield self.new(), 0, self.size, False
            length -= self.size
        while length:
            at = bisect_left(self.free, (length, -1))
            if at < len(self.free):
                room, w = self.free.pop(at)
            elif len(self.free) < self.limit:
                room, w = self.size, self.new()
            else:
                room, w = self.free.pop(0)  # the fullest
                if room > self.top_up:
                    yield w, self.size - room, room, True
                    length -= room
                continue
            yield w, self.size - room, length, True
            if room > length:
                insort(self.free, (room - length, w))
            return


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"


def place_pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, limit: int = OPEN, top_up: int = TOP_UP) -> DataFrame:
    """docs (doc_id, text) -> a row for each piece; open: its window took pieces one by one, so it may have room left."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or public_tokenizers.path(TOKENIZER)).encode
        windows = Windows(TaskContext.get().partitionId(), size, limit, top_up)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + b"\0\0\0\0"
                start = 0
                for w, offset, length, open_ in windows.place(len(ids) // 4):
                    for x, y in zip(out, (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, w, offset, open_), strict=True):
                        x.append(y)
                    start += length
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:7]), pa.array(out[7], pa.bool_())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def merge_windows(size: int):
    """For the windows of some partitions: best-fit decreasing, whole windows at a time."""

    def run(windows: pd.DataFrame) -> pd.DataFrame:
        free: list[tuple[int, int]] = []
        out = []
        for used, w in sorted(zip(windows["used"].tolist(), windows["window"].tolist(), strict=True), key=lambda x: (-x[0], x[1])):
            at = bisect_left(free, (used, -1))
            room, into = free.pop(at) if at < len(free) else (size, w)
            out.append((w, into, size - room))
            if room > used:
                insort(free, (room - used, into))
        return pd.DataFrame(out, columns=["window", "into", "base"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, limit: int = OPEN, top_up: int = TOP_UP) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    A document's tokens are the ids of its text and a final 0; null and empty texts have that one alone. Pieces of a
    document follow each other without gaps; a sequence's pieces fill it from 0 without gaps. Rows that repeat a doc_id
    are documents of their own; null doc_ids stay null. An empty table gives an empty one.
    """
    pieces = cut(place_pieces(docs, tokenizer, size, limit, top_up))
    used = pieces.where("open").groupBy("window").agg(F.sum("length").alias("used"))
    groups = used.withColumn("near", F.shiftright("window", 33 + FAN_IN_BITS)).groupBy("near")
    merged = groups.applyInPandas(merge_windows(size), "window long, into long, base long")
    moved = pieces.where("open").join(merged, "window").withColumn("offset", F.col("offset") + F.col("base")).withColumn("window", F.col("into"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset"]
    return pieces.where("not open").select(columns).unionByName(moved.select(columns))
