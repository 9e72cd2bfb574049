"""Removal of long repeated byte strings, with suffixes ordered by deep-shallow sorting.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Only few suffixes have to be sorted:
the windows (strings of LENGTH bytes) of a text fall into blocks of consecutive ones that have the same anchor, the
leftmost smallest hash of their GRAM-byte strings. Equal windows have the same anchor at the same place, so
  - a block whose anchor occurs once in all texts has no repeated window;
  - a block with the same bytes as another one has repeated windows only; the 128-bit BLAKE2 digest of the bytes tells;
  - of the rest, one block of each content meets the others of its anchor, and the suffixes at its windows are sorted:
    multikey quicksort on 8-byte characters to a shallow depth, then a blind trie for each group that is equal so far.
Blocks that repeat within a text, as in periodic ones, leave it as runs and one block of each content. An anchor with
many different blocks is split into salted groups of bounded size, and the windows that are single in their group are
counted over all groups by a 128-bit hash, with partial sums before the shuffle. Texts go by their 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, binary_buffers, bound_batches, cut, hot_keys, join_dealt, map_slices
from .shingles import _BYTE, mix

LENGTH, GRAM = 400, 128
#: Bytes that quicksort looks at before the tries take over, and groups that go to a trie at once.
SHALLOW, SMALL = 24, 24
#: Different blocks of an anchor that are sorted in one group: 11 MB of text, 4.5 million windows at most.
GROUP = 16384

_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(n + (1 << 20), base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = np.multiply.accumulate(steps)
    return _powers[base]


def _running_min(x: np.ndarray, w: int) -> np.ndarray:
    """out[i] = min(x[i : i + w])."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    full = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    grid = full.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def find_blocks(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Document, first and last window start (within the slice) and anchor's hash of each block; blocks of equal bytes have the same anchor at the same place."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _pow(_BASE, len(data))[: len(data)], out=sums[1:])
        back = _pow(_UNBASE, len(data) + 1)
        grams = mix((sums[gram:] - sums[:-gram]) * back[: len(data) - gram + 1])
    bits = max(1, int(len(data)).bit_length())
    low = np.uint64((1 << bits) - 1)
    places = np.arange(len(grams), dtype=np.uint64)
    anchor = (_running_min((grams & ~low) | places, length - gram + 1) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= at[1:][doc]
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none, none, none, none
    key = anchor[starts]
    head = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[starts][1:] != doc[starts][:-1])])
    s0 = starts[head]
    s1 = starts[np.concatenate([np.flatnonzero(head)[1:] - 1, [len(starts) - 1]])]
    return doc[s0], s0, s1, grams[key[head]].view(np.int64)


def block_rows(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[list[np.ndarray], list[bytes]]:
    """Document, first and last window start (within it), anchor and number n of blocks, and their contents' digests.

    A content that a text has several times is one row with their number; runs of such blocks are rows too, with the
    anchor of their first, n of 0 and an empty digest: all of their windows are repeated.
    """
    d, s0, s1, anchor = find_blocks(data, at, length, gram)
    raw, ends = memoryview(data.tobytes()), (s1 + length).tolist()
    content = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(s0.tolist(), ends, strict=True)]
    count = np.ones(len(d), np.int64)
    key = anchor.view(np.uint64) ^ mix(d.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    if len(same):  # anchors that a text has several times
        first: dict[tuple[int, bytes], int] = {}
        for i in np.unique(order[np.concatenate([same, same + 1])]).tolist():
            one = first.setdefault((int(d[i]), content[i]), i)
            if one != i:
                count[one] += 1
                count[i] = 0
        on = np.flatnonzero(count != 1)
        apart = np.concatenate([[True], (np.diff(on) > 1) | (d[on][1:] != d[on][:-1])]) if len(on) else np.zeros(0, bool)
        heads = on[apart]
        tails = on[np.append(np.flatnonzero(apart)[1:], len(on)) - 1] if len(on) else heads
        keep = np.flatnonzero(count > 0)
        content = [content[i] for i in keep.tolist()] + [b""] * len(heads)
        d, s0, s1, anchor, count = (np.concatenate([x[keep], y]) for x, y in ((d, d[heads]), (s0, s0[heads]), (s1, s1[tails]), (anchor, anchor[heads]), (count, np.zeros(len(heads), np.int64))))
    return [d, s0 - at[d], s1 - at[d], anchor, count], content


class BlindTrie:
    """A trie of strings of one length that keeps only where and by which bytes they part."""

    def __init__(self, length: int):
        self.length, self.root = length, None

    def add(self, text: bytes, item) -> None:
        if self.root is None:
            self.root = (self.length, text, [item])
            return
        node = self.root
        while node[0] < self.length:  # blindly to some leaf
            kids = node[1]
            node = kids.get(text[node[0]]) or next(iter(kids.values()))
        if node[1] == text:
            node[2].append(item)
            return
        other = node[1]
        apart = self.length - ((int.from_bytes(text) ^ int.from_bytes(other)).bit_length() + 7) // 8
        parent, node = None, self.root
        while node[0] < apart:
            parent, node = node, node[1][text[node[0]]]
        leaf = (self.length, text, [item])
        if node[0] == apart:
            node[1][text[apart]] = leaf
        else:
            new = (apart, {text[apart]: leaf, other[apart]: node}, None)
            if parent is None:
                self.root = new
            else:
                parent[1][text[parent[0]]] = new

    def leaves(self):
        """Items of equal strings, in the order of the strings."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] == self.length:
                yield node[2]
            else:
                todo += [kid for _, kid in sorted(node[1].items(), reverse=True)]


def sorted_classes(data: bytes, starts: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW):
    """Classes of equal strings data[s : s + length], in their order: arrays of indices into starts."""
    raw = np.frombuffer(data + b"\0" * 8, np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)
    todo = [(np.arange(len(starts)), 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) == 1:
            yield group
        elif len(group) <= SMALL or depth >= min(shallow, length - 8):
            trie = BlindTrie(length)
            for i in group.tolist():
                s = starts[i]
                trie.add(data[s : s + length], i)
            yield from map(np.array, trie.leaves())
        else:
            chars = np.ascontiguousarray(words[starts[group] + depth]).view(">u8").ravel()
            pivot = np.partition(chars, len(chars) // 2)[len(chars) // 2]
            less, same, more = chars < pivot, chars == pivot, chars > pivot
            todo += [(group[x], depth + 8 * (x is same)) for x in (more, same, less) if x.any()]


def _window_hashes(data: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the strings of `length` bytes at begins."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _pow(_BASE, len(data))[: len(data)], out=sums[1:])
        return mix((sums[begins + length] - sums[begins]) * _pow(_UNBASE, len(data) + 1)[begins])


def _equal_windows(rows: pa.Table, length: int) -> pa.RecordBatch:
    """For whole groups of blocks (same anchor and salt, next to each other): ranges of windows with an equal one in their group, and in split groups a 128-bit hash of one window of each class.

    Windows whose 64-bit hash is single in their group have no equal one; only the rest are sorted, which tells by their bytes.
    """
    at = {n: k for k, n in enumerate(rows.column_names)}
    column = lambda n: rows.column(at[n]).to_numpy()
    data, ends = binary_buffers(rows.column(at["content"]))
    anchor, salt, s0, split = (column(n) for n in ("anchor", "salt", "s0", "split"))
    mark = rows.column(at["mark"])
    group = np.cumsum(np.concatenate([[False], (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])]))
    count = column("s1") - s0 + 1
    block = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    begins = ends[block] + step
    with np.errstate(over="ignore"):
        keyed = mix(_window_hashes(data, begins, length) + group[block].astype(np.uint64) * np.uint64(_BASE))
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    often = np.zeros(len(keyed), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    raw, equal, hashed = data.tobytes(), np.zeros(len(keyed), bool), []

    def digest(i: int) -> None:
        b = int(begins[i])
        hashed.append((int(block[i]), int(s0[block[i]] + step[i]), hashlib.blake2b(raw[b : b + length], digest_size=16).digest()))

    for i in np.flatnonzero(~often & split[block]).tolist():
        digest(i)
    picked = np.flatnonzero(often)
    for own in np.split(picked, np.flatnonzero(np.diff(group[block[picked]])) + 1) if len(picked) else []:
        lo = int(begins[own].min())
        part = raw[lo : int(begins[own].max()) + length]
        for members in sorted_classes(part, begins[own] - lo, length):
            if len(members) > 1:
                equal[own[members]] = True
            if split[block[own[members[0]]]]:
                digest(int(own[members[0]]))
    # runs of repeated windows of a block
    on = np.flatnonzero(equal)
    first = np.concatenate([[True], (np.diff(on) > 1) | (block[on][1:] != block[on][:-1])]) if len(on) else np.zeros(0, bool)
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(on)) - 1 if len(on) else heads
    start = s0[block] + step
    marks = mark.take(pa.array(block[on[heads]].tolist() + [m for m, _, _ in hashed], pa.int64()))
    low = start[on[heads]].tolist() + [s for _, s, _ in hashed]
    high = start[on[tails]].tolist() + [s for _, s, _ in hashed]
    hashes = [None] * len(heads) + [h for _, _, h in hashed]
    return pa.RecordBatch.from_arrays([marks.combine_chunks(), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(hashes, pa.binary())], names=["mark", "s0", "s1", "hash"])


def _sorter(length: int):
    """Over batches ordered by anchor and salt: whole groups at a time, some SLICE_BYTES together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size >= SLICE_BYTES:
                rows = pa.Table.from_batches(held).combine_chunks()
                anchor, salt = rows.column("anchor").to_numpy(), rows.column("salt").to_numpy()
                last = np.flatnonzero((anchor != anchor[-1]) | (salt != salt[-1]))
                whole = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
                for lo, hi in _cuts(rows, anchor, salt, whole):
                    yield _equal_windows(rows.slice(lo, hi - lo), length)
                held = rows.slice(whole).to_batches()
                size = sum(b.nbytes for b in held)
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            for lo, hi in _cuts(rows, rows.column("anchor").to_numpy(), rows.column("salt").to_numpy(), rows.num_rows):
                yield _equal_windows(rows.slice(lo, hi - lo), length)

    return run


def _cuts(rows: pa.Table, anchor: np.ndarray, salt: np.ndarray, end: int) -> Iterator[tuple[int, int]]:
    """Slices of whole groups, of some SLICE_BYTES of content each."""
    sizes, lo = binary_buffers(rows.column("content"))[1], 0
    heads = np.append(np.flatnonzero((anchor[1:end] != anchor[: end - 1]) | (salt[1:end] != salt[: end - 1])) + 1, end) if end else []
    for h in heads:
        if sizes[h] - sizes[lo] >= SLICE_BYTES or h == end:
            yield lo, int(h)
            lo = int(h)


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs (mark, text), mark a 128-bit hash of the text -> (mark, s0, s1): ranges of window starts that are repeated."""

    def blocks(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        (d, *rest), content = block_rows(data, at, length, gram)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), *(pa.array(x.astype(np.int64)) for x in rest), pa.array(content, pa.binary())], names=["mark", "s0", "s1", "anchor", "n", "content"])

    def anchors(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(find_blocks(data, at, length, gram)[3])], names=["anchor"])

    rows = map_slices(docs, blocks, "mark binary, s0 long, s1 long, anchor long, n long, content binary")
    often = cut(map_slices(docs, anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    busy = hot_keys(often, "anchor", often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    hot = cut(join_dealt(rows, often.select("anchor"), "anchor", busy, "left_semi"))
    runs, hot = hot.where("n = 0").select("mark", "s0", "s1"), hot.where("n > 0")
    kinds = cut(hot.groupBy("content").agg(F.sum("n").alias("n"), F.min(F.struct("mark", "s0", "s1", "anchor")).alias("one")))
    many = kinds.where("n > 1").select("content", "n")
    sure = join_dealt(hot.select("mark", "s0", "s1", "content"), many.select("content"), "content", hot_keys(many, "content", hot.count()), "left_semi").select("mark", "s0", "s1").union(runs)
    # anchors with a block that has no equal, and more than one kind of block
    met = kinds.select("one.*", "n")
    open_ = cut(met.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("anchor", "kinds"))
    full = hot_keys(open_.withColumnRenamed("kinds", "n"), "anchor", open_.agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0])
    meet = join_dealt(met.drop("n"), open_, "anchor", full)
    per_doc = meet.groupBy("mark").agg(F.collect_list(F.struct("anchor", "kinds", "s0", "s1")).alias("blocks"))
    texts = per_doc.join(docs.dropDuplicates(["mark"]), "mark")
    raw = texts.select("mark", F.col("text").cast("binary").alias("raw"), F.explode("blocks").alias("b"))
    bytes_ = raw.select("mark", "b.*", F.expr(f"substring(raw, cast(b.s0 + 1 as int), cast(b.s1 - b.s0 + {length} as int))").alias("content"))
    salts = F.ceil(F.col("kinds") / GROUP)
    groups = bytes_.withColumn("split", salts > 1).withColumn("salt", F.pmod(F.xxhash64("mark", "s0"), salts)).drop("kinds")
    bound_batches(docs.sparkSession)
    ordered = groups.select("anchor", "salt", "mark", "s0", "s1", "split", "content").repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    found = cut(ordered.mapInArrow(_sorter(length), "mark binary, s0 long, s1 long, hash binary"))
    across = found.where("hash is not null").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    more = found.where("hash is null").union(found.join(across, "hash", "left_semi").select(found.columns)).select("mark", "s0", "s1")
    return sure.union(more)


def cut_out(text: bytes, starts: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """What is left of text, bytes removed, runs removed; starts: first and last of ranges of window starts."""
    kept, last, spans, removed = [], 0, 0, 0
    end = -1
    for s0, s1 in sorted(starts):
        lo, hi = s0, s1 + length
        if lo > end:
            if end >= 0:
                last = end
            kept.append(text[last:lo])
            spans += 1
            removed += hi - lo
            end = hi
        elif hi > end:
            removed += hi - end
            end = hi
    kept.append(text[max(end, 0) :])
    return b"".join(kept), removed, spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row.

    Null texts are empty; texts under `length` bytes lose nothing; rows with equal texts, of whatever doc_id, lose all
    that is at least so long. An empty table gives an empty one.
    """
    marked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.unhex(F.md5("text")))
    copies = hot_keys(marked.groupBy("mark").agg(F.count("*").alias("n")), "mark", docs.count())
    ranges = repeated_starts(marked.select("mark", "text"), length, gram)
    per_doc = ranges.distinct().groupBy("mark").agg(F.collect_list(F.struct("s0", "s1")).alias("starts"))

    def kernel(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        whole = data.tobytes()
        out = defaultdict(list)
        for d, starts in enumerate(batch.column(2).to_pylist()):
            text = whole[at[d] : at[d + 1]]
            kept, removed, spans = cut_out(text, [(x["s0"], x["s1"]) for x in starts or ()], length)
            for k, v in (("n_bytes", len(text)), ("n_removed", removed), ("n_spans", spans), ("kept_sha256", hashlib.sha256(kept).hexdigest())):
                out[k].append(v)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.string() if k == "kept_sha256" else pa.int64()) for k, v in out.items())], names=["doc_id", *out])

    met = join_dealt(marked, per_doc, "mark", copies, "left").select("doc_id", "text", "starts")
    return map_slices(met, kernel, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
