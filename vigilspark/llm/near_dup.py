"""MinHash near-duplicate detection with circulant signatures, banding and exact verification.

Signatures follow the two-permutation scheme: one permutation scatters a shingle over the circle of 2**21 slots, the
second is read at k places shifted by 1, 2, ... k, so that all coordinates of one shingle are one contiguous slice of a
fixed table. A signature is the minimum of such slices over the shingles of a document. BANDS bands of ROWS coordinates
each bring documents together; at the threshold of 0.8, a pair shares no band with a chance of (1 - 0.8**5)**36 = 6e-7.

Documents with equal shingle sets (by 128 bits) are one node. First, each node is held against the smallest node in any
of its buckets. Then, in each bucket that isn't connected yet, all nodes outside the component of the bucket's smallest
node (its pivot) are held against that one, which then leaves the bucket. Buckets that still hold several components are
compared by pairs if they are small. From larger ones, those nodes go first that can't have a partner: with all shingles
in one order, rare ones first, two sets of the wanted similarity have one in common among the first 20 % of each, so that
nodes which share a bucket but differ in their rare shingles are left out by ids alone. What stays and lies in different
components is compared by pairs in small buckets, and in larger ones inside bounded tasks that emit verified links only.
So no link between different texts that share a band is lost, and none is kept without the exact Jaccard check on full
sets. A bucket or shingle with more rows than an average partition is dealt over several tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, join_dealt, map_slices, release
from .components import components
from .shingles import mix, shingle_hashes, word_hashes

SLOT_BITS, ROWS, BANDS = 21, 5, 36
PIVOTS = 1
#: Nodes of a bucket that are compared by pairs; nodes of a larger one that meet in a task; nodes that one is held against at once.
SMALL, GROUP, BLOCK = 12, 2000, 128
#: Candidates' keys are broadcast up to so many rows of 16 bytes; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000

_FIRST = np.uint64(0x5851F42D4C957F2D)  # odd: a permutation of the slots
_circle: np.ndarray | None = None


def _second(k: int) -> np.ndarray:
    """Row s: the second permutation at s, s+1, ... s+k-1, round the circle."""
    global _circle
    if _circle is None:
        order = np.random.RandomState(7).permutation(1 << SLOT_BITS).astype(np.uint32)
        _circle = np.concatenate([order, order[:1024]])
    return np.lib.stride_tricks.sliding_window_view(_circle, k)


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    """k coordinates for a non-empty set of 64-bit hashes, in bounded memory."""
    with np.errstate(over="ignore"):
        slot = (shingles * _FIRST) >> np.uint64(64 - SLOT_BITS)
    table = _second(k)
    out = table[slot[:2048]].min(axis=0)
    for lo in range(2048, len(slot), 2048):
        np.minimum(out, table[slot[lo : lo + 2048]].min(axis=0), out=out)
    return out


def _bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(documents, bands) keys of 64 bits from (documents, bands * rows) coordinates."""
    parts = signatures.reshape(len(signatures), -1, rows).astype(np.uint64)
    key = np.arange(1, parts.shape[1] + 1, dtype=np.uint64)[None, :].repeat(len(parts), 0)
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r] + np.uint64(1))
    return key.view(np.int64)


def _sets(data: np.ndarray, at: np.ndarray, words: int):
    hashes, of = shingle_hashes(*word_hashes(data, at)[:2], words)
    for d in range(len(at) - 1):
        yield np.unique(hashes[of[d] : of[d + 1]])


def _node(own: np.ndarray) -> int:
    """A hash of the whole set."""
    with np.errstate(over="ignore"):
        return int(mix(mix(own + np.uint64(0x1234567)).sum(keepdims=True) + np.uint64(len(own))).view(np.int64)[0])


def _check(own: np.ndarray) -> int:
    """A second hash of the whole set, independent of the first."""
    with np.errstate(over="ignore"):
        return int(mix(mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(keepdims=True) ^ np.uint64(0x0123456789ABCDEF)).view(np.int64)[0])


def sketches(docs: DataFrame, words: int = 2, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, mark, n_shingles, node, bands, check); mark is a hash of the text; node, bands and check are null for a document without shingles."""

    def kernel(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        size, nodes, checks, signed = [], [], [], []
        for own in _sets(data, at, words):
            size.append(len(own))
            nodes.append(_node(own) if len(own) else None)
            checks.append(_check(own) if len(own) else None)
            if len(own):
                signed.append(signature(own, rows * bands))
        keys = _bands(np.array(signed), rows).ravel() if signed else np.zeros(0, np.int64)
        full = np.array(size) > 0
        ends = np.concatenate([[0], np.cumsum(full) * bands]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys), mask=pa.array(~full))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(nodes, pa.int64()), lists, pa.array(checks, pa.int64())], names=["doc_id", "mark", "n_shingles", "node", "bands", "check"])

    return map_slices(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), kernel, "doc_id long, mark long, n_shingles long, node long, bands array<long>, check long")


def told_apart(signed: DataFrame) -> DataFrame:
    """signed (node, check, ...) with nodes of their own for sets that differ, by check, from another set with the same node."""
    clash = cut(signed.where("node is not null").groupBy("node").agg(F.min("check").alias("first"), F.max("check").alias("last")).where("first < last").select("node", "first"))
    if clash.isEmpty():
        return signed
    met = signed.join(clash, "node", "left")
    other = F.col("first").isNotNull() & (F.col("check") != F.col("first"))
    return cut(met.withColumn("node", F.when(other, F.xxhash64("node", "check")).otherwise(F.col("node"))).select(signed.columns))


def node_sets(docs: DataFrame, wanted: DataFrame, words: int = 2) -> DataFrame:
    """wanted (doc_id, node, check), a document for each node -> (node, set), read again from the texts."""

    def kernel(batch: pa.RecordBatch, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        node, sets = [], []
        for n, want, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _sets(data, at, words), strict=True):
            if len(own) and _check(own) == want:  # another row may have the same doc_id
                node.append(n)
                sets.append(own.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    texts = docs.select("doc_id", "text").join(wanted.withColumnRenamed("doc_id", "w"), F.col("doc_id").eqNullSafe(F.col("w"))).select("node", "check", "text")
    return map_slices(texts, kernel, "node long, set array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    one = sets.select(F.col("node").alias("u"), F.col("set").alias("su"))
    two = sets.select(F.col("node").alias("v"), F.col("set").alias("sv"))
    both, nu, nv = F.size(F.array_intersect("su", "sv")).cast("long"), F.size("su").cast("long"), F.size("sv").cast("long")
    near = (F.least(nu, nv) * 100 >= F.greatest(nu, nv) * percent) & (both * 100 >= (nu + nv - both) * percent)
    return pairs.join(one, "u").join(two, "v").where(near).select("u", "v")


def _open_keys(members: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """members (key, node, root) -> (key, n, pivot, proot) of the keys with several roots: how many rows, the smallest node, its root; and their hot keys. Of keys that have the same nodes, one is left."""
    told = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot"), F.min_by("root", "node").alias("proot"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.expr("bit_xor(xxhash64(node))").alias("nodes"))
    told = cut(told.where("lo < hi").groupBy("n", "pivot", "proot", "nodes").agg(F.min("key").alias("key")).select("key", "n", "pivot", "proot"))
    return told, hot_keys(told, "key", told.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _open(members: DataFrame, *columns: str) -> DataFrame:
    """The rows of open keys, with these columns of what is told of the keys."""
    told, hot = _open_keys(members)
    return cut(join_dealt(members, told.select("key", *columns), "key", hot))


def _partners(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """nodes (node, root) -> (node): those that have a shingle of their prefix in common with a node of another root."""
    members = cut(prefix_members(nodes, sets, percent))
    told, hot = _open_keys(members)
    return cut(join_dealt(members.select("key", "node"), told.select("key"), "key", hot, "left_semi").select("node").distinct())


def prefix_members(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """nodes (node, root), distinct -> (key, node, root): each node under the shingles of its prefix, in the order of rare ones first.

    Two sets with 100 * intersection >= percent * union have a key in common: all but ceil(percent %) of a set's shingles,
    and one more, are in its prefix. Shingles of a single node come first in the order and are left out.
    """
    rows = nodes.join(sets, "node").select("node", "root", F.size("set").cast("long").alias("size"), F.explode("set").alias("key"))
    common = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    total = common.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = join_dealt(rows, common, "key", hot_keys(common, "key", total))
    own = met.groupBy("node", "root", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("shared"))
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    rest = (prefix - (F.col("size") - F.size("shared"))).cast("int")
    return own.where(rest > 0).select("node", "root", F.explode(F.slice("shared", F.lit(1), rest)).alias("s")).select("s.key", "node", "root")


def _all_pairs(left: DataFrame) -> DataFrame:
    """The pairs of a bucket in different components, each in one of the buckets that it shares."""
    own = left.join(left.groupBy("node").agg(F.collect_set("key").alias("keys")), "node")
    other = own.select(F.col("key").alias("k"), F.col("node").alias("v"), F.col("root").alias("other"), F.col("keys").alias("others"))
    once = F.expr("key = k and root < other and array_min(array_intersect(keys, others)) = key")
    return own.join(other, once).select(F.col("node").alias("u"), "v")


def _linker(percent: int):
    """For nodes of a bucket: a link between any two local components that have one; all but the main component's nodes are held against the rest."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["main", "node"], ascending=[False, True], ignore_index=True)
        node, home = rows["node"].to_numpy(), rows["home"].to_numpy()
        sets = [np.sort(x) for x in rows["set"]]
        size = np.array([len(x) for x in sets])
        _, part = np.unique(rows["root"].to_numpy(), return_inverse=True)
        part, out = part.copy(), []
        for o in range(int(rows["main"].sum()), len(node)):
            fits = (np.minimum(size[:o], size[o]) * 100 >= np.maximum(size[:o], size[o]) * percent) & (home[:o] | home[o])
            rest = np.flatnonzero(fits & (part[:o] != part[o]))
            while len(rest):
                block, rest = rest[:BLOCK], rest[BLOCK:]
                joined = np.concatenate([sets[i] for i in block])
                at = np.minimum(np.searchsorted(sets[o], joined), size[o] - 1)
                both = np.add.reduceat(sets[o][at] == joined, np.cumsum(size[block]) - size[block], dtype=np.int64)
                near = block[both * 100 >= (size[block] + size[o] - both) * percent]
                for i in near:
                    if part[i] != part[o]:
                        out.append((node[o], node[i]))
                        part[part == part[i]] = part[o]
                if len(near):
                    rest = rest[part[rest] != part[o]]
        return pd.DataFrame(out, columns=["u", "v"], dtype=np.int64)

    return run


def _bucket_links(sized: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """sized (key, node, root, n): links within buckets. A bucket of over GROUP nodes is dealt over several tasks, in each of which nodes outside its main component meet those that are at home there."""
    each = sized.groupBy("key", "root").agg(F.count("*").alias("m"))
    main = each.groupBy("key").agg(F.max(F.struct("m", "root")).alias("b")).select("key", F.col("b.root").alias("most"))
    tasks = F.ceil(F.col("n") / GROUP).cast("int")
    hot = hot_keys(each.groupBy("key").agg(F.sum("m").alias("n")), "key", sized.count())
    placed = join_dealt(sized, main, "key", hot).select("key", "node", "root", (F.col("root") == F.col("most")).alias("main"), tasks.alias("tasks"), F.pmod(F.xxhash64("node"), tasks).alias("own"))
    dealt = placed.withColumn("salt", F.explode(F.when(F.col("main"), F.array(F.col("own"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("tasks") - F.lit(1).cast("long")))))
    rows = dealt.withColumn("home", F.col("salt") == F.col("own")).join(sets, "node")
    return rows.select("key", "salt", "node", "root", "main", "home", "set").groupBy("key", "salt").applyInPandas(_linker(percent), "u long, v long").distinct()


def linked(docs: DataFrame, words: int = 2, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, mark, n_shingles, node, root): root is the same for all rows that are linked, directly or by others.

    Null, empty or blank texts have no shingles, a null node and root, and are linked with nothing. Rows with equal
    sets have one node, whatever their doc_id; repeated and null doc_ids are rows of their own.
    """
    release(docs)  # what was before doesn't add to the driver's memory
    signed = told_apart(cut(sketches(docs, words, rows, bands)))
    own = signed.where("node is not null")
    shared = cut(own.select("node", F.explode("bands").alias("key")).groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").drop("most"))
    hot = hot_keys(shared, "key", shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    keys = own.groupBy("node").agg(F.first("bands").alias("bands")).select("node", F.explode("bands").alias("key"))
    members = cut(join_dealt(keys, shared.drop("n"), "key", hot))
    wanted = own.select("doc_id", "node", "check").join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("check")).select("doc_id", "node", "check")
    sets = cut(node_sets(docs, cut(wanted), words))
    release(sets)
    # each node and the smallest of all its buckets
    links = cut(_verified(members.groupBy(F.col("node").alias("u")).agg(F.min("least").alias("v")).where("u != v"), sets, percent))
    left = members.select("key", "node")
    del own, shared, hot, keys, members, wanted  # what they have on disk can go
    release(links)
    roots = cut(components(links))
    for turn in range(PIVOTS + 1):
        release(roots)
        left = _open(left.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), *(("pivot", "proot") if turn < PIVOTS else ("n",)))
        release(left)
        if left.isEmpty():
            break
        if turn < PIVOTS:
            found = _verified(left.where("root != proot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct(), sets, percent)
            left = left.where("node != pivot").select("key", "node")
        else:
            small = F.col("n") <= SMALL
            found = _verified(_all_pairs(left.where(small).select("key", "node", "root")), sets, percent)
            left = left.where(~small).select("key", "node", "root")
            left = _open(left.join(_partners(left.select("node", "root").distinct(), sets, percent), "node", "left_semi"), "n")
            release(left)
            found = found.union(_verified(_all_pairs(left.where(small).select("key", "node", "root")), sets, percent))
            found = found.union(_bucket_links(left.where(~small).select("key", "node", "root", "n"), sets, percent))
        links = cut(links.union(found))
        del found, roots
        release(links)
        roots = cut(components(links))
    return signed.drop("bands", "check").join(roots, "node", "left").select("doc_id", "mark", "n_shingles", "node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_shingles, component_id, kept), a row for each row of docs.

    component_id is the smallest doc_id that links reach; null where all of these are null. A document without shingles
    is its own component. kept is whether doc_id is component_id (both null: true). An empty table gives an empty one.
    """
    rows = linked(docs, words, percent)
    own = rows.where("root is not null")
    least = own.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = own.join(least, "root").unionByName(rows.where("root is null").withColumn("component_id", F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 2, percent: int = 80) -> DataFrame:
    """The rows of docs without all but one of each group of near duplicates: that of the smallest doc_id.

    All columns stay as they are. Rows without shingles all stay. Of rows that repeat a kept doc_id within a group, one stays.
    """
    rows = linked(docs, words, percent)
    chosen = cut(rows.where("root is not null").groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("c")).select(F.col("c.doc_id").alias("__kept"), F.col("c.mark").alias("__mark"), F.col("root").alias("__root")))
    marked = docs.withColumn("__blank", ~F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))
    same = F.col("doc_id").eqNullSafe(F.col("__kept")) & (F.xxhash64("text") == F.col("__mark"))
    kept = marked.join(chosen, same, "left").where("__blank or __root is not null")
    again = rows.groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("i"), F.col("mark").alias("m"))
    if not again.join(chosen, F.col("i").eqNullSafe(F.col("__kept")) & (F.col("m") == F.col("__mark"))).isEmpty():
        kept = kept.where("__blank").unionByName(kept.where("not __blank").dropDuplicates(["__root"]))
    return kept.select(docs.columns)
