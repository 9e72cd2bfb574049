"""Quality classifier: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text, thresholded by language.

The model is of whole characters, the last CHARACTERS of them, spelled without loss by 64 symbols: small letters, the usual
white space and the full stop are one symbol, other ASCII and a letter of the usual two-byte scripts two, an ideograph
three; ORDER symbols at most, so that fewer ideographs fit. An own symbol marks a word that repeats the one before it, so
that text which stutters is as surprising as odd symbols. Breaks stand before a text and end it, and fill the n-grams of
fewer symbols; these go through the orders between unchanged. N-grams are counted over all trusted documents
and summed by shards of the model, which hold all n-grams whose contexts end in the same DENSE symbols; so orders above
DENSE are put together within a shard, and only the orders up to DENSE, CLASSES ** DENSE probabilities, are a table that
goes to tasks. Scoring joins as well: documents are dealt into shards of their own, whose distinct n-grams meet the
model's shards and come back as bits. A document's bits per byte are drawn towards the median of its language by PRIOR
bytes, as a few bytes tell little; it is rejected if they exceed the QUANTILE of its language's trusted documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, release, slices
from .shingles import word_hashes

BITS, ORDER, DENSE, CHARACTERS = 6, 10, 3, 5
CLASSES = 1 << BITS
PRIOR, QUANTILE, ACCURACY = 64, 0.995, 10_000
#: Thresholds of so many languages are broadcast; those of more are joined by a shuffle.
LANGUAGES = 10_000
#: Shards of the model, and bytes of text in a shard of documents.
BUCKETS, SHARD_BYTES = 512, 8 << 20
#: A task that counts gives away its sums once it has so many n-grams.
HELD = 4 << 20
#: N-grams that are looked up in one go.
LOOKED_UP = 1 << 20
#: Codes whose places are found in one go.
PLACED = 2 << 20
#: Symbols from SHIFT on; LEADS lie between SHIFT and SPACE, the second of an escaped byte is its low bits.
SHIFT, OWN, SPACE, BREAK, STOP, LOW, HIGH, LEAD, REPEATED = 26, 27, 57, 58, 59, 60, 61, 62, 63
#: First bytes that are one symbol: those of Latin, Greek, Cyrillic, Hebrew and Arabic letters and of all three-byte characters.
LEADS = np.r_[0xC2:0xC6, 0xCE:0xD2, 0xD6:0xDC, 0xE0:0xF0]


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """The first symbol of each byte, and its second (REPEATED: none)."""
    byte = np.arange(256)
    first = np.select([byte < 64, byte < 128, byte < 192], [LOW, HIGH, byte & 63], LEAD).astype(np.uint8)
    second = np.where((byte >= 128) & (byte < 192), REPEATED + 1, byte & 63).astype(np.uint8)
    first[65:91], second[65:91] = SHIFT, np.arange(26)
    for own, symbols in ((slice(97, 123), np.arange(26)), (LEADS, OWN + np.arange(len(LEADS))), (32, SPACE), (10, BREAK), (46, STOP)):
        first[own], second[own] = symbols, REPEATED + 1
    return first, second


_FIRST, _SECOND = _symbols()
#: The bits that an n-gram of so many symbols has, and the breaks that fill the others.
_HAS = np.array([(1 << BITS * n) - 1 for n in range(ORDER + 1)], np.uint64)
_FILL = np.array([sum(BREAK << BITS * k for k in range(n, ORDER)) for n in range(ORDER + 1)], np.uint64)


def _reach(first: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """How many symbols the n-gram has that ends in each of n symbols: the whole characters that fit, CHARACTERS at most. first: the first symbol of each character; begin: that of each text, and n."""
    least = np.repeat(begin[:-1], np.diff(np.searchsorted(first, begin)))
    from_ = np.concatenate([np.zeros(CHARACTERS - 1, first.dtype), first])[: len(first)]
    reach = np.arange(1, n + 1) - np.repeat(np.maximum(from_, least), np.diff(np.append(first, n)))
    wide = np.flatnonzero(reach > ORDER)
    character = np.searchsorted(first, wide, "right") - 1
    for back in range(CHARACTERS - 2, -1, -1):
        reach[wide] = wide + 1 - np.maximum(first[np.maximum(character - back, 0)], least[character])
        still = reach[wide] > ORDER
        wide, character = wide[still], character[still]
    return np.minimum(reach, ORDER)


def gram_codes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of the n-gram that ends in each symbol and in the break after each text, ORDER symbols of BITS bits, filled with breaks; where each text's codes begin; which texts have words."""
    data, at = np.insert(data, at[1:], 10), at + np.arange(len(at))
    words, of, first = word_hashes(data, at)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[of[:-1][of[:-1] < len(words)]] = False
    again = np.zeros(len(data), bool)
    again[first[same] - 1] = True  # the byte of white space before a repeated word
    second = _SECOND[data]
    two = second < CLASSES
    end = np.cumsum(1 + two + again, dtype=np.int64)
    begin = np.concatenate([[0], end])[at]
    own = np.empty(begin[-1], np.uint64)
    own[end - 1 - two] = _FIRST[data]
    own[(end - 1)[two]] = second[two]
    own[(end - 2 - two)[again]] = REPEATED
    starts = (data & 0xC0) != 0x80
    starts[at[:-1]] = True
    reach = _reach((end - 1 - two - again)[starts], begin, len(own))
    code, have = own, 1
    while have < ORDER:  # what the n-gram of `have` symbols that ends before it has, as far as it fits
        code, earlier = code.copy(), code
        code[have:] |= earlier[:-have] << np.uint64(BITS * have)
        have *= 2
    return (code & _HAS[reach]) | _FILL[reach], begin, np.diff(of) > 0


def _bucket(grams: np.ndarray) -> np.ndarray:
    """The model's shard, by the last DENSE symbols of the context."""
    context = (grams.astype(np.uint64) >> np.uint64(BITS)) & np.uint64((1 << BITS * DENSE) - 1)
    return (((context * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)) * np.uint64(BUCKETS) >> np.uint64(32)).astype(np.int32)


def _dealt(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted n-grams -> their order by shard, the shards that occur, and where each begins in it."""
    bucket = _bucket(grams)
    order = np.argsort(bucket, kind="stable")
    buckets, start = np.unique(bucket[order], return_index=True)
    return order, buckets, np.append(start, len(grams))


def _packed(grams: np.ndarray) -> bytes:
    """Sorted n-grams as differences, byte by byte of all, which compresses."""
    return np.diff(grams, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _summed(grams: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, sorted, and the sums of their counts."""
    order = np.argsort(grams, kind="stable")
    grams, n = grams[order], n[order]
    start = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
    return grams[start], np.add.reduceat(n, start) if len(start) else n


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, sorted, and how often each occurs; a hash table is quicker than sorting all."""
    of, grams = pd.factorize(codes)
    order = np.argsort(grams)
    return grams[order], np.bincount(of, minlength=len(grams))[order]


def count_grams(docs: DataFrame) -> DataFrame:
    """docs (text) -> (bucket, grams, n): the distinct n-grams of each shard of the model, sorted, and their counts; summed in each task, then by shard."""
    bound_batches(docs.sparkSession)
    schema = "bucket int, grams binary, n binary"

    def given(grams: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order, buckets, start = _dealt(grams)
        cuts = list(zip(start[:-1], start[1:]))
        packed = [_packed(grams[order[lo:hi]]) for lo, hi in cuts]
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(packed, pa.binary()), pa.array([n[order[lo:hi]].astype("<i8").tobytes() for lo, hi in cuts], pa.binary())], names=["bucket", "grams", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, waiting = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
        for _, data, at in slices(batches):
            if len(data):
                parts.append(_counted(gram_codes(data, at)[0]))
                waiting += len(parts[-1][0])
            if waiting > HELD // 2:
                held = _summed(*(np.concatenate(x) for x in zip(held, *parts)))
                parts, waiting = [], 0
            if len(held[0]) > HELD:
                yield given(*held)
                held = (held[0][:0], held[1][:0])
        held = _summed(*(np.concatenate(x) for x in zip(held, *parts)))
        if len(held[0]):
            yield given(*held)

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        grams, n = _summed(np.concatenate([_unpacked(g) for g in rows["grams"]]), np.concatenate([np.frombuffer(x, "<i8") for x in rows["n"]]))
        return pd.DataFrame({"bucket": rows["bucket"].iloc[:1].to_numpy(), "grams": [_packed(grams)], "n": [n.astype("<i8").tobytes()]})

    return docs.select("text").mapInArrow(run, schema).groupBy("bucket").applyInPandas(total, schema)


def _shorter(grams: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of one order less, and how many different symbols come before each."""
    return np.unique(grams & np.uint64((1 << BITS * (order - 1)) - 1), return_counts=True)


def _orders(grams: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Distinct n-grams and counts of all orders above DENSE, highest first; all of them lie in one shard."""
    for k in range(ORDER, DENSE, -1):
        yield k, grams, n
        if k > DENSE + 1:
            grams, n = _shorter(grams, k)


def _discounts(n: np.ndarray) -> list[float]:
    """What n-grams seen once, twice and more often give away, by how many were seen once to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [min(float(k), max(0.0, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.0 for k in (1, 2, 3)]


def _seen(n: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5]


def _interpolated(asked: np.ndarray, below: np.ndarray, grams: np.ndarray, n: np.ndarray, discounts: list[float]) -> np.ndarray:
    """Probabilities of n-grams of one order, from those of the next lower one, the sorted n-grams seen and their counts."""
    if not len(grams):
        return below
    gives = np.array([0.0, *discounts])[np.minimum(n, 3)]
    contexts, start = np.unique(grams >> np.uint64(BITS), return_index=True)
    totals = np.add.reduceat(n.astype(np.float64), start)
    context = asked >> np.uint64(BITS)
    of = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
    at = np.minimum(np.searchsorted(grams, asked), len(grams) - 1)
    own = np.where(grams[at] == asked, (n - gives)[at], 0.0)
    return np.where(contexts[of] == context, (own + np.add.reduceat(gives, start)[of] * below) / totals[of], below)


def _looked_up(asked: np.ndarray, levels: list, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bits of n-grams, from a shard's orders above DENSE, highest first; and those by counts without one occurrence of each, which a lower order loses if the higher one had no other."""
    lost, found = np.ones(len(asked), bool), []
    for k, grams, n, gives, contexts, totals, given in levels:
        own = asked & np.uint64((1 << BITS * k) - 1)
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        count = np.where(grams[at] == own, n[at], 0)
        of = np.minimum(np.searchsorted(contexts, own >> np.uint64(BITS)), len(contexts) - 1)
        lost = lost & (count > 0)
        found.append((gives, count, np.where(contexts[of] == own >> np.uint64(BITS), totals[of], 0), given[of], lost))
        lost = lost & (count == 1)
    p = less = dense[asked & np.uint64(len(dense) - 1)].astype(np.float64)
    for gives, count, total, given, lost in reversed(found):
        own, left = gives[np.minimum(count, 3)], count - lost
        p = np.where(total > 0, (count - own + given * p) / np.maximum(total, 1), p)
        own, given = gives[np.minimum(left, 3)], given - own + gives[np.minimum(left, 3)]
        less = np.where(total > lost, (left - own + given * less) / np.maximum(total - lost, 1), less)
    return _bits(p), _bits(less)


class Model:
    """counts (bucket, grams, n) in shards, the discounts of each order, and a dense table of the probabilities of order DENSE."""

    def __init__(self, counts: DataFrame, discounts: dict[int, list[float]], dense: np.ndarray):
        self.counts, self.discounts, self.dense = counts, discounts, dense

    def kernel(self):
        """The function that looks n-grams up in a shard of the model: (n-grams, the shard's packed n-grams, their counts) -> bits, and bits if each had been seen once less."""
        discounts, dense = self.discounts, self.dense

        def run(asked: np.ndarray, packed: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
            levels = []
            for k, grams, each in _orders(_unpacked(packed), np.frombuffer(n, "<i8")) if packed else ():
                gives = np.array([0.0, *discounts[k]])
                contexts, start = np.unique(grams >> np.uint64(BITS), return_index=True)
                levels.append((k, grams, each, gives, contexts, np.add.reduceat(each, start), np.add.reduceat(gives[np.minimum(each, 3)], start)))
            parts = [_looked_up(asked[lo : lo + LOOKED_UP], levels, dense) for lo in range(0, len(asked), LOOKED_UP)]
            return tuple(np.concatenate([np.zeros(0, np.float16), *x]) for x in (zip(*parts) if parts else ((), ())))

        return run

    def __getitem__(self, at: int | slice) -> np.ndarray:
        """The bits of a few n-grams."""
        codes = np.arange(*at.indices(1 << BITS * ORDER), dtype=np.uint64) if isinstance(at, slice) else np.array([at], np.uint64)
        asked, run = codes, self.kernel()
        out, bucket = np.empty(len(asked), np.float16), _bucket(asked)
        rows = {r.bucket: r for r in self.counts.where(F.col("bucket").isin(np.unique(bucket).tolist())).collect()}
        for b in np.unique(bucket).tolist():
            r = rows.get(b)
            out[bucket == b] = run(asked[bucket == b], bytes(r.grams) if r else b"", bytes(r.n) if r else b"")[0]
        return out if isinstance(at, slice) else out[0]


def model(docs: DataFrame) -> Model:
    """The model of all texts of docs; uniform if there are none.

    How often n-grams of the orders above DENSE were seen, and the continuation counts of order DENSE, CLASSES ** DENSE at
    most, are all that the driver gets.
    """
    counts = cut(count_grams(docs))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (k, key, n): for an order k above DENSE how many n-grams were seen `key` times, for DENSE itself the n-grams."""
        seen, lower = np.zeros((ORDER + 1, 4), np.int64), np.zeros(1 << BITS * DENSE, np.int64)
        for batch in batches:
            for packed, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, grams, each in _orders(_unpacked(packed), np.frombuffer(n, "<i8")):
                    seen[k] += _seen(each)
                    if k == DENSE + 1:
                        short, before = _shorter(grams, k)
                        lower[short] += before
        k, key = np.nonzero(seen)
        own = np.flatnonzero(lower)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, np.full(len(own), DENSE)).astype(np.int32)), pa.array(np.append(key, own).astype(np.int32)), pa.array(np.append(seen[k, key], lower[own]))], names=["k", "key", "n"])

    rows = counts.select("grams", "n").mapInArrow(told, "k int, key int, n long").groupBy("k", "key").agg(F.sum("n").alias("n")).toPandas()
    seen = {k: np.zeros(4) for k in range(1, ORDER + 1)}
    for k in range(DENSE + 1, ORDER + 1):
        of = rows[rows["k"] == k]
        seen[k][of["key"].to_numpy()] = of["n"].to_numpy()
    of = rows[rows["k"] == DENSE].sort_values("key")
    lower = {DENSE: (of["key"].to_numpy().astype(np.uint64), of["n"].to_numpy())}
    for k in range(DENSE, 0, -1):
        seen[k] = _seen(lower[k][1])
        lower[k - 1] = _shorter(lower[k][0], k)
    discounts = {k: _discounts(n) for k, n in seen.items()}
    dense = np.full(1 << BITS * DENSE, 1 / CLASSES)
    for k in range(1, DENSE + 1):
        dense = _interpolated(np.arange(len(dense), dtype=np.uint64) & np.uint64((1 << BITS * k) - 1), dense, *lower[k], discounts[k])
    return Model(counts, discounts, dense.astype(np.float32))


def _bits(p: np.ndarray) -> np.ndarray:
    return -np.log2(np.maximum(p, 2.0**-24)).astype(np.float16)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): the doc_ids all of whose labels say quality 1, and whether one doesn't say toxic 0."""
    good, pure = F.coalesce(F.col("quality") == 1, F.lit(False)), F.coalesce(F.col("toxic") == 0, F.lit(False))
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(good).alias("good"), (~F.min(pure)).alias("toxic")).where("good").select("doc_id", "toxic")


def learned(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of all rows of docs whose doc_id is trusted and not toxic; the ids, not the texts, are held in memory."""
    pure = ids.where("not toxic").select("doc_id")
    return docs.select("doc_id", "text").join(pure.hint("shuffle_hash"), "doc_id", "left_semi").select("text")


def _distinct(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """The distinct n-grams of all texts, sorted."""
    held, parts = np.zeros(0, np.uint64), []
    for _, data, at in slices(batches):
        parts.append(pd.unique(gram_codes(data, at)[0]))
        if sum(map(len, parts)) > HELD // 2:
            held, parts = np.unique(np.concatenate([held, *parts])), []
    return np.unique(np.concatenate([held, *parts]))


def _in_shards(docs: DataFrame) -> DataFrame:
    """docs with a shard by id and text, SHARD_BYTES of text in each on average."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(size // SHARD_BYTES + 1)).cast("int"))


def _asked(docs: DataFrame) -> DataFrame:
    """docs (shard, text) -> (shard, bucket, grams): the distinct n-grams of each shard of documents, by shards of the model."""

    def run(rows: pa.Table) -> pa.Table:
        grams = _distinct(rows.to_batches())
        order, buckets, start = _dealt(grams)
        packed = [_packed(grams[order[lo:hi]]) for lo, hi in zip(start[:-1], start[1:])]
        return pa.table({"shard": pa.array([rows["shard"][0].as_py()] * len(buckets), pa.int32()), "bucket": pa.array(buckets, pa.int32()), "grams": pa.array(packed, pa.binary())})

    return docs.select("shard", "text").groupBy("shard").applyInArrow(run, "shard int, bucket int, grams binary")


def _answered(asked: DataFrame, known: Model) -> DataFrame:
    """asked (shard, bucket, grams) -> (shard, bucket, bits, less), from a join with the model's shards; less: the bits if each n-gram had been seen once less."""
    kernel = known.kernel()

    def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        grams = [_unpacked(g) for g in rows["grams"]]
        bits = kernel(np.concatenate([np.zeros(0, np.uint64), *grams]), own["grams"].iloc[0] if len(own) else b"", own["n"].iloc[0] if len(own) else b"")
        parts = [[x.tobytes() for x in np.split(each, np.cumsum([len(g) for g in grams])[:-1])] if grams else [] for each in bits]
        return pd.DataFrame({"shard": rows["shard"], "bucket": rows["bucket"], "bits": parts[0], "less": parts[1]})

    return asked.groupBy("bucket").cogroup(known.counts.groupBy("bucket")).applyInPandas(run, "shard int, bucket int, bits binary, less binary")


def _placed(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each PLACED codes: where they begin, the distinct ones, and which of them each is."""
    for lo in range(0, len(codes), PLACED):
        of, own = pd.factorize(codes[lo : lo + PLACED])
        yield lo, own, of.astype(np.int32)


def _sums(begin: np.ndarray, placed: list, grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The sum of the bits of each text's n-grams, which are all among the sorted `grams`."""
    out = np.zeros(len(begin) - 1)
    for lo, own, of in placed:
        total = np.concatenate([[0.0], np.cumsum(bits[np.searchsorted(grams, own)][of])])
        out += np.diff(total[np.clip(begin - lo, 0, len(of))])
    return out


def score(docs: DataFrame, known: Model) -> DataFrame:
    """docs (doc_id, lang, text), the model -> (doc_id, lang, mark, n_bytes, bits, less), bits per byte; null for a text without words. mark is a hash of the text; less is what a text that was learned would have had, about, if it had not been.

    Texts move twice to their shards, first for the n-grams to ask for, then to meet the answers; what the first move
    wrote is gone before the second.
    """
    bound_batches(docs.sparkSession)
    shards = _in_shards(docs.select("doc_id", "lang", "text"))
    answers = cut(_answered(_asked(shards), known))
    release(answers)
    names = ["doc_id", "lang", "mark", "n_bytes", "bits", "less"]

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        each, begins, without, placed = [np.zeros(0, np.int64)], [], [np.zeros(0, bool)], []
        for _, data, at in slices(rows.to_batches()):
            codes, begin, wordy = gram_codes(data, at)
            each.append(np.diff(at))
            begins.append(begin)
            without.append(~wordy)
            placed.append(list(_placed(codes)))
        grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *(own for x in placed for _, own, _ in x)]))
        order, buckets, start = _dealt(grams)
        each = np.concatenate(each)
        means = []
        for name in names[-2:]:
            by_bucket = dict(zip(told["bucket"].to_pylist(), told[name].to_pylist()))
            bits = np.empty(len(grams))
            for b, lo, hi in zip(buckets.tolist(), start[:-1], start[1:]):
                bits[order[lo:hi]] = np.frombuffer(by_bucket[b], np.float16)
            total = np.concatenate([np.zeros(0), *(_sums(begin, x, grams, bits) for begin, x in zip(begins, placed))])
            means.append(pa.array(total / np.maximum(each, 1), mask=np.concatenate(without)))
        return pa.table([rows["doc_id"], rows["lang"], rows["mark"], pa.array(each), *means], names=names)

    texts = shards.withColumn("mark", F.xxhash64("text"))
    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(run, "doc_id long, lang string, mark long, n_bytes long, bits double, less double")


def _drawn() -> Column:
    return (F.col("bits") * F.col("n_bytes") + F.col("median") * PRIOR) / (F.col("n_bytes") + PRIOR)


def _with(rows: DataFrame, known: DataFrame, value: Column, quantile: float, name: str) -> DataFrame:
    """rows with the quantile of known's values in their language, or in all languages where it has none; mergeable sketches, so no language is sorted as a whole."""
    quantile_ = F.percentile_approx(value, quantile, ACCURACY)
    per = cut(known.where("lang is not null").groupBy("lang").agg(quantile_.alias(name)).withColumnRenamed("lang", "of"))
    every = known.agg(quantile_.alias(name)).first()[0]
    met = rows.join(F.broadcast(per) if per.count() <= LANGUAGES else per, F.col("lang") == F.col("of"), "left").drop("of")
    return met.withColumn(name, F.coalesce(name, F.lit(every).cast("double")))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """docs (doc_id, lang, text), labels (doc_id, quality, toxic) -> (doc_id, lang, mark, n_bytes, bits, perplexity, threshold, kept), a row for each row of docs.

    perplexity is that of a byte, drawn to its language's median; threshold is in it; that of all trusted documents serves
    a null language and one without trusted documents. Texts without words (null, empty, blank) have no perplexity and are
    rejected. Without any trusted document, all others are kept. Rows that repeat a doc_id are judged each by its own
    text. An empty table gives an empty one. Other columns don't matter. The model learns from all trusted documents
    that aren't toxic; thresholds go by all of them, as toxicity isn't what it judges, and by what those it learned from
    would have had otherwise, as texts that it doesn't know have more bits.
    """
    ids = cut(trusted_ids(labels))
    known_ = model(learned(docs, ids))
    release(ids)  # the texts that were counted
    scored = cut(score(docs, known_))
    release(scored)  # the texts that were scored
    known = cut(scored.where("bits is not null").join(ids, "doc_id").select("lang", "n_bytes", F.when(F.col("toxic"), F.col("bits")).otherwise(F.col("less")).alias("bits")))
    median = (F.col("bits"), 0.5, "median")
    limit = (_drawn(), quantile, "limit")
    out = _with(_with(scored, known, *median), _with(known, known, *median), *limit).withColumn("drawn", F.coalesce(_drawn(), "bits"))
    kept = F.col("bits").isNotNull() & F.coalesce(F.col("drawn") <= F.col("limit"), F.lit(True))
    return out.select("doc_id", "lang", "mark", "n_bytes", "bits", F.pow(F.lit(2.0), "drawn").alias("perplexity"), F.pow(F.lit(2.0), "limit").alias("threshold"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that classify() keeps, all columns as they are; null, empty and blank texts go, repeated rows stay or go together. An empty table gives an empty one."""
    good = classify(docs, labels, **options).where("kept").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__mark")), "left_semi")
