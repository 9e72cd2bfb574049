"""Document fingerprints as threshold-scaled sketches, with built-in DataFrame functions only.

A fingerprint holds every hash of a 5-word shingle that lies below a fixed fraction of the hash range (1 in SCALE). Which
hashes these are doesn't depend on the document, so fingerprints of any sizes can be merged by union, and shares of one
in another estimate containment also between very unequal documents. A text with words but no hash below the threshold
keeps its smallest hash, so that its fingerprint isn't empty; merged() drops it again where the union has one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS, SCALE = 5, 2
#: Successors of ids are found in ranges of 2**STEP_BITS ids, then among the ranges, and so on.
STEP_BITS = 16
#: Neighbouring documents meet in ranges of 2**RANGE_BITS ids.
RANGE_BITS = 7
_SPACE = " \t\n\x0b\f\r"


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """Sorted array of hashes of 61 bits for the shingles of a text; null, empty and blank texts: an empty one.

    Words are split at ASCII white space after A-Z are lower-cased; a text of fewer words is one shingle.
    """
    ascii_lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bare = F.btrim(F.coalesce(ascii_lower, F.lit("")), F.lit(_SPACE))
    split = F.when(F.length(bare) > 0, F.split(bare, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>"))
    hashed = F.transform(split, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(n >= words, many).when(n > 0, F.array(F.xxhash64(h, F.lit(1)))).otherwise(F.array().cast("array<long>"))

    # each let() keeps a long expression from being computed again where it is named twice
    return _let(_let(hashed, shingles), lambda s: _kept(s, scale))


def _kept(s: Column, scale: int) -> Column:
    """The distinct hashes below the threshold, sorted; the smallest of all if there are none."""
    top = (1 << 63) // scale
    low = F.filter(s, lambda x: (x >= -top) & (x < top))
    return F.when(F.size(low) > 0, F.array_sort(F.array_distinct(low))).when(F.size(s) > 0, F.array(F.array_min(s))).otherwise(low)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda x: F.lower(F.hex(x))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all; two empty ones: 1."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, 1.0).otherwise(both / total)


def containment(a: Column, b: Column) -> Column:
    """Share of a's hashes that b has; an empty a: 1."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of all shingles of both."""
    return _let(F.array_union(a, b), lambda s: _kept(s, scale))


def successors(ids: DataFrame, bits: int = 64) -> DataFrame:
    """ids (id), distinct longs -> (id, next): the next larger one, after the largest the smallest. No task sees more than 2**STEP_BITS ids of a range."""
    if bits <= STEP_BITS:
        return ids.select("id", F.coalesce(F.lead("id").over(Window.orderBy("id")), F.min("id").over(Window.partitionBy())).alias("next"))
    ranged = ids.withColumn("range", F.shiftright("id", STEP_BITS))
    within = ranged.withColumn("next", F.lead("id").over(Window.partitionBy("range").orderBy("id")))
    heads = ranged.groupBy("range").agg(F.min("id").alias("head"))
    later = successors(heads.select(F.col("range").alias("id")), bits - STEP_BITS).select(F.col("id").alias("range"), F.col("next").alias("following"))
    follow = later.join(heads.select(F.col("range").alias("following"), "head"), "following").select("range", "head")
    return within.join(follow, "range").select("id", F.coalesce("next", "head").alias("next"))


def with_next(docs: DataFrame, added: dict[str, Column] | None = None) -> DataFrame:
    """docs (doc_id, text), neither null -> with `next`, a struct of the text of the next larger doc_id (after the largest: the smallest) and of what is added.

    added: columns made of a row's text once it is where its neighbours are; the rows have them too. Texts move once, to
    ranges of 2**RANGE_BITS ids; the first document of the range that follows comes along as a ghost. Of rows that repeat
    a doc_id, the smallest text is the next one.
    """
    ranged = docs.withColumn("range", F.shiftright("doc_id", RANGE_BITS))
    heads = ranged.groupBy("range").agg(F.min(F.struct("doc_id", "text")).alias("h"))
    order = successors(ranged.select(F.col("range").alias("id")).distinct()).select(F.col("id").alias("of"), F.col("next").alias("range"))
    ghosts = heads.join(order, "range").select("h.doc_id", "h.text", F.col("of").alias("range"), F.lit(True).alias("ghost"))
    every = ranged.withColumn("ghost", F.lit(False)).unionByName(ghosts).repartition("range").withColumns(added or {})
    own = ["text", *(added or {})]
    ahead = F.lead(F.struct("doc_id", "ghost", F.struct(*own).alias("own"))).over(Window.partitionBy("range").orderBy("ghost", "doc_id", "text"))
    every = every.withColumn("ahead", ahead)
    # the last of the rows with one doc_id has the next doc_id ahead
    other = F.when((F.col("ahead.doc_id") != F.col("doc_id")) | F.col("ahead.ghost"), F.col("ahead.own"))
    every = every.withColumn("next", F.max(other).over(Window.partitionBy("range", "ghost", "doc_id")))
    return every.where("not ghost").select("doc_id", *own, "next")


def fingerprints(docs: DataFrame, words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, kept_in_edited).

    A null text is empty. The next document is that of the next larger doc_id, after the largest that of the smallest;
    of rows that repeat its doc_id, the smallest text. kept_in_edited is the containment of a text's sketch in the edited
    text's. Rows with a null doc_id come next to nothing: nothing replaces the end of their text, and near_next compares
    with an empty text. An empty table gives an empty one.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = {"print": sketch(F.col("text"), words, scale)}
    none = F.struct(F.lit("").alias("text"), F.array().cast("array<long>").alias("print"))
    met = with_next(base.where("doc_id is not null"), own).unionByName(base.where("doc_id is null").withColumns(own).withColumn("next", none))
    size = F.length("text")
    part = F.floor(size / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), size - part), F.col("next.text").substr(F.lit(1), part))
    met = met.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), "print", F.col("next.print").alias("next_print"))
    met = met.withColumn("edited_print", sketch(F.col("edited"), words, scale))
    return met.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
        containment(F.col("print"), F.col("edited_print")).alias("kept_in_edited"),
    )
