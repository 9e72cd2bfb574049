"""Mixing sources to target weights by capped water-filling, with built-in DataFrame functions only.

Each source's target is min(cap, level * weight), where one level makes the targets sum to the wanted total: the point
at which clamping sources at their caps and resharing the excess by weight comes to rest. A source with a target of r
times its size is taken floor(r) times as a whole; the rest is filled in a seeded order of its documents, by their sizes,
and ends within one document. That order is cut by a two-level prefix sum: over hash buckets, then within the one bucket
where the target falls, so no source is ever sorted as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SEED = 17
EPOCHS = 2.0
SHARE = 1.5
WEIGHTS = (5, 2, 1)
BUCKETS = 16384
#: Prefix sums over buckets go by stretches of 2**BUCKET_BITS of them.
BUCKET_BITS = 7
_SPACE = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Words by ASCII white space; null: 0."""
    bare = F.btrim(text, F.lit(_SPACE))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 0).otherwise(F.size(F.split(bare, "[ \\t-\\r]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """sizes (source, source_size), one row each -> with target. Sources take the weights in turn, by code point, null last."""
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    caps = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs)
    # in the order in which sources reach their caps as the level rises
    order = Window.orderBy((F.col("cap") / F.col("weight")), "k")
    filled = caps.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    level = filled.withColumn("level", (total - F.col("before")) / F.col("open"))
    # the first source that its level doesn't clamp fixes the level of all from there on
    free = level.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "k", "level"))).over(Window.partitionBy())["level"])
    return free.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def _order_key(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, source, text) -> (doc_id, size, source_size, target, taken), a row for each row.

    Null texts have size 0; a null source is a source. Documents of size 0 are taken with 0 words. Rows that repeat a
    doc_id follow each other in the order, smaller sizes first; which of equal ones comes first makes no difference to
    the rows returned. All sizes 0: all targets 0. An empty table gives an empty one.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return _mixed(sized, weights, share, epochs, seed, buckets).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def _mixed(sized: DataFrame, weights: tuple[int, ...], share: float, epochs: float, seed: int, buckets: int) -> DataFrame:
    """sized (doc_id, source, size, ...) -> with source_size, target, whole repetitions and part, the words taken beyond them. Texts are counted once: what is told of them is written first."""
    sized = sized.withColumn("key", _order_key(seed))
    sized = cut(sized.withColumn("bucket", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % buckets).cast("int")))
    per_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("high", F.shiftright("bucket", BUCKET_BITS))
    per_high = per_bucket.groupBy("source", "high").agg(F.sum("words").alias("words"))
    targets = source_targets(per_high.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, epochs)
    r = F.col("target") / F.col("source_size")
    whole = F.when(F.col("source_size") > 0, F.floor(r)).otherwise(0).cast("long")
    goal = targets.withColumn("whole", whole).withColumn("extra", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    # words before a bucket: those of its stretch of buckets, and those of the stretches before that one
    ahead = lambda w: F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    high = per_high.withColumn("lead", ahead(Window.partitionBy("source").orderBy("high"))).select(F.col("source").alias("hs"), F.col("high").alias("hh"), "lead")
    within = per_bucket.withColumn("before", ahead(Window.partitionBy("source", "high").orderBy("bucket")))
    placed = within.join(high, F.expr("source <=> hs and high = hh")).join(goal.withColumnRenamed("source", "gs"), F.expr("source <=> gs"))
    before = F.col("lead") + F.col("before")
    state = placed.select(
        F.col("source").alias("s"), F.col("bucket").alias("b"), "source_size", "target", "whole",
        (F.col("extra") - before).alias("room"), (before + F.col("words") <= F.col("extra")).alias("all"), (before >= F.col("extra")).alias("none"),
    )
    joined = sized.join(state, F.expr("source <=> s and bucket = b"))
    sure = joined.where("all or none").withColumn("part", F.when(F.col("all"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("s", "b").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.where("not (all or none)").withColumn("prior", F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("room") - F.col("prior")))).drop("prior")
    columns = [c for c in sized.columns if c not in ("key", "bucket")] + ["source_size", "target", "whole", "part"]
    return sure.select(columns).unionByName(edge.select(columns))


def repeat_by_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """The mixed corpus, with the columns of docs: every row as often as it is taken, a partly taken one cut behind its words.

    A cut text has single spaces between its words, and n_chars, if there, is its length; there is one in a source at most.
    Rows that repeat a doc_id, source and text share what is taken of them, one after the other. Null, empty and blank
    texts have no words to take and go. An empty table gives an empty one.
    """
    mark = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5("text"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mark.alias("mark"))
    taken = _mixed(sized, weights, share, epochs, seed, buckets).where("size > 0")
    taken = taken.groupBy(F.col("mark").alias("__mark"), F.col("size").alias("__n")).agg(F.max("whole").alias("__whole"), F.sum("part").alias("__parts"), F.count("*").alias("__rows")).where("__whole > 0 or __parts > 0")
    met = docs.withColumn("__mark", mark).join(taken, "__mark")
    n = F.col("__n")
    others = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    before = F.when(F.col("__rows") > 1, F.row_number().over(Window.partitionBy("__mark").orderBy(F.xxhash64(*others))) - 1).otherwise(0)
    own = F.greatest(F.lit(0).cast("long"), F.least(n, F.col("__parts") - before * n))
    met = met.withColumn("__own", own)
    cuts = F.array_compact(F.concat(F.array_repeat(n, F.col("__whole").cast("int")), F.array(F.when(F.col("__own") > 0, F.col("__own")))))
    rows = met.withColumn("__cut", F.explode(cuts))
    words = F.slice(F.split(F.btrim("text", F.lit(_SPACE)), "[ \\t-\\r]+"), F.lit(1), F.col("__cut").cast("int"))
    part = F.col("__cut") < n
    rows = rows.withColumn("text", F.when(part, F.array_join(words, " ")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(part, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(docs.columns)
