"""Mixing sources to target weights (operator 4), DataFrame functions only.

Targets: the sources, by code point with null last, take the weights in
turn, share all words by weight, and stop at ``max_repeat`` times their own
size; the excess is reshared among the others (closed form: the water level
is the largest level over the sources sorted by cap / weight).

Copies: systematic sampling.  Within a source the documents stand in a fixed
order (size class, largest first, then a seeded hash of the id); each expects
target / source size copies; the running sum plus one seeded offset per
source emits a document once per integer boundary it crosses.  Ordering by
size keeps the taken words within about one long document of the target.

Scale: the running sum is two-level.  Documents are counted per (source,
size class, hash bucket), a cumulative sum over that table gives each bucket
its offset, and only documents of one bucket meet in a window, so a source
with a third of all rows is spread over some hundred thousand buckets.
Single-task windows run over one row per source (a class list) only.

Cases: a null text has size 0; a null source is a source of its own; a
source without words has target 0 and is not taken.  Rows without id, or
repeated ids, are ordered by their other values; equal rows are
interchangeable.  Extra columns pass through; input columns named like an
output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from countframe.functions.hashing import hash16, md5_key

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SEED = 5
WORD = r"[^\x20\x09-\x0D]+"


def size_class(size: Column) -> Column:
    """Number of digits and the first two digits: grows with the size."""
    digits = size.cast("string")
    return F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): one row per source."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", place.alias("place"), weight.cast("bigint").alias("w"),
                     (F.col("source_size") * max_repeat).alias("cap"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), "place")
    before = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything)
    s = s.withColumn("level", (total - before).cast("double") / open_weight.cast("double"))
    level = F.max("level").over(everything)
    return s.select("source", "source_size",
                    F.least(F.col("cap").cast("double"), F.col("w").cast("double") * level).alias("target"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", row_id: str = "doc_id",
        weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """``docs`` plus size, source_size, target, copies and taken (words)."""
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    key = F.coalesce(F.col(f"`{row_id}`").cast("string"), F.lit("null"))
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"__cf_{i}") for i, c in enumerate(names)],     # flat, so that unused ones are pruned
        F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n")).alias("skey"),
        F.xxhash64(*[F.col(f"`{c}`") for c in names]).alias("tie"),
        md5_key(key, seed).alias("draw"), F.floor(hash16(key, seed) / 64).cast("int").alias("bucket"),
    ).withColumn("class", size_class(F.col("size")))
    place = ["skey", "class", "bucket"]
    buckets = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    sizes = (buckets.groupBy("skey").agg(F.sum("words").alias("source_size"))
             .select(F.when(F.col("skey") != "n", F.substring("skey", 2, 1 << 30)).alias("source"), "source_size"))
    targets = source_targets(sizes, weights, max_repeat).select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), "source_size", "target")
    run = Window.partitionBy("skey").orderBy(F.col("class").desc(), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (buckets.select(*place, F.coalesce(F.sum("n").over(run), F.lit(0)).alias("offset"))
               .join(targets, "skey"))
    rank = F.col("offset") + F.row_number().over(Window.partitionBy(*place).orderBy("draw", "size", "tie"))
    start = hash16(F.col("skey"), seed + 1) / 65536.0
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    crossed = (F.floor(rate * F.col("rank") + start) - F.floor(rate * (F.col("rank") - 1) + start)).cast("bigint")
    return (rows.join(offsets, place).withColumn("rank", rank).withColumn("copies", crossed)
            .select(*[F.col(f"__cf_{i}").alias(c) for i, c in enumerate(names)], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def emit(mixed: DataFrame, copy: str = "copy") -> DataFrame:
    """One row per taken copy, numbered from 1."""
    return (mixed.where("copies > 0")
            .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
