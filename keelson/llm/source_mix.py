"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight that moves linearly over the training run, from above its mean to below it or the other way.
Integrated over the run it gives the source's target. The words of a source, in an order by hash, repeated as often as
the target needs, are its demand; inverting the cumulative demand puts each copy of a document at a training position
between 0 and 1, and a range sort by position is the training order. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keelson.llm.common import whole_text, written

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
#: Slices into which the documents of each source are dealt by hash, so that no source is summed up in one task.
SLICES = 4096
#: How far the weight of even and odd sources moves over the run: from 1 + TILT to 1 - TILT times its mean, or back.
TILT = 0.5


def size_of(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, turn, target) from (source, source_size), one row a source.

    Shares go by weight; a target above MOST_COPIES times its source is cut to that and the excess goes to the others by
    weight, until none is above. That has a closed form: with sources by room, MOST_COPIES * size / weight, ascending,
    the first ones are cut, and the level, words for each unit of weight, of the others is what is left over divided by
    their weight. The window has one row a source.
    """
    turned = sizes.withColumn("turn", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = turned.withColumn("weight", F.array(*map(F.lit, weights))[F.col("turn") % len(weights)])
    weighed = weighed.withColumn("room", MOST_COPIES * F.col("source_size") / F.col("weight"))
    up_to = W.orderBy("room", "turn").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) - MOST_COPIES * F.coalesce(F.sum("source_size").over(up_to), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0)))
    # The first source whose room exceeds the level sets it for all that follow.
    found = weighed.withColumn("level", level).withColumn("free", F.col("room") >= F.col("level"))
    found = found.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("room"), F.col("turn"), F.col("level"))))  .over(everything)["level"])
    capped = F.least(F.col("weight") * F.coalesce("level", F.lit(float("inf"))), (MOST_COPIES * F.col("source_size")).cast("double"))
    return found.select("source", "source_size", "turn", capped.alias("target"))


def position(words: Column, target: Column, turn: Column) -> Column:
    """When the curriculum has asked a source for so many of its words: the inverse of the integrated schedule.

    The schedule is (1 + s) - 2 s t for s = TILT or -TILT, its integral (1 + s) t - s t * t, which is 1 at t = 1.
    """
    share = F.least(F.lit(1.0), words / target)
    s = F.when(turn % 2 == 0, TILT).otherwise(-TILT)
    return ((1 + s) - F.sqrt(F.greatest(F.lit(0.0), (1 + s) * (1 + s) - 4 * s * share))) / (2 * s)


def _number(digest: Column) -> Column:
    """The first 60 bits of a digest in hexadecimal."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def text_number(text: str = "text") -> Column:
    """What plan() tells texts apart by, its text_hash."""
    return _number(F.md5(whole_text(text).cast("binary")))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row a document: (key, source, size, source_size, target, copies, taken, positions).

    Copies are whole documents: the k-th copy is taken if its middle word comes before the target in the source's
    repeated order, so a source misses its target by half a document at most, and no document has more than MOST_COPIES.
    A null text has size 0 and a null source is a source. Rows are told apart by key, then text hash; rows equal in both
    are interchangeable and each counts. The order within a source is by a digest of key and text, so copies of a text
    and rows of one key are dealt apart. Empty texts take no words and no positions. Reruns agree. An empty table gives
    an empty one. Other columns are not read. A long text costs its length.
    """
    of_text = F.md5(whole_text(text).cast("binary"))
    hashed = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size_of(text).alias("size"), of_text.alias("m"))
    of_row = F.md5(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(":"), F.col("m")).cast("binary"))
    base = hashed.select("key", "source", "size", _number(of_row).alias("h1"), _number(F.col("m")).alias("h2"))
    sized = written(base.withColumn("slice", F.pmod("h1", F.lit(SLICES))), "mix-sizes")
    by_slice = sized.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    by_slice = written(by_slice, "mix-slices")
    totals = targets(by_slice.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    # A slice starts where those before it end; a source has at most SLICES of them.
    starts = by_slice.withColumn("before", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("words")
    known = starts.join(totals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    known = known.select(F.col("source").alias("_s"), F.col("slice").alias("_n"), "before", "source_size", "turn", "target")
    inside = W.partitionBy("source", "slice").orderBy("h1", "key", "h2", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_n")))
    start = F.col("before") + F.col("inside")
    copies = F.lit(0)
    for k in range(MOST_COPIES):
        copies = copies + F.when((F.col("size") > 0) & (start + k * F.col("source_size") + F.col("size") / 2 < F.col("target")), 1).otherwise(0)
    placed = placed.withColumn("copies", copies)
    at = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: position(start + k * F.col("source_size"), F.col("target"), F.col("turn")))
    positions = F.when(F.col("copies") > 0, at).otherwise(F.array().cast("array<double>"))
    return placed.select(F.col("key").alias(key), F.col("source").alias(source), F.col("h2").alias("text_hash"), "size", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), positions.alias("positions"))


def in_training_order(placed: DataFrame) -> DataFrame:
    """One row a copy that the mix takes, range-sorted by position."""
    copies = placed.select("*", F.posexplode("positions").alias("copy", "position")).drop("positions")
    return copies.repartitionByRange(F.col("position"), F.col("copy")).sortWithinPartitions("position", "copy")
