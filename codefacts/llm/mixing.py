"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key; within its source the documents are laid out in key order
and the mix takes a prefix of that order whose size is the source's budget to the word, after as
many whole passes (epochs) as the budget needs.

Keys are uniform, so cutting their range into equal buckets is a range partitioning without
sampling: a source's prefix sums are the sums of the earlier buckets (one small row for each bucket
and source, aggregated before the shuffle) plus a running sum inside the bucket.  A source with a
third of all rows is spread over as many buckets as its rows need, and no task sorts more than about
`rows_per_bucket` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, save

WEIGHTS = (5, 2, 1)
EPOCHS = 3
ROWS_PER_BUCKET = 50_000


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Words to take from each source.

    sources: (source, size), a row for each source.  Sources in order of code points, null last,
    weigh `weights`, repeating, and share the size of all.  A source stops at `epochs` times its
    size, and what it leaves is shared by weight among the rest: with level x the source gets
    min(epochs * size, weight * x), and x is the level at which these add up to the total.  Sorted by
    epochs * size / weight, the sources below the level are a prefix, so running sums find it.  A
    source without words gets 0.  The sources are few against the documents; one task orders them.
    """
    ordinal = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (ordinal % len(weights) + 1).cast("int"))
    cap = F.col("size") * float(epochs)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("ratio", "ordinal")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    leveled = (
        sources.withColumns({"ordinal": ordinal, "weight": weight, "cap": cap})
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("size").over(every).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_weight", F.sum("weight").over(after))
        # The level, if just the sources before this one are capped.
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
        # The first source whose own ratio isn't below that level sets the level for all from it on.
        .withColumn("x", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "ordinal", "level"))).over(every)["level"])
    )
    return leveled.select(
        "source", F.col("size").alias("source_size"), "weight",
        F.when(F.col("x").isNull() | (F.col("ratio") <= F.col("x")), F.col("cap")).otherwise(F.col("weight") * F.col("x")).alias("target"),
    )


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: int = 7, rows_per_bucket: int = ROWS_PER_BUCKET, keep: tuple[str, ...] = ()) -> DataFrame:
    """Plan of the mix: doc_id, source, size, source_size, target, taken, epochs_full, and `keep` columns.

    taken counts the words that the mix holds of a document: size for each whole pass, and in the
    last pass all, a leading part (one document of a source at most) or nothing; a source's taken
    add up to its target, rounded down, exactly.  Null texts and texts without words have size 0 and
    take 0; a null source is a source of its own.  The order is by hash of doc_id and seed, then
    doc_id and size, so reruns agree; repeated rows each count.  An empty table gives an empty plan.
    Columns of docs other than doc_id, source, text and `keep` are ignored.
    """
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.lit(seed)).alias("key"), *keep,
    )
    sized = save(sized, "sizes")
    rows = sized.count()
    buckets = 1
    while buckets * rows_per_bucket < rows:
        buckets *= 2
    buckets *= 16  # so that small tables too are spread
    # Signed keys: shifting to the top bits keeps their order.
    bits = 64 - (buckets.bit_length() - 1)
    sized = sized.withColumn("bucket", F.shiftright("key", bits))
    part = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    budget = targets(part.groupBy("source").agg(F.sum("in_bucket").alias("size")), weights, epochs)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = part.withColumn("base", F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)))
    base = (
        base.join(budget.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "base", "source_size", "target")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    )
    words = F.floor("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = words - full * F.col("source_size")
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("base") - F.col("within")))
    return laid.select(
        "doc_id", "source", "size", "source_size", "target", (full * F.col("size") + last).cast("long").alias("taken"),
        full.alias("epochs_full"), *keep,
    )
