"""Sharding by longest processing time: groups stay together, the largest goes first, each to the
shard with the least load, through a heap.

Law `bytes`: the shards' sizes are near equal.  Groups are rows with equal texts.  The heap works on
items whose number is bounded by the number of shards alone, never on the rows: a group of at least
1/256 of a shard is an item of its own (there are at most 256 for each shard), and the smaller groups
are bundled by hash into 256 bundles for each shard.  A bundle is as inseparable as a group, so the
result is that of the heap over items, and the shards differ by about an item of the smallest kind.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

ITEMS_PER_SHARD = 256
ROWS_PER_RUN = 50_000


def longest_first(items: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Shard of each (item, load): the largest first, ties by name, to the least-loaded shard."""
    heap = [(0, s) for s in range(shards)]
    plan = {}
    for name, load in sorted(items, key=lambda x: (-x[1], x[0])):
        total, s = heapq.heappop(heap)
        plan[name] = s
        heapq.heappush(heap, (total + load, s))
    return plan


def shard(docs: DataFrame, shards: int = 40, overhead: int = 16, rows_per_run: int = ROWS_PER_RUN) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group.

    size is the UTF-8 bytes of the text plus `overhead`; a null text has no bytes, crc32 0, and the
    null texts are one group, apart from the empty ones.  Rows of equal text share a shard, also
    repeated rows and rows without doc_id; every row gets a slot of its own, gapless from 0 in its
    shard.  An empty table gives an empty result.  Other columns are ignored.
    """
    text = F.col("text")
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "utf-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(F.encode(text, "utf-8")), F.lit("-")).alias("group"),
    )
    rows = save(rows, "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    least = total / (shards * ITEMS_PER_SHARD)
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    # At most ITEMS_PER_SHARD * shards groups reach `least`, so this table may be broadcast.
    large = groups.where(F.col("bytes") >= F.lit(least)).select("group", F.lit(True).alias("large"))
    bundle = F.concat(F.lit("~"), F.pmod(F.xxhash64("group"), F.lit(shards * ITEMS_PER_SHARD)))
    rows = rows.join(F.broadcast(large), "group", "left").withColumn("item", F.when(F.col("large"), F.col("group")).otherwise(bundle))
    items = rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # 2 * ITEMS_PER_SHARD * shards at most
    plan = longest_first([(r["item"], r["bytes"]) for r in items], shards)
    placed = docs.sparkSession.createDataFrame(
        [(r["item"], plan[r["item"]], -(-r["n"] // rows_per_run)) for r in items], "item string, shard int, runs long"
    )
    # Slots: an item's rows are cut by hash into runs of about rows_per_run, so a group with a third
    # of all rows is no single task's work; a run starts where the shard's earlier runs end.
    rows = rows.join(F.broadcast(placed), "item").withColumn("run", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.col("runs")))
    rows_of_run = rows.groupBy("shard", "item", "run").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("item", "run").rowsBetween(Window.unboundedPreceding, -1)
    start = rows_of_run.select("item", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("item", "run").orderBy("doc_id", "group"))
    return (
        rows.withColumn("within", within).join(start, ["item", "run"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("start") + F.col("within") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "group",
        )
    )
