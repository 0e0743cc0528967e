"""Exact duplicates by distributed radix partitioning, most significant bytes first.

Texts are split by their first bytes, what is left together by the next ones, and so on, until a group
has one text or its texts have ended.  Texts that went the same way to their end are equal byte by
byte; no digest decides.  A digit is a run of bytes: 64 at first, then sixteen times as many each
level, so that a text of n bytes takes about log16(n / 64) levels.

A level counts the groups of (group, digit, ended) and gives a number to those with two rows or more;
that is pre-aggregated before its shuffle, so a digit that a third of the rows share is a row from each
task.  Then rows find their group in a sort-merge join whose hot side Spark splits at run time.  Only
rows that still share all bytes so far with another row go on, without the bytes they were split by.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save

FIRST_DIGIT, GROWTH = 64, 16

_GROUP = ["level", "gid"]


def _groups(rows: DataFrame, level: int) -> DataFrame:
    """The groups of this level with two rows or more: from (gid, digit, ended) to next."""
    counted = rows.groupBy("gid", "digit", "ended").count().where("count > 1")
    return save(counted.select("gid", "digit", "ended", F.monotonically_increasing_id().alias("next")), f"radix-{level}")


def _digit(rows: DataFrame, width: int) -> DataFrame:
    """rows with the next `width` bytes of rest, and whether they are the last."""
    return rows.withColumns({"digit": F.expr(f"substring(rest, 1, {width})"), "ended": F.octet_length("rest") <= width})


def _split(rows: DataFrame, width: int, level: int, keep: list[str]) -> DataFrame:
    """One level.  A row that is alone gets no gid; where the text has ended or the row is alone, rest is null."""
    cut = _digit(rows, width)
    groups = _groups(_digit(rows.select("gid", "rest"), width).drop("rest"), level)
    found = cut.join(groups.hint("merge"), ["gid", "digit", "ended"], "left")
    rest = F.when(F.col("next").isNotNull() & ~F.col("ended"), F.expr(f"substring(rest, {width + 1})"))
    return found.select(*keep, F.lit(level).alias("level"), F.col("next").alias("gid"), rest.alias("rest"))


def deduplicate(docs: DataFrame, keep: tuple[str, ...] = (), first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (and `keep` columns): a row for each row of docs.

    Texts are equal when their bytes are; a null text counts as empty.  Of equal texts the row with
    the largest doc_id stays, and keep_id names it.  Rows without doc_id rank below all others (keep_id
    is null if a group has no others); of rows that share the largest doc_id one stays, so each group
    keeps exactly one row.  text_sha256 describes the text and decides nothing.  Other columns are
    ignored unless named in `keep`, which must not name a column of the result.  An empty table gives
    an empty result.
    """
    own = {c: f"keep_{k}" for k, c in enumerate(keep)}  # whatever they are called
    carried = ["doc_id", "text_sha256", *own.values()]
    raw = F.coalesce(F.col("text").cast("binary"), F.unhex(F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(x) for c, x in own.items()], raw.alias("rest"), F.lit(0).cast("long").alias("gid"))
    # Whole texts are shuffled once, at the first level; numbers of rows are given to what it leaves.
    first = _split(rows.withColumn("text_sha256", F.sha2("rest", 256)), first_digit, 0, carried)
    level, done = 0, []
    left = save(first.withColumn("row", F.monotonically_increasing_id()), "level-0")
    carried.append("row")
    while True:
        done.append(left.where("rest is null").select(*carried, *_GROUP))
        active = left.where("rest is not null")
        if active.isEmpty():
            break
        level += 1
        left = save(_split(active, first_digit * growth**level, level, carried), f"level-{level}")
    every = reduce(DataFrame.unionByName, done)
    together = every.where("gid is not null")
    stays = save(
        together.groupBy(*_GROUP).agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top")), "stays"
    )
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", *[F.col(x).alias(c) for c, x in own.items()]]
    alone = every.where("gid is null").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    judged = together.join(stays.hint("merge"), _GROUP).withColumns({"keep_id": F.col("top.doc_id"), "kept": F.col("row") == F.col("top.row")})
    return alone.select(*names).unionByName(judged.select(*names))
