"""Spans of bytes in files: containment, nesting, attribution and ordered patching.

Interval joins are written as sweeps (a window in order of offsets) or as joins on equal keys with
running maxima, never as bare range predicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FILE = ["project_id", "file"]


def check_spans(entities: DataFrame) -> DataFrame:
    """Per project: every start <= end, and in order of file, start and end no span begins before the
    one before it in the file ends (touching is fine)."""
    order = Window.partitionBy(*FILE).orderBy("start_off", "end_off")
    good = (F.col("start_off") <= F.col("end_off")) & F.coalesce(F.lag("end_off").over(order) <= F.col("start_off"), F.lit(True))
    return entities.withColumn("good", good).groupBy("project_id").agg(F.bool_and("good").alias("ok"))


def _overlapping(items: DataFrame) -> DataFrame:
    """Files in which an item begins before one before it has ended."""
    before = Window.partitionBy(*FILE).orderBy("start_off", "end_off").rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("_reach", F.max("end_off").over(before)).where("start_off < _reach").select(*FILE).distinct()


def _swept(asked: DataFrame, items: DataFrame) -> DataFrame:
    """asked with the item that holds both ends, where a file's items don't overlap: the last one begun."""
    starts = items.select(*FILE, F.col("start_off").alias("low"), F.lit(0).alias("kind"), "start_off", "end_off", *[F.lit(None).cast("long").alias(c) for c in ("byte_start", "byte_end", "high", "seq")])
    asks = asked.select(*FILE, "low", F.lit(1).alias("kind"), *[F.lit(None).cast("long").alias(c) for c in ("start_off", "end_off")], "byte_start", "byte_end", "high", "seq")
    sweep = Window.partitionBy(*FILE).orderBy("low", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(sweep)
    rows = starts.unionByName(asks).withColumns({"s": last("start_off"), "e": last("end_off")}).where("kind = 1")
    inside = (F.col("s") <= F.col("low")) & (F.col("high") < F.col("e"))
    return rows.select(*FILE, "seq", "byte_start", "byte_end", F.when(inside, F.struct(F.col("s").alias("start_off"), F.col("e").alias("end_off"))).alias("item"))


def _first_holding(asked: DataFrame, items: DataFrame) -> DataFrame:
    """asked with the first item, in order of item_seq, that holds both ends; items may nest and cross.

    An item is cut into the dyadic intervals that make it up, two a level at most, and a place lies in
    one interval of each level; so an item holds the lower end if they meet in one interval.  There
    the items that reach beyond the upper end come first in an order of falling ends, and the running
    minimum of item_seq is the first of them.  That takes rows in proportion to items and diagnostics, times the logarithm
    of the file's size, however the items lie.
    """
    levels = F.sequence(F.lit(0), F.length(F.bin(F.col("size"))))
    shift = lambda x, k: F.call_function("shiftright", x, k)
    sizes = items.groupBy(*FILE).agg(F.max("end_off").cast("long").alias("size"))
    low = lambda k: shift(F.col("start_off") + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
    high = lambda k: shift(F.col("end_off"), k)
    place = lambda k, x: F.struct(k.alias("level"), x.alias("at"))
    own = F.flatten(F.transform(levels, lambda k: F.when(
        low(k) < high(k), F.filter(F.array(F.when(low(k) % 2 == 1, place(k, low(k))), F.when(high(k) % 2 == 1, place(k, high(k) - 1))), lambda x: x.isNotNull())
    ).otherwise(F.array().cast("array<struct<level:int,at:bigint>>"))))
    of_items = items.join(sizes, FILE).select(*FILE, F.explode(own).alias("node"), F.col("end_off").alias("reach"), F.struct("item_seq", "start_off", "end_off").alias("item"), F.lit(None).cast("long").alias("low"))
    asks = asked.select(*FILE, "low", "high").distinct().join(sizes, FILE)
    of_asks = asks.where("low < size and low >= 0").select(*FILE, F.explode(F.transform(levels, lambda k: place(k, shift(F.col("low"), k)))).alias("node"), F.col("high").alias("reach"), F.lit(None).cast(of_items.schema["item"].dataType).alias("item"), "low")
    # An item that ends at the upper end doesn't hold it, so there the question comes first.
    order = Window.partitionBy(*FILE, "node").orderBy(F.desc("reach"), F.col("item").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = of_items.unionByName(of_asks).withColumn("item", F.min("item").over(order)).where("low is not null and item is not null")
    first = met.groupBy(*FILE, "low", F.col("reach").alias("high")).agg(F.min("item").alias("item"))
    found = asked.join(first, [*FILE, "low", "high"], "left")
    return found.select(*FILE, "seq", "byte_start", "byte_end", F.when(F.col("item").isNotNull(), F.struct("item.start_off", "item.end_off")).alias("item"))


def attribute_spans(diagnostics: DataFrame, items: DataFrame) -> DataFrame:
    """Each diagnostic (seq, byte_start, byte_end) with the first item, in order of item_seq (of start and
    end where items have none), that holds both of its ends, or the whole file (null, null).

    Items are half-open and the end itself must lie inside; a file without items gives status
    missing_file.  Where a file's items don't overlap one sweep by offset finds the item; nesting
    and crossing items are looked up by dyadic intervals.
    """
    asked = diagnostics.select(*FILE, "seq", *[F.col(c).cast("long").alias(c) for c in ("byte_start", "byte_end")], F.least("byte_start", "byte_end").cast("long").alias("low"), F.greatest("byte_start", "byte_end").cast("long").alias("high"))
    seq = F.col("item_seq") if "item_seq" in items.columns else F.struct("start_off", "end_off")
    items = items.select(*FILE, seq.alias("item_seq"), *[F.col(c).cast("long").alias(c) for c in ("start_off", "end_off")])
    known = items.select(*FILE).distinct().withColumn("known", F.lit(True))
    items = items.where("start_off < end_off")  # others hold nothing
    crowded = _overlapping(items)
    apart = lambda rows, how: rows.join(crowded, FILE, how)
    found = _swept(apart(asked, "left_anti"), apart(items, "left_anti")).unionByName(_first_holding(apart(asked, "left_semi"), apart(items, "left_semi")))
    return found.join(known, FILE, "left").select(
        *FILE, "seq", "byte_start", "byte_end", F.col("item.start_off").alias("item_start"), F.col("item.end_off").alias("item_end"),
        F.when(F.col("known").isNull(), "missing_file").when(F.col("item").isNotNull(), "item").otherwise("whole_file").alias("status"),
    )


def nest_entities(entities: DataFrame) -> DataFrame:
    """entities (project_id, file, pool, entity_seq, start_off, end_off) with parent_seq: spans inside
    another of their pool point at the maximal span that holds them; maximal ones are roots.

    In order of start (and falling end, then arrival) a span is a root when its end lies beyond all
    ends before it; others belong to the last root, which by then holds them.
    """
    order = Window.partitionBy(*FILE, "pool").orderBy("start_off", F.desc("end_off"), "entity_seq")
    reach = F.max("end_off").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = entities.withColumn("root", F.coalesce(F.col("end_off") > reach, F.lit(True)))
    holder = F.last(F.when(F.col("root"), F.col("entity_seq")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("parent_seq", F.when(~F.col("root"), holder)).drop("root")


def group_errors(attributed: DataFrame) -> DataFrame:
    """Diagnostics by (file, item); where a file has any for the whole file, all of its go there."""
    whole = F.bool_or(F.col("item_start").isNull()).over(Window.partitionBy(*FILE))
    merged = attributed.withColumn("whole", whole).withColumns({c: F.when(~F.col("whole"), F.col(c)) for c in ("item_start", "item_end")})
    return merged.groupBy(*FILE, "item_start", "item_end").agg(F.count("*").alias("errors"), F.min("seq").alias("first_seq"))


def error_text(messages: DataFrame) -> DataFrame:
    """Messages (project_id, file, seq, text) of each file joined by a blank line, in order of arrival."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return messages.groupBy(*FILE).agg(F.array_join(parts, "\n\n").alias("error_text"))


def last_patches(patches: DataFrame) -> DataFrame:
    """One patch for each range: the last to arrive; an empty replacement means no patch."""
    last = Window.partitionBy(*FILE, "start_off", "end_off").orderBy(F.desc("seq"))
    return patches.where("replacement <> ''").withColumn("r", F.row_number().over(last)).where("r = 1").drop("r")


def apply_patches(files: DataFrame, patches: DataFrame) -> DataFrame:
    """files (project_id, file, content, refused) with byte ranges replaced; null bounds mean the whole
    file.  Offsets are bytes of the original; files without patches stay as they are, and so do those whose
    patches overlap or lie outside the file: they are refused.

    The kept gaps and the replacements are pieces of one array, joined once, so a file's cost is its
    length and not its length times its patches.
    """
    named = last_patches(patches).join(files.select(*FILE, F.octet_length("content").cast("long").alias("size")), FILE)
    named = named.select(*FILE, F.coalesce("start_off", F.lit(0)).alias("s"), F.coalesce("end_off", "size").alias("e"), "replacement")
    lists = named.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("s", "e", "replacement"))).alias("edits"))
    joined = files.join(lists, FILE, "left")
    # Piece i: what lies between edit i - 1 and edit i, then the replacement.
    cut = lambda a, b: F.hex(F.substring("content", (a + 1).cast("int"), (b - a).cast("int")))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at("edits", i.cast("int"))["e"])
    pieces = F.transform("edits", lambda x, i: F.concat(cut(before(i), x["s"]), F.hex(F.encode(x["replacement"], "utf-8"))))
    tail = cut(F.element_at("edits", -1)["e"], F.octet_length("content").cast("long"))
    patched = F.unhex(F.concat(F.array_join(pieces, ""), tail))
    wrong = F.transform("edits", lambda x, i: (x["s"] < before(i)) | (x["e"] < x["s"]) | (x["s"] < 0) | (x["e"] > F.octet_length("content")))
    joined = joined.withColumn("refused", F.coalesce(F.exists(wrong, lambda w: w), F.lit(False)))
    return joined.select(*FILE, F.when(F.col("edits").isNull() | F.col("refused"), F.col("content")).otherwise(patched).alias("content"), "refused")


def interface_digest(files: DataFrame, items: DataFrame, bodies: DataFrame, stub: str = "{ ... }") -> DataFrame:
    """Item texts with their bodies (spans inside items) replaced by a stub each, joined by blank lines.

    An item may hold any number of bodies; one that begins inside another goes with it.
    """
    # Bodies to items by the sweep: a body belongs to the item whose range holds it.
    held = attribute_spans(bodies.select(*FILE, F.col("start_off").alias("byte_start"), (F.col("end_off") - 1).alias("byte_end"), F.monotonically_increasing_id().alias("seq")), items)
    held = held.where("item_start is not null").select(*FILE, F.col("item_start").alias("start_off"), F.col("byte_start").alias("b"), (F.col("byte_end") + 1).alias("e"))
    before = Window.partitionBy(*FILE, "start_off").orderBy("b", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    outer = held.withColumn("reach", F.max("e").over(before)).where(F.col("reach").isNull() | (F.col("b") >= F.col("reach")))
    lists = outer.groupBy(*FILE, "start_off").agg(F.array_sort(F.collect_list(F.struct("b", "e"))).alias("cuts"))
    cut = lambda a, b: F.hex(F.substring("content", (a + 1).cast("int"), (b - a).cast("int")))
    after = lambda i: F.when(i == 0, F.col("start_off")).otherwise(F.try_element_at("cuts", i.cast("int"))["e"])
    pieces = F.transform("cuts", lambda x, i: F.concat(cut(after(i), x["b"]), F.hex(F.encode(F.lit(stub), "utf-8"))))
    stubbed = F.unhex(F.concat(F.array_join(pieces, ""), cut(F.element_at("cuts", -1)["e"], F.col("end_off"))))
    whole = F.substring("content", (F.col("start_off") + 1).cast("int"), (F.col("end_off") - F.col("start_off")).cast("int"))
    text = F.when(F.col("cuts").isNull(), whole).otherwise(stubbed)
    parts = items.join(lists, [*FILE, "start_off"], "left").join(files, FILE).select(*FILE, "start_off", text.cast("string").alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start_off", "text"))), lambda x: x["text"])
    return parts.groupBy(*FILE).agg(F.array_join(ordered, "\n\n").alias("digest"))
