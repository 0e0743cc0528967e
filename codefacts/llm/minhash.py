"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of keys are made for each document, left and right, each key from `rows`
minhashes.  Table (i, j) is keyed by left key i together with right key j, so `halves` keys a side
give halves * halves tables from 2 * halves * rows minhashes, where plain banding would need
2 * rows minhashes for each table.  Two documents of similarity s share a table with probability
(1 - (1 - s**rows)**halves)**2: 0.9994 at s = 0.8 with the defaults.

Candidates are verified on the full shingle sets.  A shingle is known by a 64-bit hash of its words, and a
set by two 64-bit sums over its shingles' hashes and their number, all with fixed constants.  Documents
with equal sets are one class from the start.  No pairs are formed: documents that share a table, directly or by way of others, are a group,
and groups are compared whole, in tasks of bounded size, by counting common shingles from postings.
A task returns no pairs either, but for each document the smallest that it is linked with there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, save
from .words import Words, mix, slices

HALVES, ROWS = 8, 2
TASK_DOCS, TASK_SHINGLES = 2_000, 2_000_000
_SEED = np.random.default_rng(20240229)
_ODD = _SEED.integers(0, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 2**63, size=256, dtype=np.uint64)


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For row ranges of a text column: first row, the rows' sorted distinct shingle hashes one after
    the other, and where each row's begin (one more offset than rows)."""
    for a, b, data, offsets in slices(column):
        w = Words(data, offsets, fold=True)
        grams, at = w.grams(n)
        found, doc = [grams], [w.doc[at]]
        for k in range(1, n):  # with fewer words, the whole sequence is one shingle
            g, at = w.grams(k)
            own = w.count[w.doc[at]] == k
            found.append(mix(g[own] ^ np.uint64(k)))
            doc.append(w.doc[at][own])
        counts = np.bincount(np.concatenate(doc), minlength=b - a)
        short = np.flatnonzero((w.count > 0) & (w.count < n))
        of_short = dict(zip(np.concatenate(doc[1:]).tolist(), np.concatenate(found[1:]), strict=True)) if len(short) else {}
        ends = np.cumsum(np.bincount(doc[0], minlength=b - a))
        sets, lengths = [], np.zeros(b - a, dtype=np.int64)
        for r in np.flatnonzero(counts):
            if r in of_short:
                s = np.array([of_short[r]], dtype=np.uint64)
            else:
                s = np.sort(grams[(ends[r - 1] if r else 0) : ends[r]])
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            sets.append(s)
            lengths[r] = len(s)
        yield a, np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64), np.concatenate(([0], np.cumsum(lengths)))


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32)), pa.array(values.reshape(-1).view(np.int64)))


def sketch(docs: DataFrame, shingle: int = 4, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, digest_a, digest_b (equal for equal sets), left and right (keys)."""

    def of_sets(s: np.ndarray, offsets: np.ndarray):
        n = np.diff(offsets)
        full = np.flatnonzero(n)
        starts = offsets[:-1][full]
        digests = np.zeros((2, len(n)), dtype=np.uint64)
        keys = np.zeros((2, len(n), halves), dtype=np.uint64)
        if len(full):
            with np.errstate(over="ignore"):
                digests[0, full] = np.add.reduceat(s, starts)
                digests[1, full] = np.add.reduceat(mix(s ^ np.uint64(0x5BD1E995)), starts)
                k = 0
                for side in range(2):
                    for h in range(halves):
                        key = np.full(len(full), h + 1, dtype=np.uint64)
                        for _ in range(rows):
                            least = np.minimum.reduceat(s * _ODD[k] + _ADD[k], starts)
                            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
                            k += 1
                        keys[side, full, h] = key
        return n, digests, keys

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for a, s, offsets in shingle_sets(batch.column("text"), shingle):
                n, digests, keys = of_sets(s, offsets)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, len(n)), pa.array(n), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), _lists(keys[0]), _lists(keys[1])],
                    names=["doc_id", "n_shingles", "digest_a", "digest_b", "left", "right"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest_a long, digest_b long, left array<long>, right array<long>"
    )


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Documents with `set`, their shingles as sorted 64-bit integers, in place of `text`."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            for a, s, offsets in shingle_sets(batch.column("text"), shingle):
                n = len(offsets) - 1
                raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((offsets * 8).astype(np.int64)), pa.py_buffer(s)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, n) for c in rest), raw.cast(pa.binary())], names=[*rest, "set"])

    schema = ", ".join(f"{c} {kind}" for c, kind in docs.select(*rest).dtypes) + ", `set` binary"
    return docs.select(*rest, "text").mapInArrow(run, schema)


def _compared(percent: int):
    """Links within a task's block, or between its two blocks, as edges to the smallest linked id."""

    def run(key, table):
        first, second = key[1].as_py(), key[2].as_py()
        ids, block = table.column("rep").to_numpy(), table.column("block").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, block = ids[order], block[order]
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("set").combine_chunks().take(pa.array(order))]
        size = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        if not len(left) or not len(right):
            return pa.table({"a": ids[:0], "b": ids[:0]})
        # Postings of the right block: documents by shingle.
        shingles = np.concatenate([sets[j] for j in right])
        owner = np.repeat(np.arange(len(right)), size[right])
        by = np.argsort(shingles, kind="stable")
        shingles, owner = shingles[by], owner[by]
        root = np.arange(len(ids))

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i in left:
            lo = np.searchsorted(shingles, sets[i], side="left")
            count = np.searchsorted(shingles, sets[i], side="right") - lo
            some = np.flatnonzero(count)
            at = np.repeat(lo[some] - np.cumsum(count[some]) + count[some], count[some]) + np.arange(count[some].sum())
            both = np.bincount(owner[at], minlength=len(right))
            linked = right[100 * both >= percent * (size[i] + size[right] - both)]
            for j in linked[linked != i]:
                x, y = find(i), find(j)
                if x != y:
                    root[max(x, y)] = min(x, y)
        least = np.array([find(k) for k in range(len(ids))])
        out = np.flatnonzero(least != np.arange(len(ids)))
        return pa.table({"a": ids[out], "b": ids[least[out]]})

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = 5, halves: int = HALVES, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs.

    Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; a document's set
    are its distinct runs of `shingle` words, with fewer words its whole sequence.  Documents are
    linked when 100 * intersection >= percent * union; component_id is the smallest doc_id reachable
    by links, and kept marks the document that bears it.  A null or empty text has no shingles and
    is linked with nothing.  Repeated rows get the same component; rows without doc_id follow their
    text's class.  A doc_id should name one text.  Other columns are ignored.  An empty table gives
    an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = save(sketch(docs, shingle, halves, rows), "sketch")
    full = marks.where("n_shingles > 0")
    same = ["n_shingles", "digest_a", "digest_b"]
    classes = save(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("left").alias("left"), F.first("right").alias("right")), "classes")
    table_key = lambda x, i: F.transform("right", lambda y, j: F.xxhash64(i * halves + j, x, y))
    keys = classes.select("rep", F.explode(F.flatten(F.transform("left", table_key))).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("rep").alias("hub")).where("members > 1").select("key", "hub")
    # Who shares a table, directly or by way of others, is one group; groups are what is compared.
    groups = components(keys.join(shared, "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct())
    members = save(groups.withColumnRenamed("node", "rep").join(classes.select("rep", "n_shingles"), "rep"), "members")
    # Many small groups go to one task together; a large one is cut into blocks, a task for each two.
    volume = members.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    load = F.greatest(F.col("docs") / TASK_DOCS, F.col("shingles") / TASK_SHINGLES)
    volume = save(volume.withColumn("load", load), "volume")
    bundles = math.ceil(2 * (volume.where("load < 0.5").agg(F.sum("load")).first()[0] or 0)) + 1
    placed = members.join(volume.select("component", "load"), "component").select(
        "rep", F.when(F.col("load") < 0.5, F.pmod(F.xxhash64("component"), F.lit(bundles))).otherwise(-1 - F.col("component")).alias("task"),
        F.when(F.col("load") < 0.5, 1).otherwise(F.ceil(2 * F.col("load"))).cast("int").alias("blocks"),
    )
    sets = _sets(docs.join(placed, F.col("doc_id") == F.col("rep")).select("rep", "task", "blocks", "text"), shingle)
    sets = sets.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = sets.select("task", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "rep", "set")
    links = save(paired.groupBy("task", "b1", "b2").applyInArrow(_compared(percent), "a long, b long"), "links")
    parts = components(links)
    named = (
        classes.drop("left", "right").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*same, F.coalesce("component", "rep").alias("component_id"))
    )
    return (
        marks.drop("left", "right").join(named, same, "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
