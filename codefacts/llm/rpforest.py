"""Near-duplicate embeddings by a forest of random-projection trees with spill overlap.

Each tree splits its nodes again and again: the vectors of a node are projected on a random direction
drawn for that node and cut at the quartiles, and a vector within `margin` of a cut goes to both
sides.  Vectors are compared within leaves only; with the margin set from the distance that linked
vectors may have, a pair above the threshold is parted by one tree with a chance of a few hundredths,
and by all of them practically never.  Cuts come from all rows (approximate quantiles, aggregated
before the shuffle), level by level, for all trees at once.

Equal vectors are one row with a count; equality goes by two 64-bit hashes with fixed constants.  A node of vectors so alike that a cut would send most of
them both ways isn't split further; such a leaf is compared in blocks, a task for each pair of blocks.
A pair that meets in several leaves counts in the first of them, so no list of pairs is formed: a
leaf gives each vector its number of links and the root of its component within the leaf.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard
from .common import components, save
from .vectors import classes, keyed, matrix, usable

TREES, LEAF, BLOCK = 6, 512, 1024
#: Components of nodes' directions that a task remembers.
DIRECTIONS = 2_000_000


def _project(batches):
    known, held = {}, 0
    for batch in batches:
        node, rows = batch.column("node").to_numpy(), batch.column("vector")
        out, widths = np.zeros(len(node)), rows.value_lengths().to_numpy()
        for width in np.unique(widths).tolist():
            at = np.flatnonzero(widths == width)
            x = matrix(rows.take(pa.array(at)))
            each, which = np.unique(node[at], return_inverse=True)
            if held > DIRECTIONS:
                known, held = {}, 0
            for v in each.tolist():
                if v not in known:
                    known[v] = np.random.default_rng(v & (2**63 - 1)).standard_normal(width)
                    known[v] /= np.linalg.norm(known[v])
                    held += width
            # Row by row, so that a vector's projection doesn't depend on its batch.
            out[at] = np.einsum("ij,ij->i", x, np.stack([known[v] for v in each.tolist()])[which]) / np.linalg.norm(x, axis=1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "p"])


def _leaves(vectors: DataFrame, trees: int, leaf: int, threshold: float) -> list[DataFrame]:
    """(node, n, rep, copies, vector): every class in the leaves that it reaches, a table for each level.

    Nodes with their sizes and cuts are few and broadcast, so vectors aren't shuffled here; they are
    projected twice, for the cuts and for the children, and a level's table goes when the next is written.
    """
    kind = dict(vectors.dtypes)["vector"]
    active = vectors.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).select(
        F.xxhash64("tree", "label", F.size("vector")).alias("node"), "rep", "copies", "vector"
    )
    active = save(active, "roots")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    margin = 0.8 * F.lit(reach) / F.sqrt(F.size("vector"))
    done = []
    while True:
        counts = save(active.groupBy("node").agg(F.count("*").alias("n")), "nodes")
        big = active.join(F.broadcast(counts.where(F.col("n") > leaf)), "node")
        flat = big.mapInArrow(_project, f"node long, rep long, copies long, vector {kind}, n long, p double")
        # The vectors of a node have one length, so one margin.
        cuts = flat.groupBy("node").agg(F.percentile_approx("p", [0.25, 0.5, 0.75], 1000).alias("q"), F.max(margin).alias("margin"))
        cuts = save(cuts.withColumn("dense", F.col("q")[2] - F.col("q")[0] < 3 * F.col("margin")), "cuts")
        whole = counts.join(cuts.where("not dense").select("node"), "node", "left_anti")
        done.append(save(active.join(F.broadcast(whole), "node").select("node", "rep", "copies", "vector", "n"), "leaves"))
        if cuts.where("not dense").isEmpty():
            break
        split = flat.join(F.broadcast(cuts.where("not dense")), "node")
        side = F.array(
            *[
                F.when((F.lit(True) if k == 0 else F.col("p") >= F.col("q")[k - 1] - F.col("margin")) & (F.lit(True) if k == 3 else F.col("p") <= F.col("q")[k] + F.col("margin")), F.lit(k))
                for k in range(4)
            ]
        )
        children = split.withColumn("side", F.explode(F.array_compact(side)))
        level = save(children.select(F.xxhash64("node", "side").alias("node"), "rep", "copies", "vector"), "level")
        discard(active, counts, cuts)
        active = level
    discard(active, counts, cuts)
    return done


def _compare(threshold: float, block: int):
    """Links and local roots within one leaf, or between two blocks of one."""

    def run(key, table):
        first, second = key[1].as_py(), key[2].as_py()
        rep = table.column("rep").to_numpy()
        copies = table.column("copies").to_numpy()
        own = table.column("block").to_numpy()
        x = matrix(table.column("vector").combine_chunks())
        norm = np.linalg.norm(x, axis=1)
        lists = table.column("nodes").combine_chunks()
        many = lists.value_lengths().to_numpy()
        nodes = np.full((len(rep), many.max()), np.iinfo(np.int64).max)
        nodes[np.arange(many.max()) < many[:, None]] = lists.flatten().to_numpy()
        a = np.flatnonzero(own == first)
        b = np.flatnonzero(own == second)
        links = np.zeros(len(rep), dtype=np.int64)
        root = np.arange(len(rep))
        left, right = [], []
        here = key[0].as_py()
        for s in range(0, len(a), block):
            rows = a[s : s + block]
            near = (x[rows] @ x[b].T) / (norm[rows][:, None] * norm[b][None, :]) >= threshold
            i, j = np.nonzero(near)
            i, j = rows[i], b[j]
            once = rep[i] < rep[j] if first == second else rep[i] != rep[j]
            i, j = i[once], j[once]
            left.append(i)
            right.append(j)
            for t in range(0, len(i), 65536):
                p, q = i[t : t + 65536], j[t : t + 65536]
                # A pair counts where its smallest common leaf is this one.
                same = (nodes[p][:, :, None] == nodes[q][:, None, :]).any(axis=2)
                least = np.where(same, nodes[p], np.iinfo(np.int64).max).min(axis=1)
                p, q = p[least == here], q[least == here]
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
        i, j = np.concatenate(left or [a[:0]]), np.concatenate(right or [a[:0]])
        order = np.argsort(np.argsort(rep, kind="stable"))
        back = np.argsort(rep, kind="stable")
        root = order.copy()  # by rank of rep, so that the least is the smallest id
        while len(i):
            least = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, least)
            np.minimum.at(new, j, least)
            new = np.minimum(new, new[back[new]])
            if (new == root).all():
                break
            root = new
        return pa.table({"rep": rep, "links": links, "root": rep[back[root]]})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of vectors.

    Two vectors link when their labels are equal and not null, their lengths are equal, and their
    cosine in double precision is at least `threshold`.  Vectors that are null, empty, zero or hold
    null or non-finite components, and those without label, link with nothing: n_links 0, and a
    component of their own.  A repeated row counts as another vector.  component_id is the smallest
    vec_id reachable by links.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = keyed(vectors, "label")
    fit = rows.where(F.col("label").isNotNull() & usable(F.col("vector")))
    same = save(classes(fit, "label"), "classes")
    levels = _leaves(same, trees, leaf, threshold)
    leaves = reduce(DataFrame.unionByName, levels)
    lists = leaves.groupBy("rep").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    placed = leaves.join(lists, "rep")
    # Blocks only where a leaf is large; a row meets every block of its leaf once.
    blocks = F.ceil(F.col("n") / F.lit(2 * leaf)).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "node", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "rep", "copies", "vector", "nodes"
    )
    found = save(placed.groupBy("node", "b1", "b2").applyInArrow(_compare(threshold, block), "rep long, links long, root long"), "links")
    discard(*levels)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (
        same.select("k1", "k2", "rep", "copies").join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    ok = F.col("label").isNotNull() & usable(F.col("vector"))
    out = rows.select("vec_id", F.when(ok, F.col("k1")).alias("k1"), "k2").join(named, ["k1", "k2"], "left")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
