"""The prefix trie of conversations, from ternary search trees over range shards.

Turns get numbers from a sorted dictionary of their (role, text); a conversation is the list of its
turns' numbers.  Equal lists are one row with a count, so copies cost nothing more.  The distinct lists
are range-partitioned and sorted.  A task puts its shard into a ternary search tree, medians first, which
keeps it balanced, and walks its nodes from the last made to the first (a parent is always older than
its children) to add up members, leaves and savings.  Only nodes on the paths of a shard's first and
last list can lie in other shards too.  How far neighbouring shards agree (two numbers a shard)
tells which of them are one node; their parts are summed, and their totals are handed to their
ancestors by a join on node keys.

Lists are cut into blocks of growing length: 64 turns, then four times as many.  What goes on below a
block by itself, a conversation that nobody shares any more, is a chain whose nodes need no tree; so a
very long conversation is never one row.  Where several go on together, their end in one block is the
root of a tree in the next; blocks are summed from the deepest up.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

FIRST_BLOCK, GROWTH = 64, 4
TURNS_PER_SHARD = 100_000
#: Members whose ids differ in the lowest bits only are one piece of text when their ids are hashed.
PIECE_BITS = 12
NOTHING = hashlib.sha256(b"").hexdigest()


# --- Turns, and the conversations to be put into the trie ----------------------------------------


def _shards(turns: DataFrame, per_shard: int) -> int:
    return max(1, -(-turns.count() // per_shard))


def number_turns(conversations: DataFrame, per_shard: int = TURNS_PER_SHARD) -> DataFrame:
    """(conv_id, pos, tid, cp): turns in order from 0, their dictionary number and text length.

    Turns are ordered by (turn, role, text), null turns first.  Null roles and texts are empty; rows
    without conv_id go.  The order is that of one sort of all turns; a conversation may span its
    partitions, which then count on where the one before ended.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    words = rows.select("role", "text").distinct()
    n = _shards(rows, per_shard)
    # Sorted, so that the numbers order turns as (role, text) does and runs agree.
    numbered = words.repartitionByRange(n, "role", "text").sortWithinPartitions("role", "text").withColumn("tid", F.monotonically_increasing_id())
    dictionary = save(numbered.withColumn("cp", F.char_length("text")), "turns")
    coded = save(rows.join(dictionary, ["role", "text"]).select("conv_id", "turn", "tid", "cp"), "coded")
    order = ["conv_id", F.asc_nulls_first("turn"), "tid", "tie"]  # the tie only lets equal rows part

    def count_on(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            new = np.concatenate(([True], ids[1:] != ids[:-1]))
            starts = np.flatnonzero(new)
            pos = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            if len(ids):
                if ids[0] == last:
                    pos[: starts[1] if len(starts) > 1 else len(ids)] += seen
                last, seen = ids[-1], int(pos[-1]) + 1
            columns = [pa.array(np.full(len(ids), part, dtype=np.int32)), batch.column("conv_id"), pa.array(pos.astype(np.int64)), batch.column("tid"), batch.column("cp")]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "conv_id", "pos", "tid", "cp"])

    sorted_ = coded.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("tie", "turn")
    laid = save(sorted_.mapInArrow(count_on, "part int, conv_id long, pos long, tid long, cp int"), "laid")
    spans = laid.groupBy("conv_id", "part").agg((F.max("pos") + 1).alias("rows"))
    several = spans.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("conv_id")
    before = F.sum("rows").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.join(several, "conv_id").select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    # A partition has a part of two such conversations at most.
    return save(laid.join(F.broadcast(spans), ["conv_id", "part"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "tid", "cp"), "numbered")


def graft(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of conversation c - c % every, then c's own after its
    first h, with h = crc32(decimal c) % most.  Returns (conv_id, n_turns), also of those without turns,
    and (conv_id, depth, tid, cp) with depths from 1."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    own = own.withColumns({"h": (F.crc32(F.col("conv_id").cast("string")) % most).cast("int"), "base": F.col("conv_id") - F.col("conv_id") % every})
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("base"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("pos", "tid", "cp"))).alias("head"))
    taken = F.coalesce(F.filter("head", lambda x: x["pos"] < F.col("h")), F.array().cast("array<struct<pos:bigint,tid:bigint,cp:int>>"))
    convs = own.join(heads, "base", "left").withColumn("head", taken).withColumn("taken", F.size("head"))
    convs = save(convs.withColumn("n_turns", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long")), "rebuilt")
    front = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", (F.col("x.pos") + 1).alias("depth"), "x.tid", "x.cp")
    back = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "tid", "cp")
    return convs.select("conv_id", "n_turns"), save(front.unionByName(back), "paths")


# --- One block: shards, their trees, and the nodes that shards share -------------------------------

_NODES = (
    "kind int, shard int, last boolean, size int, gid long, conv_id long, parent_conv_id long, above boolean, n long, cp long, kids long, leaves long, saved long, sid long, "
    "first_list array<long>, last_list array<long>"
)
WHOLE, EDGE, ENDS = 0, 1, 2


class TernaryTree:
    """A ternary search tree over lists of numbers; each node stands for one prefix."""

    def __init__(self):
        self.symbol, self.less, self.equal, self.more, self.parent, self.size = [], [], [], [], [], []

    def _new(self, symbol: int, parent: int, size: int) -> int:
        for values, x in ((self.symbol, symbol), (self.less, -1), (self.equal, -1), (self.more, -1), (self.parent, parent), (self.size, size)):
            values.append(x)
        return len(self.symbol) - 1

    def insert(self, path: list[int]) -> list[int]:
        """The nodes of the path's prefixes, made where they are missing."""
        nodes, parent = [], -1
        for symbol in path:
            at = (self.equal[parent] if parent >= 0 else 0 if self.symbol else -1)
            link, of = self.equal, parent
            while at >= 0 and self.symbol[at] != symbol:
                link, of = (self.less, at) if symbol < self.symbol[at] else (self.more, at)
                at = link[at]
            if at < 0:
                at = self._new(symbol, parent, len(nodes) + 1)
                if of >= 0:
                    link[of] = at
            nodes.append(at)
            parent = at
        return nodes


def medians(n: int):
    """0..n-1, each range's middle before its halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            stack += [(mid + 1, b), (a, mid)]


def _grow(batches):
    """A shard's sorted lists -> its nodes: whole ones, those on its edges in part, and its edges."""
    columns: dict[str, list] = {}
    for batch in batches:
        for name in batch.schema.names:
            columns.setdefault(name, []).extend(batch.column(name).to_pylist())
    if not columns or not columns["gid"]:
        return
    shard, rows = TaskContext.get().partitionId(), len(columns["gid"])
    paths = [[g, *tids] for g, tids in zip(columns["gid"], columns["tids"], strict=True)]
    tree, n, least, cp, kids, leaves, saved, sid, above = TernaryTree(), [], [], [], [], [], [], [], []
    edges: dict[int, bool] = {}
    for k in medians(rows):
        nodes = tree.insert(paths[k])
        for _ in range(len(tree.symbol) - len(n)):
            for values, x in ((n, 0), (least, None), (cp, 0), (kids, 0), (leaves, 0), (saved, 0), (sid, None), (above, None)):
                values.append(x)
        for i, length in zip(nodes, [0, *columns["cps"][k]], strict=True):
            n[i] += columns["n"][k]
            least[i] = columns["lo"][k] if least[i] is None else min(least[i], columns["lo"][k])
            cp[i] = length
        end = nodes[-1]
        sid[end] = columns["sid"][k]
        above[nodes[0]] = columns["above"][k]
        for values, name in ((kids, "kids_below"), (leaves, "leaves_below"), (saved, "saved_below")):
            values[end] += columns[name][k]
        if k in (0, rows - 1):
            edges |= {i: k == rows - 1 or edges.get(i, False) for i in nodes}
    out = []
    for i in range(len(n) - 1, -1, -1):
        p, edge = tree.parent[i], i in edges
        if not edge:
            leaves[i] += kids[i] == 0
            saved[i] += (n[i] - 1) * cp[i]
            kids[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
        # What a parent on the edge is called is known when the shards have been put together.
        named = above[p] if p >= 0 and above[p] is not None else least[p] if p >= 0 and p not in edges else None
        side = edges[i] if edge else edges.get(p, False)
        out.append((EDGE if edge else WHOLE, shard, side, tree.size[i], paths[0][0] if edge and not side else tree.symbol[i] if p < 0 else None, least[i], named, p in edges and above[p] is None, n[i], cp[i], kids[i], leaves[i], saved[i], sid[i], None, None))
    out.append((ENDS, shard, False, 0, None, None, None, False, 0, 0, 0, 0, 0, None, paths[0], paths[-1]))
    schema = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("last", pa.bool_()), ("size", pa.int32()), *((c, pa.int64()) for c in ("gid", "conv_id", "parent_conv_id")), ("above", pa.bool_()), *((c, pa.int64()) for c in ("n", "cp", "kids", "leaves", "saved", "sid")), ("first_list", pa.list_(pa.int64())), ("last_list", pa.list_(pa.int64()))])
    for a in range(0, len(out), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out[a : a + 10_000], strict=True), schema, strict=True)], schema=schema)


class Owners:
    """Which shard a node on a shard's edge begins in.

    inner[j]: how many symbols the first and last list of shard j have in common; outer[j]: how many
    the last of shard j - 1 and the first of j.  A node of `size` symbols on j's first list lies in
    shard j - 1 too if size <= outer[j], and goes on to the left while size <= min(inner, outer) there.
    """

    def __init__(self, inner: list[int], outer: list[int]):
        self.inner, self.outer = inner, outer
        self.through = [min(a, b) for a, b in zip(inner, outer, strict=True)]
        self.lower = []  # the nearest shard to the left with a smaller `through`
        for i, x in enumerate(self.through):
            at = i - 1
            while at >= 0 and self.through[at] >= x:
                at = self.lower[at]
            self.lower.append(at)

    def keys(self, j: int, last: bool, size: int) -> list[int]:
        """Keys of the node and of its ancestors, longest first: a number for each distinct node."""
        found, at = [], j - 1
        for s in range(size, 0, -1):
            on_both = s <= self.inner[j]
            if s <= self.outer[j] and (on_both or not last):
                while self.through[at] >= s:
                    at = self.lower[at]
                owner, own_first = at, False
            else:
                owner, own_first = j, not last and not on_both
            found.append((2 * owner + own_first) << 32 | s)
        return found


def _agree(a, b):
    """How many leading symbols two lists have in common."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def _joined(nodes: DataFrame) -> DataFrame:
    """Nodes of all shards: those on edges put together."""
    spark = nodes.sparkSession
    ends = nodes.where(F.col("kind") == ENDS).select("shard", "first_list", "last_list")
    shards = sorted(r[0] for r in ends.select("shard").collect())  # a few numbers a shard come to the driver, no lists
    names = ["conv_id", "parent_conv_id", "gid", "size", "n", "kids", "leaves", "saved", "sid"]
    if not shards:
        return nodes.select(*names)
    before = spark.createDataFrame([(b, a) for a, b in zip(shards, shards[1:], strict=False)] + [(shards[0], -1)], "shard int, left int")
    lasts = ends.select(F.col("shard").alias("left"), F.col("last_list").alias("left_list"))
    agree = ends.join(before, "shard").join(lasts, "left", "left").select("shard", _agree(F.col("first_list"), F.col("last_list")).alias("inner"), F.coalesce(_agree(F.col("left_list"), F.col("first_list")), F.lit(0)).alias("outer"))
    agree = {r["shard"]: (r["inner"], r["outer"]) for r in agree.collect()}
    place = {s: k for k, s in enumerate(shards)}
    owners = Owners([agree[s][0] for s in shards], [agree[s][1] for s in shards])

    def keyed(batches):
        for batch in batches:
            kind, shard, last, size, above = (batch.column(c).to_pylist() for c in ("kind", "shard", "last", "size", "above"))
            keys = [owners.keys(place[s], side, d if k == EDGE else d - 1) if k == EDGE or up else [] for k, s, side, d, up in zip(kind, shard, last, size, above, strict=True)]
            first = [x[0] if x and k == EDGE else None for x, k in zip(keys, kind, strict=True)]
            parent = [(x[1] if k == EDGE and len(x) > 1 else x[0] if k == WHOLE else None) if up else None for x, k, up in zip(keys, kind, above, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(first, type=pa.int64()), pa.array(parent, type=pa.int64()), pa.array([x if k == EDGE else None for x, k in zip(keys, kind, strict=True)], type=pa.list_(pa.int64()))],
                names=[*batch.schema.names, "key", "parent_key", "line"],
            )

    kept = nodes.where(F.col("kind") != ENDS).drop("first_list", "last_list")
    schema = _NODES.rpartition("first_list")[0] + "key long, parent_key long, line array<long>"
    all_nodes = save(kept.mapInArrow(keyed, schema), "keyed")
    parts = all_nodes.where(F.col("kind") == EDGE).groupBy("key").agg(
        F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.max("cp").alias("cp"), F.max("sid").alias("sid"), F.max("gid").alias("gid"), F.max("size").alias("size"),
        F.max("parent_conv_id").alias("named"), F.max("parent_key").alias("parent_key"), F.max("line").alias("line"), *[F.sum(c).alias(c) for c in ("kids", "leaves", "saved")],
    )
    parts = save(parts, "edges")
    # Every list's key names its parent, whether or not the parent's name is known already.
    below = parts.where("size > 1").groupBy(F.get("line", F.lit(1)).alias("key")).agg(F.count("*").alias("edge_kids"))
    parts = parts.join(below, "key", "left").withColumn("kids", F.col("kids") + F.coalesce("edge_kids", F.lit(0)))
    own = parts.withColumns({"leaves": F.col("leaves") + (F.col("kids") == 0).cast("int"), "saved": F.col("saved") + (F.col("n") - 1) * F.col("cp")})
    own = save(own.drop("edge_kids"), "edges")
    totals = own.select(F.explode("line").alias("key"), "leaves", "saved").groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    named = own.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_name"))
    edge = own.drop("leaves", "saved").join(totals, "key").join(named, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("named", "parent_name"))
    whole = all_nodes.where(F.col("kind") == WHOLE)
    under = whole.where("above").drop("parent_conv_id").join(named.withColumnRenamed("parent_name", "parent_conv_id"), "parent_key")
    return edge.select(*names).unionByName(whole.where("not above").select(*names)).unionByName(under.select(*names))


# --- All blocks ----------------------------------------------------------------------------------


def _block(k: int, first: int, growth: int) -> tuple[int, int]:
    """Block k holds depths (a, b]."""
    sizes = [first * growth**i for i in range(k + 1)]
    return sum(sizes[:-1]), sum(sizes)


def _ends(ending: DataFrame) -> DataFrame:
    """(block, sid, ends_sha256) of (block, sid, conv_id): hash of the members' ids in order, read as a stream."""
    pieces = ending.groupBy("block", "sid", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    )

    def hashed(batches):
        held, digest, done = None, None, []
        for batch in batches:
            for block, sid, ids in zip(*(batch.column(c).to_pylist() for c in ("block", "sid", "ids")), strict=True):
                if held != (block, sid):
                    if held:
                        done.append((*held, digest.hexdigest()))
                    held, digest = (block, sid), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            if len(done) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int64(), pa.string()), strict=True)], names=["block", "sid", "ends_sha256"])
                done = []
        if held:
            done.append((*held, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int64(), pa.string()), strict=True)], names=["block", "sid", "ends_sha256"])

    return pieces.repartition("block", "sid").sortWithinPartitions("block", "sid", "piece").mapInArrow(hashed, "block int, sid long, ends_sha256 string")


def prefix_trie(convs: DataFrame, paths: DataFrame, first_block: int = FIRST_BLOCK, growth: int = GROWTH, per_shard: int = TURNS_PER_SHARD) -> DataFrame:
    """One row for each distinct prefix of the conversations, the empty one (depth 0) included:
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    convs: (conv_id, n_turns) of distinct conversations, turnless ones too; paths: (conv_id, depth,
    tid, cp) of their turns.  A tree without conversations has no nodes.  saved_tokens is what its
    subtree's nodes save: (members - 1) times the code points of the node's text.
    """
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    members = convs.withColumns({"gid": F.lit(0).cast("long"), "above": F.lit(None).cast("long")})
    blocks, ending, chains, k = [], [], [], 0
    while k == 0 or not members.isEmpty():
        a, b = _block(k, first_block, growth)
        inside = paths.where((F.col("depth") > a) & (F.col("depth") <= b))
        lists = inside.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "tid", "cp"))).alias("x"))
        lists = lists.select("conv_id", F.col("x.tid").alias("tids"), F.col("x.cp").cast("array<bigint>").alias("cps"))
        none = F.array().cast("array<bigint>")
        placed = save(members.join(lists, "conv_id", "left").withColumns({"tids": F.coalesce("tids", none), "cps": F.coalesce("cps", none)}), "placed")
        goes_on = F.col("n_turns") > b
        seqs = placed.groupBy("gid", "tids").agg(
            F.first("cps").alias("cps"), F.max("above").alias("above"), F.count("*").alias("n"), F.min("conv_id").alias("lo"), F.count_if(goes_on).alias("going"),
        )
        seqs = save(seqs.withColumn("sid", F.monotonically_increasing_id()), "lists")
        # A copy of a third of all conversations is one row here; the join's other side is split where it is hot.
        ids = save(placed.join(seqs.select("gid", "tids", "sid", "going", "lo"), ["gid", "tids"]).select("conv_id", "n_turns", "sid", "going", "lo"), "ids")
        ending.append(ids.where(~goes_on).select(F.lit(k).alias("block"), "sid", "conv_id"))
        chains.append(ids.where(goes_on & (F.col("going") == 1)).select("conv_id", F.lit(b).cast("long").alias("from"), "lo", "n_turns"))
        members = save(ids.where(goes_on & (F.col("going") > 1)).select("conv_id", "n_turns", F.col("sid").alias("gid"), F.col("lo").alias("above")), "members")
        blocks.append((a, seqs))
        k += 1

    ends, found, below = _reduce(ending), [], None
    ends = save(_ends(ends), "ends")
    for k in range(len(blocks) - 1, -1, -1):
        a, seqs = blocks[k]
        alone = (F.col("going") == 1).cast("long")
        if below is None:
            seqs = seqs.withColumns({"kids_below": alone, "leaves_below": alone, "saved_below": F.lit(0).cast("long")})
        else:
            seqs = seqs.join(below, "sid", "left").withColumns({
                "kids_below": F.coalesce("kids_below", alone), "leaves_below": F.coalesce("leaves_below", alone), "saved_below": F.coalesce("saved_below", F.lit(0).cast("long")),
            })
        turns = seqs.agg(F.sum(F.size("tids") + 1)).first()[0] or 0
        sorted_ = seqs.repartitionByRange(max(1, -(-turns // per_shard)), "gid", "tids").sortWithinPartitions("gid", "tids")
        nodes = save(_joined(save(sorted_.mapInArrow(_grow, _NODES), "shards")), "nodes")
        below = nodes.where("size = 1").select(F.col("gid").alias("sid"), F.col("kids").alias("kids_below"), F.col("leaves").alias("leaves_below"), F.col("saved").alias("saved_below"))
        own = nodes if k == 0 else nodes.where("size > 1")
        found.append(own.select("conv_id", (F.col("size") - 1 + a).cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.lit(k).alias("block"), "sid"))
    tree = _reduce(found).join(ends, ["block", "sid"], "left")
    # Chains: a row for each turn below the block where a conversation is left alone.
    alone = _reduce(chains)
    lone = paths.join(alone, "conv_id").where("depth > from")
    one = F.lit(1).cast("long")
    lone = lone.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("from") + 1, F.col("lo")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        (F.col("depth") < F.col("n_turns")).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("depth") == F.col("n_turns"), F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends_sha256"),
    )
    both = tree.select(*names, "ends_sha256").unionByName(lone)
    return both.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))


def _reduce(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def conversation_trie(conversations: DataFrame, **how) -> DataFrame:
    """The prefix trie of the rebuilt conversations (see `graft`) of (conv_id, turn, role, text).

    A null role or text is empty, null turns come first, rows with the same turn are ordered by role
    and text, repeated rows are turns of their own, rows without conv_id go, other columns are
    ignored, and an empty table gives no nodes.
    """
    return prefix_trie(*graft(number_turns(conversations, how.get("per_shard", TURNS_PER_SHARD))), **how)
