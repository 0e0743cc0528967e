"""Approximate nearest neighbours: an NN-descent graph built by iterative joins, and greedy search.

Build: every vector starts with random neighbours.  In a round it sends itself to its neighbours and
to those that have it as a neighbour; whoever receives (at most `degree` of the latter, drawn by
hash, besides all of its own neighbours) compares what came in pairwise and tells each vector of
nearer ones than it has.  Neighbours of neighbours so become neighbours, until few lists change.

Search: a query's beam starts at its own place in the graph; in each step the best nodes of the beam
not yet expanded meet their adjacency rows in a join, and the neighbours found enter the beam, until
all that is in the beam is expanded.  All queries advance together.  Adjacency rows lie bucketed by
node, so a step shuffles the frontier only.

Equal vectors (by two 64-bit hashes with fixed constants) are one node.  Nearness is the inner product; vectors are extended by the component
that gives all the same length, which turns it into a metric for the graph.  Graph and beam work on
8-bit codes of the vectors, each with a scale of its own, beside which the extra component's share is
kept as a number: a single very long vector doesn't coarsen the codes of the others.  The last
candidates are compared exactly, on the original vectors in double precision.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save
from .vectors import keyed, matrix, usable

DEGREE, OFFERS = 20, 8
BEAM, EXPAND = 560, 112
EXACT = 64
#: The build ends with the round in which less than this share of the lists' places changes.
SETTLED = 0.02
#: A build or search that isn't done by then is an error.
ROUNDS, STEPS = 60, 1_000
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 32 << 20, 24, 100_000


def _coded(x: np.ndarray, longest: float) -> list[bytes]:
    """8-bit codes of rows: float32 scale and short, then a byte a component.  With e the component that
    extends a row to the length `longest`, short is (longest - e) / longest: small, where e is nearly all."""
    square = (x**2).sum(axis=1)
    short = square / (longest * (longest + np.sqrt(np.maximum(longest**2 - square, 0))))
    scale = np.abs(x).max(axis=1, initial=0) / 127
    scale[scale == 0] = 1
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    numbers = np.stack((scale, short), axis=1).astype("<f4")
    return [s.tobytes() + c.tobytes() for s, c in zip(numbers, codes, strict=True)]


def _decoded(raw: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their shorts."""
    table = np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1)
    numbers = np.ascontiguousarray(table[:, :8]).view("<f4")
    return np.ascontiguousarray(table[:, 8:]).view(np.int8).astype(np.float32) * numbers[:, :1], numbers[:, 1]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best distinct ids, best first, ties by id."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    return ids[first[:k]], scores[first[:k]]


def _joined(batches, emit, names):
    """Runs of equal `center` in sorted batches, each as numpy columns."""
    held = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        center = held.column("center").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], center[1:] != center[:-1]))) if len(center) else np.zeros(1, dtype=np.int64)
        if len(starts) > 1:
            yield from emit(held.slice(0, int(starts[-1])), starts)
            held = held.slice(int(starts[-1]))
    if held is not None and held.num_rows:
        yield from emit(held, np.array([0, held.num_rows]))


def _messages(graph: DataFrame, degree: int, seed: int) -> DataFrame:
    """(center, member, least, code): each node with its neighbours and up to `degree` others that
    have it as theirs, sorted by center within partitions."""
    forward = graph.select("cid", F.explode("ids").alias("n"))
    # Who has a node as a neighbour: bounded before the shuffle (the rank is limited map-side too).
    some = Window.partitionBy("n").orderBy(F.xxhash64("cid", "n", F.lit(seed)))
    backward = forward.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= degree)
    # A node goes to those that have it as a neighbour, to its own neighbours, and to itself.
    to_owner = forward.select(F.col("n").alias("cid"), F.col("cid").alias("center"))
    to_neighbour = backward.select("cid", F.col("n").alias("center"))
    routes = to_owner.union(to_neighbour).union(graph.select("cid", F.col("cid").alias("center"))).distinct()
    return (
        routes.join(graph.select("cid", "code", "least"), "cid")
        .select("center", F.col("cid").alias("member"), "least", "code")
        .repartition("center").sortWithinPartitions("center", "member")
    )


def _offers(offers: int, longest: float):
    """Pairwise comparison around each center: for each member, nearer ones than it has."""

    def emit(table, starts):
        member, least = table.column("member").to_numpy(), table.column("least").to_numpy()
        codes = table.column("code").combine_chunks()
        starts = np.unique(np.append(starts[starts < table.num_rows], table.num_rows))
        to, ids, scores = [], [], []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            own = codes.slice(s, e - s)
            x, short = _decoded(b"".join(own.to_pylist()), e - s)
            # Inner product of the extended vectors, less the square of their common length.
            near = x @ x.T + np.float32(longest**2) * (np.multiply.outer(short, short) - np.add.outer(short, short))
            np.fill_diagonal(near, -np.inf)
            near[near <= least[s:e][:, None]] = -np.inf
            k = min(offers, e - s)
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(near, top, axis=1)
            rows, columns = np.nonzero(value > -np.inf)
            to.append(member[s:e][rows])
            ids.append(member[s:e][top[rows, columns]])
            scores.append(value[rows, columns])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(to)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores).astype(np.float32))], names=["cid", "id", "score"])

    return lambda batches: _joined(batches, emit, None)


def _random_graph(nodes: DataFrame, n: int, degree: int) -> DataFrame:
    """A few rounds of random small groups; with few nodes, one group of all."""
    rounds, size = (1, max(1, n)) if n <= 2 * degree else (4, degree // 4 + 1)
    groups = max(1, n // size)
    grouped = nodes.select("cid", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r"))
    grouped = grouped.withColumn("g", F.pmod(F.xxhash64("cid", "r"), F.lit(groups)))
    lists = grouped.groupBy("r", "g").agg(F.collect_list("cid").alias("all"))  # about `size` each
    return (
        lists.select(F.explode("all").alias("cid"), "all").groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("all"))).alias("ids"))
        .select("cid", F.array_remove("ids", F.col("cid")).alias("ids"))
    )


def _merged(degree: int):
    def run(batches):
        for batch in batches:
            out_ids, out_scores, least, changed = [], [], [], []
            for ids, scores, new_ids, new_scores in zip(*(batch.column(c) for c in ("ids", "scores", "new_ids", "new_scores")), strict=True):
                a, b = ids.values.to_numpy(), scores.values.to_numpy()
                if new_ids.is_valid:
                    c, d = _best(np.concatenate((a, new_ids.values.to_numpy())), np.concatenate((b, new_scores.values.to_numpy())), degree)
                else:
                    c, d = a, b
                changed.append(len(np.setdiff1d(c, a)))
                out_ids.append(c)
                out_scores.append(d)
                least.append(float(d[-1]) if len(d) >= degree else float("-inf"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("code"), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_scores, pa.list_(pa.float32())), pa.array(least, pa.float32()), pa.array(changed, pa.int64())],
                names=["cid", "code", "ids", "scores", "least", "changed"],
            )

    return run


_GRAPH = "cid long, code binary, ids array<long>, scores array<float>, least float, changed long"


def build(nodes: DataFrame, n: int, longest: float, degree: int = DEGREE, rounds: int = ROUNDS, offers: int = OFFERS) -> DataFrame:
    """The graph of nodes (cid, code): cid, code, ids and scores of up to `degree` neighbours, least.

    Rounds go on until less than the share SETTLED of the lists' places change; more than `rounds` are
    an error.
    """
    start = _random_graph(nodes, n, degree)
    graph = nodes.join(start, "cid").select("cid", "code", "ids", F.lit(None).cast("array<float>").alias("scores"), F.lit(float("-inf")).cast("float").alias("least"))
    for r in range(rounds):
        found = _messages(graph, degree, r).mapInArrow(_offers(offers if r else degree, longest), "cid long, id long, score float")
        grouped = found.groupBy("cid").agg(F.collect_list("id").alias("new_ids"), F.collect_list("score").alias("new_scores"))
        if r == 0:  # the first neighbours have no scores: what the round offers takes their place
            graph = graph.withColumns({"ids": F.array().cast("array<long>"), "scores": F.array().cast("array<float>")})
        graph = save(graph.drop("changed").join(grouped, "cid", "left").mapInArrow(_merged(degree), _GRAPH), "graph")
        if (graph.agg(F.sum("changed")).first()[0] or 0) <= SETTLED * degree * n:
            return graph
    raise RuntimeError(f"the graph did not settle in {rounds} rounds")


def _adjacency(graph: DataFrame, degree: int) -> DataFrame:
    """(node, ids, codes), bucketed by node; the number of buckets follows from the graph's size."""

    def emit(table, starts):
        starts = np.unique(np.append(starts[starts < table.num_rows], table.num_rows))
        center, member = table.column("center").to_numpy(), table.column("member").to_numpy()
        codes = table.column("code").combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [pa.array(center[starts[:-1]]), pa.array([member[s:e] for s, e in zip(starts[:-1], starts[1:], strict=True)], pa.list_(pa.int64())),
             pa.array([b"".join(codes.slice(s, e - s).to_pylist()) for s, e in zip(starts[:-1], starts[1:], strict=True)], pa.binary())],
            names=["node", "ids", "codes"],
        )

    rows = _messages(graph, degree, -1).mapInArrow(lambda batches: _joined(batches, emit, None), "node long, ids array<long>, codes binary")
    name = f"codefacts_{uuid.uuid4().hex}"
    size = graph.agg(F.sum(F.octet_length("code") + 8)).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-2 * degree * size // BUCKET_BYTES)))
    rows.write.bucketBy(buckets, "node").saveAsTable(name)
    return graph.sparkSession.table(name)


def _expanded(batches):
    """Frontier rows with their node's adjacency -> neighbours nearer than the beam's last."""
    for batch in batches:
        queries, ids, scores = [], [], []
        last, q = None, None
        for cid, code, least, own, codes in zip(batch.column("cid").to_numpy(), *(batch.column(c) for c in ("code", "least", "ids", "codes")), strict=True):
            if cid != last:
                last, q = cid, _decoded(code.as_py(), 1)[0][0]
            member = own.values.to_numpy()
            score = _decoded(codes.as_py(), len(member))[0] @ q
            good = np.flatnonzero(score > least.as_py())
            queries.append(np.full(len(good), cid))
            ids.append(member[good])
            scores.append(score[good])
        if queries:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(queries)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores).astype(np.float32))], names=["cid", "id", "score"])


def _beams(beam: int, expand: int):
    def run(batches):
        for batch in batches:
            out = {c: [] for c in ("ids", "scores", "done", "todo", "least")}
            for ids, scores, done, todo, new_ids, new_scores in zip(*(batch.column(c) for c in ("ids", "scores", "done", "todo", "new_ids", "new_scores")), strict=True):
                a, b = ids.values.to_numpy(), scores.values.to_numpy()
                finished = np.concatenate((done.values.to_numpy(), todo.values.to_numpy()))
                if new_ids.is_valid:
                    a, b = _best(np.concatenate((a, new_ids.values.to_numpy())), np.concatenate((b, new_scores.values.to_numpy())), beam)
                finished = np.intersect1d(finished, a)  # what fell out of the beam won't come back
                out["ids"].append(a)
                out["scores"].append(b)
                out["done"].append(finished)
                out["todo"].append(a[~np.isin(a, finished)][:expand])
                out["least"].append(float(b[-1]) if len(b) >= beam else float("-inf"))
            longs, floats = pa.list_(pa.int64()), pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("code"), pa.array(out["ids"], longs), pa.array(out["scores"], floats), pa.array(out["done"], longs), pa.array(out["todo"], longs), pa.array(out["least"], pa.float32())],
                names=["cid", "code", "ids", "scores", "done", "todo", "least"],
            )

    return run


_BEAMS = "cid long, code binary, ids array<long>, scores array<float>, done array<long>, todo array<long>, least float"


def search(graph: DataFrame, queries: DataFrame, degree: int = DEGREE, beam: int = BEAM, expand: int = EXPAND, steps: int = STEPS) -> DataFrame:
    """Beams of the query nodes (cid): cid, ids best first.  Each starts at its own node and goes on
    until all of its beam is expanded; a search that takes more than `steps` is an error.  Queries that
    are done don't take part in further steps."""
    adjacency = _adjacency(graph, degree)
    empty = F.array().cast("array<long>")
    state = graph.join(queries, "cid", "left_semi").select(
        "cid", "code", empty.alias("ids"), F.array().cast("array<float>").alias("scores"), empty.alias("done"), F.array("cid").alias("todo"), F.lit(float("-inf")).cast("float").alias("least")
    )
    done: list[DataFrame] = []
    for _ in range(steps):
        frontier = state.select("cid", "code", "least", F.explode("todo").alias("node")).hint("shuffle_hash")
        found = adjacency.join(frontier, "node").select("cid", "code", "least", "ids", "codes").mapInArrow(_expanded, "cid long, id long, score float")
        grouped = found.groupBy("cid").agg(F.collect_list("id").alias("new_ids"), F.collect_list("score").alias("new_scores"))
        state = save(state.join(grouped, "cid", "left").mapInArrow(_beams(beam, expand), _BEAMS), "beams")
        done.append(state.where(F.size("todo") == 0).select("cid", "ids"))
        state = state.where(F.size("todo") > 0)
        if state.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"a search did not end in {steps} steps")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, degree: int = DEGREE, beam: int = BEAM, expand: int = EXPAND, exact: int = EXACT) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose vec_id is divisible by `every`, the k
    nearest found among all others by inner product, ties to the smaller vec_id; all, if fewer.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, and
    neither do rows without vec_id.  Vectors of one length are searched among themselves, one length
    after the other (tables have few).  Rows that repeat a vec_id with an equal vector count once.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    rows = keyed(vectors).where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    lengths = [r["dim"] for r in rows.select("dim").distinct().orderBy("dim").collect()]
    found = [_nearest(rows.where(F.col("dim") == dim).drop("dim"), every, k, degree, beam, expand, exact) for dim in lengths]
    return reduce(DataFrame.unionByName, found) if found else _nearest(rows.drop("dim"), every, k, degree, beam, expand, exact)


def _nearest(rows: DataFrame, every: int, k: int, degree: int, beam: int, expand: int, exact: int) -> DataFrame:
    """nearest() of keyed vectors of one length."""
    rows = save(rows.dropDuplicates(["vec_id", "k1", "k2"]), "vectors")
    # The first k + 1 of equal vectors are all that a result can hold of them.
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    firsts = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    nodes = firsts.groupBy("k1", "k2").agg(F.min("vec_id").alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("members"), F.first("vector").alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    nodes = save(nodes, "nodes")
    n, longest = nodes.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(1.0))).first()

    def code(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(_coded(matrix(batch.column("vector")), longest), pa.binary())], names=["cid", "code"])

    asked = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "k1", "k2").join(nodes.select("k1", "k2", "cid"), ["k1", "k2"])
    asked = save(asked.select("query_id", "cid"), "queries")
    graph = build(save(nodes.select("cid", "vector").mapInArrow(code, "cid long, code binary"), "codes"), n, longest, degree)
    beams = search(graph, asked.select("cid").distinct(), degree, beam, expand)
    own = F.array_distinct(F.concat(F.array("cid"), F.slice("ids", 1, exact)))
    pairs = beams.select("cid", F.explode(own).alias("other"))
    vector = nodes.select("cid", F.col("vector").alias("x"))
    kind = dict(nodes.dtypes)["vector"]

    def products(batches):
        for batch in batches:
            x, y = matrix(batch.column("x")), matrix(batch.column("y"))
            score = (x * y).sum(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("members"), pa.array(score)], names=["cid", "members", "score"])

    compared = (
        pairs.join(nodes.select(F.col("cid").alias("other"), "members", F.col("vector").alias("y")), "other").join(vector, "cid")
        .select("cid", "members", "x", "y").mapInArrow(products, "cid long, members array<long>, score double")
    )
    found = asked.join(compared, "cid").select("query_id", F.explode("members").alias("vec_id"), "score").where("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
