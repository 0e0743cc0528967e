"""Toxicity by non-negative positive-unlabelled learning.

The classifier learns from confirmed toxic texts and from texts whose labels it doesn't look at.
With prior p, positive texts P and unlabelled texts U the risk of a scorer z is estimated as

    p * E_P[loss(z)] + max(0, E_U[loss(-z)] - p * E_P[loss(-z)])

where the second part stands for the risk on the (unseen) negatives; once it falls below zero the
step goes against it, which keeps the scorer from explaining away unlabelled positives.

Texts are seen as the set of their words and word beginnings (ASCII letters folded), hashed; only
features that are clearly commoner in the positives than in the unlabelled texts get a weight.  The
fit runs on bounded samples, drawn by hash of doc_id; scoring covers whole texts of all documents
and carries only the few thousand weights to the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .words import Words, mix, slices

MAX_POSITIVE, MAX_UNLABELLED, MAX_FEATURES = 2_000, 6_000, 4_096
_PREFIXES = (4, 5, 6)
_BREAKS = np.ones(256, dtype=bool)
_BREAKS[128:] = False
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_FILTER_BITS = 20


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    prior: float


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word and word beginning."""
    kinds = [w.hash]
    rows = [w.doc]
    length = w.ends - w.starts
    for n in _PREFIXES:
        long = length >= n
        kinds.append(mix(w.hash_of(w.starts[long], w.starts[long] + n) ^ np.uint64(n)))
        rows.append(w.doc[long])
    return np.concatenate(kinds), np.concatenate(rows)


def _feature_sets(docs: DataFrame) -> DataFrame:
    """The distinct features of each text, as 64-bit integers in bytes."""

    def run(batches):
        for batch in batches:
            positive = batch.column("positive")
            for a, b, data, offsets in slices(batch.column("text")):
                h, row = _features(Words(data, offsets, fold=True, separators=_BREAKS))
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(b - a + 1))
                sets = [np.unique(h[order[s:e]]).tobytes() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([positive.slice(a, b - a), pa.array(sets, type=pa.binary())], names=["positive", "features"])

    return docs.select("positive", "text").mapInArrow(run, "positive boolean, features binary")


def _share(wanted: int, there: int) -> float:
    return min(1.0, wanted / max(1, there))


def _drawn(key: str, share: float) -> Column:
    """A share of rows by hash of the key: the same rows at every run."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_features: int = MAX_FEATURES) -> Model:
    """Fit on about max_positive toxic texts and max_unlabelled other texts (at most twice as many).

    Labels of held-out rows, other columns and doc_id itself are not looked at.  The prior is the
    share of toxic rows among all labels that may be learnt from.  Without toxic labels the model
    gives every text the prior.  A null text counts as an empty one, which has no features; repeated
    rows count as often as they occur; a doc_id with conflicting labels counts once for each in the
    prior and as toxic in the fit; labels other than 0 and 1 are ignored.  Empty tables give the model
    of no toxic labels.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(0.9, max(1e-4, toxic / n)) if n else 0.0
    nothing = Model(np.zeros(0, dtype=np.uint64), np.zeros(0), float(np.log(max(prior, 1e-4) / (1 - max(prior, 1e-4)))), prior)
    if not toxic:
        return nothing
    chosen = known.where("toxic = 1").where(_drawn("doc_id", _share(max_positive, toxic))).select("doc_id").distinct().limit(2 * max_positive)
    positive = docs.join(F.broadcast(chosen), "doc_id", "left_semi").select(F.lit(True).alias("positive"), "text")  # bounded by the limit
    rows = docs.where(~held_out(F.col("doc_id")))
    other = rows.where(_drawn("doc_id", _share(max_unlabelled, docs.count()))).limit(2 * max_unlabelled).select(F.lit(False).alias("positive"), "text")
    sets = {True: [], False: []}
    for r in _feature_sets(positive.unionByName(other)).toLocalIterator():
        sets[r["positive"]].append(np.frombuffer(bytes(r["features"]), dtype=np.uint64))
    if not sets[True] or not sets[False]:
        return nothing
    return _train(sets[True], sets[False], prior, max_features)


def _train(positive: list[np.ndarray], other: list[np.ndarray], prior: float, max_features: int, rounds: int = 400, rate: float = 0.05, l2: float = 1e-4) -> Model:
    p_hash, p_n = np.unique(np.concatenate(positive), return_counts=True)
    u_hash, u_n = np.unique(np.concatenate(other), return_counts=True)
    at = np.searchsorted(u_hash, p_hash)
    at[at == len(u_hash)] = 0
    in_u = np.where(u_hash[at] == p_hash, u_n[at], 0)
    fp, fu = (p_n + 0.5) / (len(positive) + 1), (in_u + 0.5) / (len(other) + 1)
    # Of the unlabelled, `prior` are positive too: what is left is the rate in the negatives.
    fn = np.maximum((fu - prior * fp) / (1 - prior), 0.5 / (len(other) + 1))
    good = (p_n >= 3) & (fp > 4 * fn) & (fp - fu > 2 * np.sqrt(fp / len(positive) + fu / len(other)))
    strength = np.where(good, p_n * np.log(fp / fn), 0.0)
    best = np.sort(np.argsort(-strength, kind="stable")[: min(max_features, int(good.sum()))])
    features = p_hash[best]

    def coded(sets):
        rows, cols = [], []
        for r, s in enumerate(sets):
            c = np.searchsorted(features, s)
            c[c == len(features)] = 0
            c = c[features[c] == s] if len(features) else c[:0]
            rows.append(np.full(len(c), r))
            cols.append(c)
        return np.concatenate(rows).astype(np.int64), np.concatenate(cols).astype(np.int64), len(sets)

    (pr, pc, pn), (ur, uc, un) = coded(positive), coded(other)
    w, bias = np.zeros(len(features)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    softplus = lambda z: np.logaddexp(0, z)
    for t in range(1, rounds + 1):
        zp = np.bincount(pr, w[pc], minlength=pn) + bias
        zu = np.bincount(ur, w[uc], minlength=un) + bias
        negative = softplus(zu).mean() - prior * softplus(zp).mean()
        gp = -prior * sigmoid(-zp) / pn
        if negative >= 0:
            gp, gu = gp - prior * sigmoid(zp) / pn, sigmoid(zu) / un
        else:  # step against the negative part
            gp, gu = prior * sigmoid(zp) / pn, -sigmoid(zu) / un
        g = np.append(np.bincount(pc, gp[pr], minlength=len(w)) + np.bincount(uc, gu[ur], minlength=len(w)) + l2 * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(features, w, bias, prior)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, text and the other columns in `keep`, a row for each row.

    A null or empty text gets the score of a text without features.  Rows without doc_id are scored
    like others and are not held out; repeated rows get the same score.  An empty table gives an empty
    result, and columns other than doc_id, text and those in `keep` are ignored, whatever their names.
    """
    features, weights, bias = model.features, model.weights, model.bias
    schema = docs.select(F.col("doc_id").cast("long"), "text", *keep).schema

    def run(batches):
        sieve = np.zeros(1 << _FILTER_BITS, dtype=bool)
        sieve[features & np.uint64((1 << _FILTER_BITS) - 1)] = True
        for batch in batches:
            out = []
            for a, b, data, offsets in slices(batch.column("text")):
                total = np.full(b - a, bias)
                if len(features):
                    h, row = _features(Words(data, offsets, fold=True, separators=_BREAKS))
                    some = sieve[h & np.uint64((1 << _FILTER_BITS) - 1)]
                    h, row = h[some], row[some]
                    c = np.searchsorted(features, h)
                    c[c == len(features)] = 0
                    hit = features[c] == h
                    pairs = np.unique(row[hit] * np.int64(len(features)) + c[hit])
                    np.add.at(total, pairs // len(features), weights[pairs % len(features)])
                out.append(1 / (1 + np.exp(-np.clip(total, -40, 40))))
            scores = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep).mapInArrow(run, StructType([*schema.fields, StructField("score", DoubleType())]))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text", *keep,
    )
