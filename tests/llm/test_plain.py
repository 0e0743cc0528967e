"""Sharding and toxicity against plain versions of their methods."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from codefacts.llm import sharding, toxicity


def _longest_first(rows, shards):
    """Shard loads of groups of equal texts, the largest first, each to the least-loaded shard."""
    size = defaultdict(int)
    for _, text in rows:
        size[text] += len((text or "").encode()) + 16
    loads, where = [0] * shards, {}
    for text, n in sorted(size.items(), key=lambda x: (-x[1], str(x[0]))):
        s = min(range(shards), key=lambda k: (loads[k], k))
        loads[s] += n
        where[text] = s
    return sorted(loads), where


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_shards_are_a_plain_longest_first_run(spark, shards):
    """Few groups, each an item of its own: the plan is the plain one, loads and all."""
    rng = random.Random(shards)
    texts = ["x" * rng.randint(500, 4_000) + str(k) for k in range(60)] + ["hot " * 900] + [None, ""]
    rows = [(k, rng.choice(texts)) for k in range(200)] + [(500 + k, texts[60]) for k in range(100)] + [(None, texts[0]), (7, texts[1]), (7, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sharding.shard(docs, shards=shards).collect()
    loads = [0] * shards
    for r in found:
        loads[r["shard"]] += r["size"]
    want, _ = _longest_first(rows, shards)
    # Null and empty texts are the only groups small enough to be bundled.
    assert max(abs(a - b) for a, b in zip(sorted(loads), want, strict=True)) <= 16 * 10
    assert sorted(r["slot"] for r in found if r["shard"] == 0) == list(range(sum(r["shard"] == 0 for r in found)))


def test_ties_go_by_name():
    assert sharding.longest_first([("b", 5), ("a", 5), ("c", 5), ("d", 1)], 3) == {"a": 0, "b": 1, "c": 2, "d": 0}


def test_token_files_order_rows_of_one_id(spark, tmp_path):
    """Repeated and missing doc_ids: the same starts and checksums from any partitioning."""
    import public_tokenizers as P

    from codefacts.llm import tokens

    rows = [(k % 5 if k % 3 else None, f"text {k % 7} of {k % 4}") for k in range(60)] + [(2, None), (2, "")]
    found = []
    for n in (1, 4, 7):
        out = f"{tmp_path}/{n}"
        tokens.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(n, "text"), P.path("byte_bpe_50k.json"), out, end_id=2)
        found.append(sorted((r["start"], -1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in tokens.read(spark, out).collect()))
    assert found[0] == found[1] == found[2] and [r[1] for r in found[0]] == sorted(r[1] for r in found[0])


def _dense_scores(docs, model):
    """Scores from a matrix with a column for each feature."""
    out = {}
    for doc_id, text in docs:
        words = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in (text or "")).encode().lower().split()
        found = set()
        for word in words:
            found.add(("w", word))
            found |= {(n, word[:n]) for n in (4, 5, 6) if len(word) >= n}
        out[doc_id] = found
    names = sorted(set().union(*out.values()), key=str)
    column = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(out), len(names)))
    for r, found in enumerate(out.values()):
        x[r, [column[f] for f in found]] = 1
    return list(out), names, x, model


def test_scores_are_those_of_a_dense_matrix(spark):
    from codefacts.llm.words import Words, mix

    rng = random.Random(2)
    vocabulary = ["Vile", "vileness", "ugly", "fine", "day", "über", "a1b2c3d4", "ok"]
    docs = [(k, rng.choice(["", " ", "; "]).join([rng.choice(vocabulary) + rng.choice([" ", ", ", "-"]) for _ in range(rng.randint(0, 30))])) for k in range(300)] + [(900, None), (901, "")]
    toxic = {k for k, t in docs if t and "Vile" in t and k < 900}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k in toxic)) for k, _ in docs if k < 200], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    assert len(model.features)
    ids, names, x, _ = _dense_scores(docs, model)

    def hashed(kind, word):
        w = Words(np.frombuffer(word, dtype=np.uint8), np.array([0, len(word)]))
        return w.hash[0] if kind == "w" else mix(w.hash_of(np.array([0]), np.array([len(word)])) ^ np.uint64(kind))[0]

    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    z = x @ np.array([weight.get(int(hashed(kind, word)), 0.0) for kind, word in names]) + model.bias
    want = {i: 1 / (1 + math.exp(-v)) for i, v in zip(ids, z, strict=True)}
    found = {r["doc_id"]: r["score"] for r in toxicity.score(frame, model).collect()}
    assert found.keys() == want.keys() and all(abs(found[i] - want[i]) < 1e-9 for i in want)


def test_odd_rows_and_labels(spark):
    """Null texts, repeated rows, conflicting labels, clashing columns, empty tables: as the docstrings say."""
    schema = "doc_id long, text string, score double, features string, positive boolean"
    rows = [(k, "vile thing" if k % 2 else "fine day", 9.0, "f", True) for k in range(400)] + [(1, "vile thing", 0.0, "f", False)] * 3 + [(None, "vile thing", 0.0, "f", False), (500, None, 0.0, "f", False)]
    docs, labels = spark.createDataFrame(rows, schema), spark.createDataFrame([(k, k % 2) for k in range(400)] + [(3, 0), (3, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    found = toxicity.score(docs, model, keep=("positive",)).collect()
    assert len(found) == len(rows) and len({r["score"] for r in found if r["text"] == "vile thing"}) == 1
    assert all(r["predicted"] == 1 for r in found if r["text"] == "vile thing") and all(r["predicted"] == 0 for r in found if r["text"] != "vile thing")
    assert toxicity.score(spark.createDataFrame([], schema), model).count() == 0
