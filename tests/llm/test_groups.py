"""Exact duplicates, the conversation trie and periodic runs against brute force."""

import random

import numpy as np
import pytest

from codefacts.llm import convtrie, exactdup, runs
from codefacts.llm.queries import ORACLE_SQL, QUERIES

from . import brute_groups as brute

LONG = "abc" * 50_000
TEXTS = [
    (1, "a"), (2, "a"), (None, "a"), (3, None), (4, ""), (4, ""), (5, LONG), (6, LONG), (7, LONG + "x"), (8, LONG[:-1]), (9, "é" * 64), (10, "é" * 64),
    (11, "x" * 64), (12, "x" * 64), (13, "x" * 65), (None, "q"), (None, "q"), (14, "z" * 64 + "y" * 1024), (15, "z" * 64 + "y" * 1024), (16, "z" * 64 + "y" * 1023), (17, "tie"), (17, "tie"), (17, "other"),
]
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _ordered(rows):
    return sorted(tuple(-1 if v is None else v for v in r) for r in rows)


@pytest.mark.parametrize("digits", [{}, {"first_digit": 2, "growth": 2}])
def test_exact_is_brute_force(spark, digits):
    docs = spark.createDataFrame([(i, t, 1, True, "k") for i, t in TEXTS], "doc_id long, text string, gid long, kept boolean, digit string").repartition(3)
    rows = exactdup.deduplicate(docs, keep=("gid",), **digits).collect()
    want, groups = brute.exact(TEXTS)
    assert _ordered((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == _ordered(want)
    kept = [r for r in rows if r["kept"]]
    assert len(kept) == len(groups) and len({r["text_sha256"] for r in kept}) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_hot_group(spark):
    """A third of all rows is one text that is longer than several digits."""
    text = "common " * 400
    rows = [(k, text if k % 3 == 0 else f"{text}{k}") for k in range(900)]
    out = exactdup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r["keep_id"] for r in out.where("group_size > 1").collect()} == {897}
    assert out.where("kept").count() == 601


def test_exact_empty(spark):
    assert exactdup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def _conversations():
    rng, rows = random.Random(3), []
    for c in [None, -105, -100, *range(40), 100, 101, 150, 199, 200, 205, 250, 333, 399, 500]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 30])):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice([None, "u", "a"]), rng.choice([None, "", "x", "yy", "zé"])))
        if c is not None and c % 7 == 0:
            rows += [(c, 100 + t, "u", "same") for t in range(12)]
    return rows


@pytest.mark.parametrize("how", [{}, {"first_block": 4, "growth": 2, "per_shard": 20}, {"first_block": 2, "growth": 1, "per_shard": 7}, {"first_block": 300, "per_shard": 9}])
def test_trie_is_brute_force(spark, how):
    rows = _conversations()
    table = spark.createDataFrame([(*r, 5, "n") for r in rows], "conv_id long, turn long, role string, text string, depth long, tid string").repartition(4)
    assert _ordered(convtrie.conversation_trie(table, **how).select(*COLUMNS).collect()) == brute.trie(rows)


def test_trie_of_copies_and_one_long_conversation(spark):
    """A third of the rows is one conversation; half of the others are copies that diverge late."""
    rows = [(1, t, "u", f"t{t}") for t in range(600)] + [(c, t, "u", "x" if t < 11 else str(c)) for c in range(200, 300) for t in range(12)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    found = convtrie.conversation_trie(table, first_block=8, growth=2, per_shard=100).select(*COLUMNS).collect()
    assert _ordered(found) == brute.trie(rows)


def test_trie_empty(spark):
    assert convtrie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def _repetitive(rng):
    kinds = rng.choice([1, 2, 2, 3, 5, 40])
    x = [rng.randrange(kinds) for _ in range(rng.choice([0, 1, 5, 12, 30, 60, 150]))]
    for _ in range(rng.randint(0, 4)):
        p = rng.randint(1, 60)
        base = [rng.randrange(kinds) for _ in range(p)]
        if rng.random() < 0.3 and p > 4:  # a period that is periodic itself
            base = (base[: rng.randint(1, 4)] * 40)[:p]
        x += (base * 10)[: rng.randint(p, min(10 * p, 400))]
    return x[:600]


def test_runs_are_brute_force():
    rng = random.Random(5)
    for _ in range(120):
        texts = [_repetitive(rng) for _ in range(rng.randint(1, 5))]
        first = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
        found = runs.find_runs(np.array([v for x in texts for v in x], dtype=np.int64), first)
        want = [(a + f, b + f, q) for x, f in zip(texts, first[:-1].tolist(), strict=True) for a, b, q in brute.runs_of(x)]
        assert sorted(zip(*(v.tolist() for v in found), strict=True)) == sorted(want)


def test_runs_survive_sums_that_collide(monkeypatch):
    """Where the sums always agree, the words decide."""
    monkeypatch.setattr(runs.Agreement, "_equal", lambda self, i, j, n: np.ones(len(i), dtype=bool))
    x = [0, 1, 2] * 8 + [7, 8, 9, 10] * 5
    found = runs.find_runs(np.array(x), np.array([0, len(x)]))
    assert sorted(zip(*(v.tolist() for v in found), strict=True)) == brute.runs_of(x)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_runs_of_fibonacci_words(k):
    a, b = [0], [0, 1] * k
    while len(b) < 1500:
        a, b = b, b + a
    found = runs.find_runs(np.array(b), np.array([0, len(b)]))
    assert sorted(zip(*(v.tolist() for v in found), strict=True)) == brute.runs_of(b)


def test_periodic_runs_rows(spark, data):
    """Nulls, empty and repetitive texts, repeated rows, and the given documents of up to 1,000 words."""
    rng = random.Random(9)
    rows = [(None, "x " * 40), (1, None), (2, ""), (3, " \t\n "), (4, "na " * 500), (5, "a b c d e f " * 2), (5, "a b c d e f " * 2), (6, "\u00a0x\u2003 " * 12), (7, "one two")]
    rows += [(100 + k, " ".join(f"w{v}" for v in _repetitive(rng))) for k in range(60)]
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect() if len((r["text"] or "").split()) <= 1000]
    docs = spark.createDataFrame([(i, t, 5, 6, 7) for i, t in rows + real], "doc_id long, text string, start long, period long, n_runs long").repartition(3)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    got = sorted(map(key, runs.periodic_runs(docs).collect()))
    assert got == sorted(key(brute.periodic(i, t)) for i, t in rows + real)


def test_periodic_runs_of_long_texts(spark):
    text = " ".join(f"w{k % 997}x{k % 31}" for k in range(70_000))  # a period of 30,907
    (row,) = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), cycle=False).collect()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 0, 70_000, 30_907)
    assert runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_conversation_trie"])
def test_sql_gives_the_rows(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    found = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert _ordered(QUERIES[name](spark, data).select(*columns).collect()) == _ordered(found.fetchall())
