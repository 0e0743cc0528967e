"""What only larger or odder tables than the driver's small ones show."""

import tracemalloc
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa

from codefacts.llm import rpforest
from codefacts.operators import buildfacts, facts
from codefacts.queries import ORACLE_SQL, QUERIES
from codefacts.scratch import shared_dir
from codefacts.sources import read_by_project, write_error_text, write_failed_vectors


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_requests_of_projects_without_entities(spark, tmp_path):
    # Documents 0 and 300 are alone in their projects and give no entity.
    docs = [(k, f'te"xt {k}', "en", f"src{k // 300}", 7) for k in (0, 300, 301, 604, 605)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").where("doc_id <> 301")
    frame.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    name = "d12_build_requests_entities"
    got = QUERIES[name](spark, str(tmp_path)).select("project_id", "n_files", "n_entities", "payload")
    assert _rows(got) == sorted(con.execute(f"select project_id, n_files, n_entities, payload from ({ORACLE_SQL[name]})").fetchall())
    assert [r[2] for r in _rows(got)] == [0, 0, 2]


def test_requests_without_entities_hold_an_empty_list(spark):
    files = spark.createDataFrame([("p", "f", "x")], "project_id string, path string, text string")
    entities = spark.createDataFrame([], "project_id string, entity_seq long, name string, kind string, text string")
    assert facts.build_requests(files, entities).first()["payload"] == '{"files":[{"path":"f","contents":"x"}],"entities":[]}'


ODD = ["p", "a b", "ä/ö", "x=1%+{2}:'*?", "q\\r", ""]


def test_error_text_is_dealt_by_project(spark, tmp_path):
    lines = [(p, f"{k} é\tx") for p in ODD for k in range(40)] + [("none", None), ("p", "")]
    rows = spark.createDataFrame(lines, "project_id string, line string").repartition(8)
    path = str(tmp_path / "err")
    write_error_text(rows, path)
    wanted = [(p or None, line) for p, line in lines if line is not None]
    key = lambda r: (r[0] or "", r[1])
    assert sorted(map(tuple, read_by_project(spark, path).collect()), key=key) == sorted(wanted, key=key)
    # Spark's reader finds the same; a project's lines lie in a file, or two where a task ends, not in one of each task before.
    by_spark = spark.read.schema("value string, project_id string").text(path).select("project_id", "value")
    assert sorted(map(tuple, by_spark.collect()), key=key) == sorted(wanted, key=key)
    assert len(list((tmp_path / "err").glob("*/part-*"))) <= len(ODD) + 4
    write_error_text(rows.where("project_id = 'p'"), path)  # in place of the former
    assert {r["project_id"] for r in read_by_project(spark, path).collect()} == {"p"}
    write_error_text(rows.where("project_id = 'none'"), path)
    assert read_by_project(spark, path).collect() == []


def test_failed_vectors_are_dealt_by_project(spark, tmp_path):
    vectors = spark.createDataFrame([(p, f"v{k}", None if k % 2 else 'a "b"\n') for p in ODD[:-1] for k in range(40)], "project_id string, filename string, stdin string").repartition(8)
    outcome = vectors.selectExpr("project_id", "filename", "filename like '%5' as passed", "filename = 'v7' as skipped")
    path = str(tmp_path / "failed")
    write_failed_vectors(vectors, outcome, path)
    wanted = _rows(vectors.where("filename not like '%5' and filename <> 'v7'").selectExpr("project_id", "filename", "coalesce(stdin, '-')"))
    schema = "filename string, stdin string"
    assert _rows(spark.read.schema("project_id string, " + schema).json(path).selectExpr("project_id", "filename", "coalesce(stdin, '-')")) == wanted
    assert _rows(read_by_project(spark, path).selectExpr("project_id", f"from_json(value, '{schema}') as x").selectExpr("project_id", "x.filename", "coalesce(x.stdin, '-')")) == wanted
    assert len(list((tmp_path / "failed").glob("*/part-*"))) <= len(ODD) + 3


def test_scripts_are_read_in_bounded_memory():
    # 160,000 calls, half of them in one file: before, all calls of a batch of files were held at once.
    text = "".join(f"set(V{k} a b c)\n" for k in range(2_000))
    texts = [text] * 40 + [None, "", text * 40 + "list(left open"]
    batch = pa.RecordBatch.from_pydict({"project_id": [f"p{k}" for k in range(len(texts))], "file": ["f"] * len(texts), "text": texts})
    calls, largest, last = {}, 0, None
    tracemalloc.start()
    for found in buildfacts._statements_of(iter([batch])):
        largest = max(largest, found.num_rows)
        for p, n in zip(*(x.to_pylist() for x in found.column("project_id").value_counts().flatten()), strict=True):
            calls[p] = calls.get(p, 0) + n
        last = found.slice(found.num_rows - 1).to_pylist()[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert calls == {**{f"p{k}": 2_000 for k in range(40)}, "p42": 80_001}
    assert last == {"project_id": "p42", "file": "f", "seq": 80_000, "command": "list", "args": ["left", "open"], "truncated": True}
    assert largest < 20_000 and peak < 40e6, (largest, peak)


def test_forest_leaves_no_copies_of_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.standard_normal(8 if k % 3 else 5)], "a") for k in range(400)]
    rows += [(1000 + k, [x + 1e-4 for x in rows[k][1]], "a") for k in range(50)]
    folder = Path(shared_dir(spark).removeprefix("file:")) / "codefacts"
    before = set(folder.glob("*"))
    found = rpforest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), 0.98, leaf=40, block=16)
    kinds = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
    assert not kinds & {"roots", "level", "projected", "leaves", "nodes", "cuts"}, kinds
    links = {r["vec_id"]: r["n_links"] for r in found.collect()}
    for k, v, _ in rows:
        near = [j for j, w, _ in rows if j != k and len(w) == len(v) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98]
        assert links[k] == len(near)
