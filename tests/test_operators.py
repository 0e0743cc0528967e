"""Literal cases, invariants, sources and streams."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from codefacts import functions as fn
from codefacts.operators import buildfacts, facts, matrix, results, spans
from codefacts.sources import load_tree, materialize_tree, write_error_text, write_failed_vectors, write_results_csv
from codefacts.streaming import run_summary, stream_build_messages, stream_run_summary
from codefacts.streaming.jobs import count_messages


def _one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "status", "normal"),
    [("a/b", "ok", "a/b"), ("a//b/./c/", "ok", "a/b/c"), ("a/../b", "ok", "b"), ("../a", "outside", None), ("/a", "absolute", None), (".", "directory", None), ("a/..", "directory", None), ("a/.", "ok", "a"), ("", "directory", None)],
)
def test_paths(spark, path, status, normal):
    assert _one(spark, fn.path_status, path) == status
    assert _one(spark, fn.normalize_path, path) == normal


@pytest.mark.parametrize(("value", "text"), [(3.125, "3.12"), (2.675, "2.67"), (0.0, "0.00"), (100.0, "100.00"), (66.66666666666667, "66.67")])
def test_two_decimals_round_half_even(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(fn.pct2(F.col("v"))).first()[0] == text


def test_names_and_fences(spark):
    assert _one(spark, fn.sanitize_name, "1a b/c") == "_1a_b_c"
    assert _one(spark, fn.strip_fences, "```json\n{}\n```") == "{}"
    assert _one(spark, fn.strip_fences, "```rust\nfn x() {}") == "```rust\nfn x() {}"
    assert _one(spark, fn.strip_fences, "  ") is None
    assert _one(spark, fn.unquote, '"a\\"b"') == 'a"b'
    assert _one(spark, lambda c: fn.line_hint(c, "name"), 'x "no"\n  name = "yes"\nname = "later"') == "yes"


def _features(spark, names):
    return spark.createDataFrame([("p", n) for n in names], "project_id string, name string")


def test_combinations(spark):
    groups = matrix.group_features(_features(spark, ["BACKEND_alpha", "BACKEND_beta", "WORD_SIZE_32", "WORD_SIZE_64"]))
    labels = [r["label"] for r in matrix.enumerate_combos(groups, "all").orderBy("combo_index").collect()]
    assert labels == ["BACKEND_alpha,WORD_SIZE_32", "BACKEND_alpha,WORD_SIZE_64", "BACKEND_beta,WORD_SIZE_32", "BACKEND_beta,WORD_SIZE_64"]
    assert matrix.enumerate_combos(groups, 2).count() == 2
    assert [r["label"] for r in matrix.enumerate_combos(groups, "default").collect()] == ["default"]
    flag = matrix.group_features(_features(spark, ["ENABLE_EXTRA"]))
    assert [r["label"] for r in matrix.enumerate_combos(flag, "all").orderBy("combo_index").collect()] == ["ENABLE_EXTRA", "none"]
    for bad in (0, "x", "-1"):
        with pytest.raises(ValueError):
            matrix.enumerate_combos(groups, bad)
    many = matrix.group_features(_features(spark, [f"F{k}" for k in range(70)]))
    with pytest.raises(Exception, match="too many"):
        matrix.enumerate_combos(many, "all").collect()
    assert matrix.enumerate_combos(many, 5).count() == 5  # 2**70 combinations are never built


@pytest.mark.parametrize(("rows", "n", "kept"), [(100, 7, 7), (100, 10, 10), (10, 20, 10)])
def test_even_sample(spark, rows, n, kept):
    df = spark.range(rows).withColumn("g", F.lit(1))
    found = [r["id"] for r in matrix.sample_evenly(df, n, ["g"], ["id"]).orderBy("id").collect()]
    assert len(found) == kept and found == [i * rows // n for i in range(n)][:kept] or rows < n and found == list(range(rows))


def test_spans_of_the_survey(spark):
    items = spark.createDataFrame([("p", "f", 0, 10), ("p", "f", 12, 20), ("p", "f", 20, 35)], "project_id string, file string, start_off long, end_off long")
    asked = spark.createDataFrame([("p", "f", 1, 3, 9), ("p", "f", 2, 3, 10), ("p", "f", 3, 11, 12), ("p", "f", 4, 20, 22), ("p", "f", 5, 12, 25), ("p", "g", 6, 0, 1)], "project_id string, file string, seq long, byte_start long, byte_end long")
    got = {r["seq"]: (r["item_start"], r["status"]) for r in spans.attribute_spans(asked, items).collect()}
    assert got == {1: (0, "item"), 2: (None, "whole_file"), 3: (None, "whole_file"), 4: (20, "item"), 5: (None, "whole_file"), 6: (None, "missing_file")}


def test_patches(spark):
    files = spark.createDataFrame([("p", "f", "héllo wörld".encode()), ("p", "g", b"keep")], "project_id string, file string, content binary")
    schema = "project_id string, file string, start_off long, end_off long, seq long, replacement string"
    none = spans.apply_patches(files, spark.createDataFrame([], schema))
    assert {bytes(r["content"]) for r in none.collect()} == {"héllo wörld".encode(), b"keep"}
    edits = spark.createDataFrame([("p", "f", 0, 6, 1, "old"), ("p", "f", 0, 6, 2, "HI"), ("p", "f", 7, 8, 3, ""), ("p", "f", 8, 13, 4, "ö")], schema)
    assert bytes(spans.apply_patches(files, edits).where("file = 'f'").first()["content"]).decode() == "HI wö"
    whole = spark.createDataFrame([("p", "g", None, None, 1, "new")], schema)
    assert bytes(spans.apply_patches(files, whole).where("file = 'g'").first()["content"]) == b"new"


def test_sweep_counts(spark):
    params = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b"), ("g", 0, "c")], "fn string, pos long, ty string")
    values = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("b", 0, "1"), ("b", 1, "2"), ("b", 2, "3")], "ty string, ord long, val string")
    rows = [r["args"] for r in matrix.ovat_sweep(params, values).orderBy("vector_no").collect()]
    assert rows == [["x", "1"], ["y", "1"], ["x", "2"], ["x", "3"]]


def test_nan_is_not_equal(spark):
    left = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, 1.0)], "k long, value double")
    right = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k long, value double")
    got = {r["k"]: r["verdict"] for r in results.diff_compare(left, right, ["k"], "scalar").collect()}
    assert got == {1: "FAIL", 2: "PASS", 3: "WARN"}
    assert {r["verdict"] for r in results.diff_compare(left, right, ["k"], "pointer").collect()} == {"WARN"}


def test_invalid_pattern_fails_its_vector_only(spark):
    v = spark.createDataFrame([("p", "a", "(", True, None), ("p", "b", "h.$", True, None), ("p", "c", "hi", False, None), ("p", "d", "x", False, "ub"), ("p", "e", "x", False, None)], "project_id string, filename string, pattern string, is_regex boolean, has_ub string")
    o = spark.createDataFrame([("p", "a", "("), ("p", "b", "oh hi"), ("p", "c", " hi\n")], "project_id string, filename string, actual string")
    got = {r["filename"]: (r["passed"], r["skipped"]) for r in results.judge_output(v, o).collect()}
    assert got == {"a": (False, False), "b": (True, False), "c": (True, False), "d": (True, True), "e": (False, False)}


SCRIPT = '''# comment (
project(demo C)
add_compile_definitions(APP_MODE_STR="${APP_MODE}") # quoted
set(X_SOURCES a.c
    b.c)
if(ENABLE_EXTRA)
  add_library(extra STATIC src/extra.c)
  add_compile_definitions(ENABLE_EXTRA)
else()
  add_library(other STATIC src/other.c)
endif()
add_executable(skeleton main.c ${X_SOURCES})
add_compile_definitions(BUILD_PROFILE=${BACKEND}_${WORD_SIZE} -DWORD_SIZE=${WORD_SIZE})
'''


def test_build_script(spark):
    scripts = spark.createDataFrame([("p", "CMakeLists.txt", SCRIPT)], "project_id string, file string, text string")
    variables = spark.createDataFrame([("p", n) for n in ("APP_MODE", "BACKEND", "WORD_SIZE", "ENABLE_EXTRA")], "project_id string, name string")
    statements = buildfacts.extract_statements(scripts)
    assert [r["command"] for r in statements.orderBy("seq").collect()][:4] == ["project", "add_compile_definitions", "set", "if"]
    defines = {r["define"]: r["kind"] for r in buildfacts.extract_defines(statements, variables).collect()}
    # A name alone is a flag in add_definitions and target_compile_definitions only.
    assert defines == {"APP_MODE_STR": "quoted", "BUILD_PROFILE": "composed", "WORD_SIZE": "bare"}
    gates = {r["args"][0]: (r["gate_var"], r["branch"]) for r in buildfacts.scope_gates(statements, variables).where("command = 'add_library'").collect()}
    assert gates == {"extra": ("ENABLE_EXTRA", "if"), "other": ("ENABLE_EXTRA", "else")}
    targets = {(r["target"], r["path"]) for r in buildfacts.declare_targets(statements).where("kind = 'exe'").collect()}
    assert targets == {("skeleton", "main.c"), ("skeleton", "a.c"), ("skeleton", "b.c")}


def test_tree_round_trip(spark, tmp_path):
    content = {("p", "src/ä b.c"): b"int x;", ("p", "README"): b"", ("q", "deep/er/f.h"): bytes(range(256))}
    files = spark.createDataFrame([(p, f, c) for (p, f), c in content.items()], "project_id string, path string, content binary")
    materialize_tree(files, str(tmp_path / "out"))
    back = load_tree(spark, str(tmp_path / "out"))
    assert {(r["project_id"], r["path"]): bytes(r["content"]) for r in back.collect()} == content
    counts = {r["project_id"]: (r["n_dirs"], r["n_files"]) for r in facts.tree_counts(back).collect()}
    assert counts == {"p": (1, 2), "q": (2, 1)}
    with pytest.raises(ValueError, match="unsafe"):
        materialize_tree(spark.createDataFrame([("p", "../x", b"")], files.schema), str(tmp_path / "bad"))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "a,b")], "program_name string, feature_combo string")
    write_results_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["feature_combo"] == "a,b"
    vectors = spark.createDataFrame([("p", "a", "x"), ("p", "b", None)], "project_id string, filename string, stdin string")
    outcome = spark.createDataFrame([("p", "a", True, False), ("p", "b", False, False)], "project_id string, filename string, passed boolean, skipped boolean")
    write_failed_vectors(vectors, outcome, str(tmp_path / "failed"))
    (file,) = (tmp_path / "failed" / "project_id=p").glob("*.json")
    assert json.loads(file.read_text()) == {"filename": "b"}
    write_error_text(spark.createDataFrame([("p", "boom"), ("q", None)], "project_id string, line string"), str(tmp_path / "err"))
    assert [p.name for p in (tmp_path / "err").glob("project_id=*")] == ["project_id=p"]


def test_message_stream_equals_batch(spark, tmp_path):
    rows = [("p", k, line) for k, line in enumerate(['{"reason":"build-finished","success":true}', "junk", '{"reason":"compiler-message","message":{"level":"error","message":"m"}}'] * 5)]
    lines = spark.createDataFrame(rows, "project_id string, seq long, line string")
    lines.repartition(3).write.json(str(tmp_path / "in"))
    job = stream_build_messages(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("messages").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert sorted(map(tuple, spark.table("messages").collect())) == sorted(map(tuple, count_messages(lines).collect()))


def test_run_stream_equals_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").selectExpr("cast(ts as timestamp) as ts", "event_type as tool", "if(event_id % 2 = 0, 'started', 'finished') as phase")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    job = stream_run_summary(stream).writeStream.outputMode("append").format("memory").queryName("runs").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    emitted = set(map(tuple, spark.table("runs").collect()))
    batch = set(map(tuple, run_summary(events).collect()))
    # A window comes out once the watermark has passed its end; those of the last two minutes are still open.
    closed = events.agg({"ts": "max"}).first()[0] - timedelta(minutes=2)
    assert emitted == {w for w in batch if w[0] + timedelta(seconds=30) <= closed}


def test_vectors_are_strict(spark):
    cases = {"ok.json": "{}", "s.json": '{"stdout":{"pattern":"hi"}}', "bad1.json": '{"stdout":{}}', "bad2.json": '{"argv":[1]}', "bad3.json": '{"rc":-1}', "bad4.json": "no", "x.json.bak": "{}"}
    files = spark.createDataFrame([("p", f"test_vectors/{k}", v) for k, v in cases.items()], "project_id string, path string, content string")
    assert {r["filename"]: r["pattern"] for r in facts.read_vectors(files).collect()} == {"ok.json": "", "s.json": "hi"}


def test_queries_take_whole_texts(spark, data):
    from codefacts.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    found = {r["doc_id"]: r["text"] for r in QUERIES["i7_lossy_utf8"](spark, data).collect()}
    assert found == {k: (t[:50].encode() + b"\xff" + t[50:].encode() + b"\xe2\x82!").decode(errors="replace") for k, t in texts.items()}
    names = {r["doc_id"]: r["name"] for r in QUERIES["i2_sanitize_name"](spark, data).collect()}
    assert all(len(names[k]) >= len(t) for k, t in texts.items())


def test_variables_are_classified_from_rows(spark, data, monkeypatch):
    from codefacts.queries import QUERIES

    monkeypatch.setattr(matrix, "classify_variables", lambda config: config)
    found = QUERIES["d13_classify_variables"](spark, data)
    assert found.count() == spark.read.parquet(f"{data}/events.parquet").count()
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_interface_digest_takes_every_document(spark, data):
    from codefacts.queries import QUERIES

    expected = {}
    for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source", "text").collect():
        lines = [(k, x) for k, x in enumerate(r["text"].encode().split(b"\n")) if x]
        parts = [x[:2] + b"{ ... }" + x[-2:] if len(x) > 12 and k % 2 == 0 else x for k, x in lines]
        if parts:
            expected[r["source"], f"d{r['doc_id']}"] = b"\n\n".join(parts).decode(errors="replace")
    assert any(not x.isascii() for x in expected.values())
    found = QUERIES["d17_interface_digest_whole"](spark, data).collect()
    assert len(found) == len(expected) and {(r["project_id"], r["file"]): r["digest"] for r in found} == expected


def test_load_tree_lists_no_files_on_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "inputFiles", lambda self: pytest.fail("names of all files go to the driver"))
    files = {"top": b"x", "p/a b/%2B+é.txt": "é".encode(), "p/empty": b"", "q/r/s/empty": b"", "q/r/s/t": b"\x00\xff"}
    for path, content in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    found = {"/".join(filter(None, (r["project_id"], r["path"]))): (bytes(r["content"]), r["size"]) for r in load_tree(spark, str(tmp_path)).collect()}
    assert found == {k: (v, len(v)) for k, v in files.items()}
    (tmp_path / "none").mkdir()
    assert load_tree(spark, str(tmp_path / "none")).count() == 0
    assert load_tree(spark, f"file://{tmp_path}/p").count() == 2
    (tmp_path / "q/link").symlink_to(tmp_path / "p")  # a folder's link would go round
    assert load_tree(spark, str(tmp_path)).count() == len(files)


def test_load_tree_of_a_store(spark, tmp_path, monkeypatch):
    """A store that isn't the shared file system: opened, listed and read in tasks, names never collected."""
    from pyspark.sql import DataFrame

    files = {f"p{k % 3}/a/{k}/b/f{k}": bytes([k]) * k for k in range(30)} | {"p0/empty": b"", "top": b"t"}
    for path, content in files.items():
        (tmp_path / "bucket" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "bucket" / path).write_bytes(content)
    base = str(tmp_path)

    def store():
        from pyarrow import fs

        return fs.SubTreeFileSystem(base, fs.LocalFileSystem())

    monkeypatch.setattr(DataFrame, "inputFiles", lambda self: pytest.fail("names of all files go to the driver"))
    loaded = load_tree(spark, "/bucket/", store)
    monkeypatch.setattr(DataFrame, "toPandas", None)
    found = {"/".join(filter(None, (r["project_id"], r["path"]))): bytes(r["content"]) for r in loaded.collect()}
    assert found == files


def _statements(spark, text, file="CMakeLists.txt"):
    found = buildfacts.extract_statements(spark.createDataFrame([("p", file, text)], "project_id string, file string, text string"))
    return [(r["command"], r["args"], r["truncated"]) for r in found.orderBy("seq").collect()]


def test_calls_of_any_length_and_depth(spark):
    files = [f"src/file_{k}.c" for k in range(10_000)]
    got = _statements(spark, "set(A_SOURCES " + " ".join(files) + ")\nset(B \"" + "x y " * 50_000 + "\")")
    assert got[0] == ("set", ["A_SOURCES", *files], False) and len(got[1][1][1]) == 200_002
    got = _statements(spark, "if(" + "(" * 500 + "A" + ")" * 500 + ")\nendif()")
    assert got == [("if", ["(" * 500 + "A" + ")" * 500], False), ("endif", [], False)]


def test_odd_calls(spark):
    assert _statements(spark, "Set(A 1)\nset(B 2") == [("set", ["A", "1"], False), ("set", ["B", "2"], True)]
    assert _statements(spark, 'set(A "un # closed)') == [("set", ["A", '"un # closed)'], True)]
    assert _statements(spark, 'set(A "a \\" (b"c) # x)\n)) foo bar (z)') == [("set", ["A", '"a \\" (b"', "c"], False), ("bar", ["z"], False)]
    assert _statements(spark, "# only (\n") == _statements(spark, "") == []
    assert _statements(spark, "project ( demo\n C )") == [("project", ["demo", "C"], False)]


def test_gates_at_any_depth(spark):
    text = "if(${A})\n" + "if(X)\n" * 30 + "in(1)\nelse()\nin(2)\n" + "endif()\n" * 30 + 'elseif("B" STREQUAL "v")\nin(3)\nelse()\nin(4)\nendif()\nin(5)\nendif()\nelse()\nif(C)\nin(6)\nif(A)\nelseif(X)\nin(7)'
    statements = buildfacts.extract_statements(spark.createDataFrame([("p", "f", text)], "project_id string, file string, text string"))
    variables = spark.createDataFrame([("p", "A"), ("p", "B"), ("p", "C")], "project_id string, name string")
    got = [(r["gate_var"], r["gate_value"], r["branch"]) for r in buildfacts.scope_gates(statements, variables).where("command = 'in'").orderBy("seq").collect()]
    assert got == [("A", None, "if"), ("A", None, "if"), ("B", "v", "if"), ("B", "v", "else"), (None, None, None), ("C", None, "if"), ("C", None, "if")]


def test_patterns_are_those_of_the_engine_that_matches(spark):
    patterns = (r"\p{L}+", "(?P<n>a)", "(?<n>a)", "[", "a{2,1}", "(?=a)", r"(a)\1", r"^\w$", r"[\w.]", r"\W|\D", "")
    v = spark.createDataFrame([("p", p, p, True, None) for p in patterns], "project_id string, filename string, pattern string, is_regex boolean, has_ub string")
    o = v.selectExpr("project_id", "filename", "'é' as actual")
    assert {r["filename"] for r in results.judge_output(v, o).where("passed").collect()} == {r"\p{L}+", r"^\w$", r"[\w.]", r"\W|\D", ""}
    o = v.selectExpr("project_id", "filename", "'aa' as actual")
    assert {r["filename"] for r in results.judge_output(v, o).where("passed").collect()} == {r"\p{L}+", "(?P<n>a)", "(?<n>a)", r"[\w.]", r"\W|\D", ""}
    names = spark.createDataFrame([("a",), ("b",), (None,)], "name string")
    assert [r[0] for r in results.name_filter(names, "name", "(?<x>a)")[0].collect()] == ["a"]
    with pytest.raises(ValueError):
        results.name_filter(names, "name", "(?P<x>a)")


def test_no_pattern_or_output_ends_the_job(spark):
    """Alternation under a star on a long output; a quantifier that would backtrack for ever."""
    v = [("p", "a", "(a|b)*c", True, None), ("p", "b", "(x+x+)+y", True, None), ("p", "c", "(a|b)*c", True, None), ("p", "d", "((a{0,100}){0,100}){0,100}", True, None), ("p", "e", "(a|b)*c", True, None)]
    v = spark.createDataFrame(v, "project_id string, filename string, pattern string, is_regex boolean, has_ub string")
    o = spark.createDataFrame([("p", "a", "ab" * 500_000), ("p", "b", "x" * 100_000), ("p", "c", "ab" * 500_000 + "c"), ("p", "d", "a"), ("p", "e", None)], "project_id string, filename string, actual string")
    got = {r["filename"]: r["passed"] for r in results.judge_output(v, o).collect()}
    assert got == {"a": False, "b": False, "c": True, "d": False, "e": False}


def test_every_body_of_an_item_is_stubbed(spark):
    text = "impl A { fn a() { 1 } fn b() { { 2 } } } fn c() {}"
    files = spark.createDataFrame([("p", "f", text.encode())], "project_id string, file string, content binary")
    item = text.index(" fn c")
    items = spark.createDataFrame([("p", "f", 0, item), ("p", "f", item + 1, len(text))], "project_id string, file string, start_off long, end_off long")
    two = text.index("{ { 2 } }")
    spans_ = [(text.index("{ 1 }"), 5), (two, 9), (two + 2, 5)]
    bodies = spark.createDataFrame([("p", "f", a, a + n) for a, n in spans_], "project_id string, file string, start_off long, end_off long")
    assert [r["digest"] for r in spans.interface_digest(files, items, bodies, "{ todo!() }").collect()] == ["impl A { fn a() { todo!() } fn b() { todo!() } }\n\nfn c() {}"]


def test_values_of_pointers_and_texts(spark):
    types = ["int", " unsigned ", "char *", "const char*", "void*", "int *", "const float *", "int **", "char **", "struct s", "blob *", "uint_fast64_t", "unsigned char"]
    found = {}
    for r in matrix.boundary_values(spark.createDataFrame([(t,) for t in types], "ty string")).orderBy("ord").collect():
        found.setdefault(r["ty"], []).append(r["val"])
    texts = ["NULL", '""', '"hello"']
    assert found == {
        "int": ["0", "1", "-1", "INT_MAX", "INT_MIN"], " unsigned ": ["0", "1", "UINT_MAX"], "char *": texts, "const char*": texts, "void*": ["NULL"], "int *": ["&(int){0}", "NULL"],
        "const float *": ["&(float){0.0f}", "NULL"], "int **": ["&(int *){&(int){0}}", "NULL"], "char **": ["&(char *){NULL}", "NULL"], "blob *": ["NULL"],
        "uint_fast64_t": ["0", "1", "UINT64_MAX"], "unsigned char": ["0", "'a'", "UCHAR_MAX"],
    }


def test_flags_of_the_chosen_subdirectory(spark):
    config = spark.createDataFrame([("p", "BACKEND", "sha"), ("p", "SIZE", "8"), ("p", "OFF", None)], "project_id string, name string, default string")
    defines = spark.createDataFrame([("p", "SIZE", 1, "WORD", "quoted")], "project_id string, var string, seq long, define string, kind string")
    rows = [("p", "BACKEND", "sha", 2, "PARAMS", "quoted", "SIZE"), ("p", "BACKEND", "sha", 3, "FLAG", "gated", "SIZE"), ("p", "BACKEND", "sha", 4, "BOTH", "composed", "SIZE"), ("p", "BACKEND", "sha", 5, "NONE", "bare", "OFF"), ("p", "BACKEND", "aes", 6, "OTHER", "bare", "SIZE")]
    subdirs = spark.createDataFrame(rows, "project_id string, driving_var string, value string, seq long, define string, kind string, var string")
    assert matrix.flags_from_defaults(config, defines, subdirs).first()["flags"] == '-DBACKEND=sha -DWORD="8" -DPARAMS="8" -DFLAG=8'


def test_a_valid_layout_is_one_program(spark):
    files = spark.createDataFrame([("p", "test_case/src/a.c"), ("p", "test_vectors/1.json"), ("q", "x/test_case/src/a.c"), ("q", "README")], "project_id string, path string")
    assert {tuple(r) for r in facts.discover_programs(files).collect()} == {("p", ""), ("q", "x")}


def test_hint_keys_stand_for_themselves(spark):
    from codefacts.functions import line_hint

    text = 'ab = "no"\na.b = "yes"'
    assert _one(spark, lambda c: line_hint(c, "a.b"), text) == "yes" and _one(spark, lambda c: line_hint(c, "a+"), text) is None
