"""Build files that read one another, against a plain recursive walk."""

import random

import pytest
from pyspark.sql import functions as F

from codefacts.operators import buildfacts, matrix

from .walk import BUILD_FILE, Project

VARIABLES = {"A": ["alpha", "beta", "sub"], "B": ["1", "2"], "C": ["true"], "E": ["."]}
FOLDERS = ["", "sub", "lib", "lib/sub", "lib/deep", "lib/deep/sub", "alpha", "beta", "lib/alpha", "alpha/beta", "lib/deep/1", "1"]
STATEMENTS = [
    'add_subdirectory(sub)', 'add_subdirectory(lib)', 'add_subdirectory(deep)', 'add_subdirectory(../lib)', 'add_subdirectory("alpha")', 'add_subdirectory(..)', 'add_subdirectory(/abs)', 'add_subdirectory(../../..)',
    'add_subdirectory(${A})', 'add_subdirectory("${B}")', 'add_subdirectory(${E})', 'add_subdirectory(${NO})', 'add_subdirectory(deep/../sub)',
    'set(X_SOURCES a.c main_${A}.c)', 'set(X_SOURCES ../z.c "b.c")', 'set(Y_SOURCES impl/${B}/x.c main_${A}.c)', 'set(Y_SOURCES)', 'set(X_SOURCES k_${NO}.c)',
    'set(P "${A}_${B}")', 'set(P "${B}-${A}-${NO}")', 'set(A "${B}.${B}")', 'set(A "${B}")', 'set(Q plain)', 'set(A "x" CACHE STRING "d")', 'set(B "" CACHE STRING "d")', 'option(C "d" ON)', 'option(C "d")', 'option(C d NO)',
    'add_executable(t ${X_SOURCES} a.c)', 'add_library(u STATIC ${Y_SOURCES} b.c)', 'add_library(v main_${A}.c a.c)', 'add_executable(w)', 'add_library(x OBJECT)', 'add_executable(y ${X_SOURCES} ${Y_SOURCES})',
    'add_compile_definitions(-DN=${A} M="${B}" K=${A}_${B} FLAG Z=${NO} "W=\\"${A}\\"" V=${B}${B})', 'add_definitions(-DTAG -DN=${A} G=${A}_${B})', 'target_compile_definitions(t PRIVATE TAG -DN X=1)',
    'set(CMAKE_C_FLAGS "${CMAKE_C_FLAGS} -DR=${P} -DS=${A} -DT=${A}${B} DU=${A} -DV")', 'set(CMAKE_CXX_FLAGS -DR=${P} -DS=${B})', 'if(A)', 'if(${B} STREQUAL "1")', 'if(NO)', 'elseif(C)', 'else()', 'endif()', 'endif()',
]
FILES = ["a.c", "b.c", "z.c", "main_alpha.c", "main_beta.c", "lib/a.c", "lib/main_alpha.c", "lib/main_.c", "lib/impl/1/x.c", "impl/2/x.c", "lib/deep/b.c", "sub/a.c", "sub/main_sub.c", "impl/1/y/x.c"]


@pytest.fixture(scope="module")
def projects(spark):
    rng, scripts, variables, files = random.Random(11), [], [], []
    for k in range(30):
        p = f"p{k}"
        for folder in FOLDERS if k % 5 else FOLDERS[1:]:  # some have no build file at the root
            if folder == "" or rng.random() < 0.7:
                lines = rng.choices(STATEMENTS[:13], k=rng.randint(0, 4)) + rng.choices(STATEMENTS, k=rng.randint(0, 30))
                rng.shuffle(lines)
                scripts.append((p, f"{folder}/{BUILD_FILE}".lstrip("/"), "\n".join(lines)))
        variables += [(p, n, v) for n, v in VARIABLES.items() if rng.random() < 0.9]
        files += [(p, f) for f in FILES if rng.random() < 0.7]
    files += [(p, f) for p, f, _ in scripts]
    scripts = spark.createDataFrame(scripts, "project_id string, file string, text string")
    statements = buildfacts.extract_statements(scripts).drop("truncated").cache()
    variables = spark.createDataFrame(variables, "project_id string, name string, values array<string>").cache()
    files = spark.createDataFrame(files, "project_id string, path string").cache()
    plain: dict = {}
    for r in statements.orderBy("seq").collect():
        plain.setdefault(r["project_id"], ({}, {}, []))[0].setdefault(r["file"], []).append((r["command"], r["args"]))
    for r in variables.collect():
        if r["project_id"] in plain:
            plain[r["project_id"]][1][r["name"]] = r["values"]
    for r in files.collect():
        if r["project_id"] in plain:
            plain[r["project_id"]][2].append(r["path"])
    read, tree = buildfacts.read_build_files(statements, variables, files)
    return read, variables, files, tree, {p: Project(*x) for p, x in plain.items()}


def _tags(df, tree):
    """Rows with the choices that lead to their context in place of its name."""
    tags = tree.select("project_id", "ctx", F.col("tags").alias("_tags")).distinct()
    return df.join(tags, ["project_id", "ctx"])


def _rows(df, *columns):
    return sorted(((r["project_id"], tuple(tuple(t) for t in r["_tags"]), *(r[c] for c in columns)) for r in df.collect()), key=str)


def _want(walks, of):
    return sorted(((p, *row) for p, w in walks.items() for row in of(w)), key=str)


def test_folders_are_read_in_order(projects):
    _, _, _, tree, walks = projects
    edges = _rows(_tags(buildfacts.subdirectory_edges(tree), tree), "parent", "child", "var", "value")
    want = _want(walks, lambda w: [(tags, a, b, *(choice or (None, None))) for tags, a, b, choice in w.edges])
    assert edges == want and len(want) > 100
    assert tree.where(F.size("tags") > 1).count() > 5


def test_lists_defines_and_targets_cross_files(projects):
    read, variables, files, tree, walks = projects
    defines = _rows(_tags(buildfacts.extract_defines(read, variables), tree), "define", "kind", "var", "template", "gate_var", "gate_value", "source_vars")
    assert defines == _want(walks, lambda w: [(t, d, k, v, x, *(g or (None, None)), s) for t, d, k, v, x, g, s in w.defines])
    assert {d[3] for d in defines} == {"bare", "quoted", "composed", "gated"}
    targets = _rows(_tags(buildfacts.declare_targets(read, variables), tree), "target", "kind", "path")
    assert targets == _want(walks, lambda w: w.targets)
    selections = _rows(_tags(buildfacts.select_sources_by_variable(read, variables, files), tree), "target", "var", "value", "path")
    assert selections == _want(walks, lambda w: w.selections) and len(selections) > 20
    conditional = _rows(_tags(buildfacts.conditional_targets(read, variables, files), tree), "target", "kind", "gate_var", "gate_value", "files")
    assert conditional == _want(walks, lambda w: w.conditional) and len(conditional) > 10


def test_defaults_of_the_project_only(projects):
    read, variables, _, _, walks = projects
    got = sorted(tuple(r) for r in buildfacts.variable_defaults(read, variables).select("project_id", "name", "default").fillna("-").collect())
    assert got == sorted((p, n, v or "-") for p, w in walks.items() for n, v in w.defaults.items())


def _project(spark, scripts, files=(), variables=VARIABLES):
    statements = buildfacts.extract_statements(spark.createDataFrame([("p", f, t) for f, t in scripts.items()], "project_id string, file string, text string"))
    variables = spark.createDataFrame([("p", n, v) for n, v in variables.items()], "project_id string, name string, values array<string>")
    files = spark.createDataFrame([("p", f) for f in (*scripts, *files)], "project_id string, path string")
    read, tree = buildfacts.read_build_files(statements, variables, files)
    return read, variables, files, tree


def test_nested_folders_cycles_and_reachability(spark):
    scripts = {
        BUILD_FILE: "add_subdirectory(sub)\nadd_subdirectory(other)", f"sub/{BUILD_FILE}": "add_subdirectory(deep)\nadd_subdirectory(../other)", f"sub/deep/{BUILD_FILE}": "add_subdirectory(..)",
        f"other/{BUILD_FILE}": "add_subdirectory(../sub)", f"lost/{BUILD_FILE}": "add_subdirectory(deep)", f"lost/deep/{BUILD_FILE}": "",
    }
    *_, tree = _project(spark, scripts)
    assert {(r["parent"], r["child"]) for r in buildfacts.subdirectory_edges(tree).collect()} == {("", "sub"), ("sub", "sub/deep"), ("sub", "other")}


def test_variants_keep_their_own_lists(spark):
    scripts = {
        BUILD_FILE: "set(S_SOURCES a.c)\nadd_subdirectory(${A})\nadd_executable(late ${S_SOURCES})", f"alpha/{BUILD_FILE}": "add_library(early ${S_SOURCES})\nset(S_SOURCES x.c)\nadd_library(one ${S_SOURCES})\nadd_compile_definitions(D=${B})",
        f"beta/{BUILD_FILE}": "add_library(two ${S_SOURCES})",
    }
    read, variables, files, _ = _project(spark, scripts)
    targets = {(r["target"], r["path"]) for r in buildfacts.declare_targets(read, variables).collect()}
    assert targets == {("early", "a.c"), ("one", "alpha/x.c"), ("two", "a.c"), ("late", "a.c")}
    defines = buildfacts.variant_defines(buildfacts.extract_defines(read, variables))
    assert [tuple(r) for r in defines.collect()] == [("p", "A", "alpha", 1, "D", "bare", "B")]
    config = spark.createDataFrame([("p", "A", "alpha"), ("p", "B", "2")], "project_id string, name string, default string")
    none = spark.createDataFrame([], "project_id string, var string, seq long, define string, kind string")
    assert matrix.flags_from_defaults(config, none, defines).first()["flags"] == "-DA=alpha -DB=2 -DD=2"


def test_a_list_with_a_variable_selects_sources(spark):
    """And what a variable selects is no conditional target."""
    scripts = {BUILD_FILE: "set(A_SOURCES src/main_${A}.c src/z.c)\nif(C)\nadd_executable(t ${A_SOURCES})\nadd_library(l src/main_${A}.c src/z.c)\nendif()"}
    read, variables, files, _ = _project(spark, scripts, ["src/main_alpha.c", "src/main_beta.c", "src/z.c"])
    assert {(r["target"], r["value"]) for r in buildfacts.select_sources_by_variable(read, variables, files).collect()} == {("t", "alpha"), ("t", "beta")}
    assert [(r["target"], r["files"]) for r in buildfacts.conditional_targets(read, variables, files).collect()] == [("l", "src/z.c")]


def test_a_composed_value_counts_from_where_it_is_set(spark):
    scripts = {BUILD_FILE: 'set(CMAKE_C_FLAGS "-DX=${P}")\nset(P "${A}_${B}")\nset(CMAKE_C_FLAGS "-DY=${P}")\nadd_compile_definitions(Z=${A})\nset(A "${B}/${C}")'}
    read, variables, *_ = _project(spark, scripts)
    assert {(r["define"], r["kind"], r["template"]) for r in buildfacts.extract_defines(read, variables).collect()} == {("Y", "composed", "{A}_{B}"), ("Z", "composed", "{B}/{C}")}
