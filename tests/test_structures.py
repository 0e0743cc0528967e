"""Overlapping items, deep forests, wide products, structures, scripts and what is still running, against plain versions."""

import random
import re

import pytest

from codefacts.operators import buildfacts, facts, matrix, spans
from codefacts.streaming import still_running, stream_still_running


def test_nesting_and_crossing_items(spark):
    rng, items, asked = random.Random(4), [], []
    for f in range(12):
        size = rng.choice([0, 1, 7, 64, 1000, 5000])
        spread = [(a, min(size, a + rng.choice([0, 1, 3, size // 3, size]))) for a in (rng.randint(0, max(0, size - 1)) for _ in range(rng.choice([1, 5, 60])))] if size else []
        items += [("p", f"f{f}", k, a, b) for k, (a, b) in enumerate(spread)]
        asked += [("p", f"f{f}", k, a, a + rng.choice([-2, 0, 1, 5, size // 2])) for k, a in enumerate(rng.randint(-1, size + 1) for _ in range(80))]
    items += [("p", "apart", k, 10 * k, 10 * k + 8) for k in range(20)]
    asked += [("p", "apart", k, k, k + 3) for k in range(200)]
    got = {(r["file"], r["seq"]): (r["item_start"], r["item_end"], r["status"]) for r in spans.attribute_spans(
        spark.createDataFrame(asked, "project_id string, file string, seq long, byte_start long, byte_end long"), spark.createDataFrame(items, "project_id string, file string, item_seq long, start_off long, end_off long")
    ).collect()}
    files = {i[1] for i in items}
    for _, f, k, a, b in asked:
        hit = next(((s, e) for _, g, _, s, e in items if g == f and s <= a < e and s <= b < e), None)
        assert got[f, k] == (*(hit or (None, None)), "item" if hit else "whole_file" if f in files else "missing_file")


def test_overlapping_patches_are_refused(spark):
    files = spark.createDataFrame([("p", f, b"0123456789") for f in "abcd"], "project_id string, file string, content binary")
    edits = [("p", "a", 0, 4, 1, "x"), ("p", "a", 3, 5, 2, "y"), ("p", "b", 0, 4, 1, "x"), ("p", "b", 4, 5, 2, "y"), ("p", "c", 8, 12, 1, "x")]
    out = spans.apply_patches(files, spark.createDataFrame(edits, "project_id string, file string, start_off long, end_off long, seq long, replacement string"))
    assert {r["file"]: (bytes(r["content"]).decode(), r["refused"]) for r in out.collect()} == {"a": ("0123456789", True), "b": ("xy56789", False), "c": ("0123456789", True), "d": ("0123456789", False)}


def test_deep_forests(spark):
    rows = [("p", k, k - 1 if k else None, f"V{k}", "a") for k in range(500)] + [("p", 1000, 999, "V", "x"), ("q", 0, None, "R", "b"), ("q", 1, 0, "S", "c")]
    subdirs = spark.createDataFrame(rows, "project_id string, node_id long, parent_id long, var string, value string")
    files = spark.createDataFrame([("p", 499, "f"), ("p", 0, "g"), ("p", 1000, "h"), ("q", 1, "i"), ("r", 1, "j")], "project_id string, node_id long, path string")
    got = {r["path"]: r["tags"] for r in facts.stack_outer_tags(subdirs, files).collect()}
    assert got == {"f": ",".join(f"V{k}=a" for k in range(500)), "g": "V0=a", "h": "", "i": "R=b,S=c", "j": ""}
    with pytest.raises(ValueError, match="circle"):
        facts.stack_outer_tags(spark.createDataFrame([("p", 1, 2, "V", "a"), ("p", 2, 1, "V", "a")], subdirs.schema), files)


def _combos(lists, n):
    total = 1
    for x in lists:
        total *= len(x)
    for i in range(min(n, total)):
        index = rest = i * total // min(n, total)
        chosen = []
        for x in reversed(lists):
            rest, digit = divmod(rest, len(x))
            chosen.append(x[digit])
        yield (index if index < 1 << 63 else None, ",".join(sorted(c for c in chosen if c)) or "none")


@pytest.mark.parametrize("n", [1, 7, 10, 64])
def test_products_of_any_size(spark, n):
    projects = {"wide": 130, "wider": 1000, "small": 2, "edge": 66}
    names = [(p, f"F{k:04}") for p, m in projects.items() for k in range(m)] + [("enum", f"A_{k}") for k in range(5)] + [("enum", f"B_{k}") for k in range(3)] + [("enum", "C")]
    groups = matrix.group_features(spark.createDataFrame(names, "project_id string, name string")).cache()
    everyone = spark.createDataFrame([(p,) for p in (*projects, "enum", "bare")], "project_id string")
    got = sorted(((r["project_id"], r["combo_index"], r["label"]) for r in matrix.enumerate_combos(groups, n, everyone).collect()), key=str)
    want = [("bare", 0, "default")] + [("enum", *c) for c in _combos([[f"A_{k}" for k in range(5)], [f"B_{k}" for k in range(3)], ["C", ""]], n)]
    for p, m in projects.items():
        want += [(p, *c) for c in _combos([[f"F{k:04}", ""] for k in range(m)], n)]
    assert got == sorted(want, key=str)
    with pytest.raises(Exception, match="too many combinations"):
        matrix.enumerate_combos(groups, "all").collect()


SCALARS = {t: v for names, v in matrix.BOUNDARY_VALUES.items() for t in names.split("|")}


def _values(ty, structs, depth=0):
    if depth > 4:
        return []
    ty = ty.strip()
    if ty in ("char *", "const char *", "char*", "const char*"):
        return ["NULL", '""', '"hello"']

    def literal(name):
        shown, fields = structs[name]
        inits = [f".{f} = {v[0]}" for f, t in fields if (v := _values(t, structs, depth + 1))]
        return f"({shown}){{{', '.join(inits) or '0'}}}"

    if ty.endswith("*"):
        inner = re.sub("^(const)+", "", ty[:-1].strip()).strip()
        key = re.sub("^(struct)+", "", inner).strip()
        if inner == "void":
            return ["NULL"]
        if key in structs:
            return ["&" + literal(key), "NULL"]
        below = _values(inner, structs, depth + 1)
        return [f"&({inner}){{{below[0]}}}", "NULL"] if below else ["NULL"]
    key = re.sub("^(struct)+", "", ty).strip()
    return [literal(key)] if key in structs else SCALARS.get(ty, [])


def test_structures_to_four_levels(spark):
    structs = {
        "pair": ("struct pair", [("a", "int"), ("b", "double")]), "box": ("box_t", [("p", "struct pair"), ("q", "pair *"), ("n", "struct node *"), ("t", "const char *"), ("u", "blob")]),
        "node": ("struct node", [("next", "struct node*"), ("v", "unsigned long"), ("box", "box")]), "odd": ("odd", [("x", "blob")]), "none": ("struct none", [("y", "other")]),
        "d1": ("struct d1", [("d", "struct d2")]), "d2": ("struct d2", [("d", "d3"), ("z", "int **")]), "d3": ("struct d3", [("d", "struct d4 *")]), "d4": ("struct d4", [("d", "struct d5"), ("c", "char")]), "d5": ("struct d5", [("i", "int")]),
    }
    fields = spark.createDataFrame([(s, shown, k, f, t) for s, (shown, fs) in structs.items() for k, (f, t) in enumerate(fs)], "struct string, literal string, pos int, field string, ty string")
    types = ["struct pair", " pair ", "struct box *", "const box*", "struct node", "node **", "odd", "struct none *", "struct d1", "struct d1 *", "int", "int *****", "int ******", "const float *", "char **", "void *", "void **", "blob", "blob *", "const int", "d5"]
    got: dict = {}
    for r in matrix.boundary_values(spark.createDataFrame([(t,) for t in types], "ty string"), fields).orderBy("ord").collect():
        got.setdefault(r["ty"], []).append(r["val"])
    assert got == {t: v for t in types if (v := _values(t, structs))}


def _calls(text):
    """Calls of a script, character by character."""
    bare, k, quoted = [], 0, False
    while k < len(text):
        c = text[k]
        if quoted and c == "\\" and k + 1 < len(text):
            bare.append(text[k : k + 2])
            k += 2
            continue
        if c == "#" and not quoted:
            while k < len(text) and text[k] != "\n":
                k += 1
            continue
        quoted ^= c == '"'
        bare.append(c)
        k += 1
    text, k, out = "".join(bare), 0, []
    space, word = " \t\r\n\f", set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
    while k < len(text):
        if text[k] not in word:
            k += 1
            continue
        begin = k
        while k < len(text) and text[k] in word:
            k += 1
        name = text[begin:k]
        while k < len(text) and text[k] in space:
            k += 1
        if k >= len(text) or text[k] != "(":
            continue
        k += 1
        begin, deep, quoted = k, 1, False
        while k < len(text) and deep:
            c = text[k]
            if quoted and c == "\\" and k + 1 < len(text):
                k += 2
                continue
            if c == '"':
                quoted = not quoted
            elif not quoted:
                deep += (c == "(") - (c == ")")
            k += 1
        inner, args, j = text[begin : k - 1 if not deep else k], [], 0
        while j < len(inner):
            if inner[j] in space:
                j += 1
                continue
            start = j
            if inner[j] == '"':
                j += 1
                while j < len(inner):
                    if inner[j] == "\\" and j + 1 < len(inner):
                        j += 2
                        continue
                    j += 1
                    if inner[j - 1] == '"':
                        break
            else:
                while j < len(inner) and inner[j] not in space:
                    j += 1
            args.append(inner[start:j])
        out.append((name.lower(), args, bool(deep)))
    return out


def test_scripts_character_by_character(spark):
    rng = random.Random(8)
    parts = ["set(", "if (", "x", "Foo_1", "(", ")", ")", '"', '"', "\\", "#", "\n", " ", "\t", "${A}", "a.c", 'add("a b" c)', "é", "(z)", "\\\""]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(1500)] + ["a" * 200_000, "a " * 100_000, "( " * 50_000 + "b(c)", '"' * 50_001 + "f(x)", "\\" * 30_001 + 'g("\\'] + [None]
    scripts = spark.createDataFrame([("p", str(k), t) for k, t in enumerate(texts)], "project_id string, file string, text string")
    got: dict = {}
    for r in buildfacts.extract_statements(scripts).orderBy("seq").collect():
        got.setdefault(int(r["file"]), []).append((r["command"], r["args"], r["truncated"]))
    for k, t in enumerate(texts):
        assert got.get(k, []) == _calls(t or ""), t


def test_program_beside_its_files(spark):
    files = spark.createDataFrame([("p", x) for x in ("zz", "app.d", ".hid", "lib.rlib", "b.out", ".x.so")] + [("q", "only.pdb")], "project_id string, path string")
    assert [tuple(r) for r in facts.pick_artifact(files, "program").collect()] == [("p", "b.out")]
    with pytest.raises(ValueError):
        facts.pick_artifact(files, "first")


def test_still_running_stream_equals_batch(spark, tmp_path):
    """Starts and finishes that land in different batches, a finish without a start, runs that never end."""
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    at = lambda s: t0 + timedelta(seconds=s)
    batches = [
        [(1, at(0), "a", "started"), (2, at(10), "b", "started"), (3, at(31), "a", "started"), (3, at(65), "a", "finished"), (9, at(40), "z", "finished")],
        [(1, at(200), "a", "finished"), (4, at(180), "c", "started"), (5, at(210), "b", "started"), (5, at(215), "b", "finished")],
        [(2, at(700), "b", "finished"), (6, at(650), "a", "started")],
        [(7, at(1000), "c", "started")],
    ]
    schema = "run_id long, ts timestamp, tool string, phase string"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = stream_still_running(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in"))
    job = stream.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    from pyspark.sql import functions as F

    want = sorted(tuple(r) for r in still_running(every, F.lit(at(1000 - 120))).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want
    assert {r[1] for r in want} == {1, 2, 3, 4, 5, 6} and len(want) > 40  # 5 begins on a tick


def test_scratch_tables_are_removed(spark):
    from codefacts import scratch

    scratch.cleanup(spark)
    df = scratch.settled(spark.range(5), "numbers")
    (path,) = scratch._written
    assert df.count() == 5 and path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch.cleanup(spark) == 1 and scratch.cleanup(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)


@pytest.mark.parametrize(("master", "works"), [("local[2]", True), ("yarn", False), (None, False)])
def test_sessions_without_a_shared_folder(master, works):
    """A local session gets one folder for all; elsewhere it is an error.  The setting is never written."""
    from codefacts import scratch

    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return master if key == "spark.master" else default

    if works:
        assert scratch.shared_dir(Session()) == scratch.shared_dir(Session())
    else:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch.shared_dir(Session())
