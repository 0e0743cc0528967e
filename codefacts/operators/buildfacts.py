"""Facts in build scripts, over a table of their statements."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fill_known, find_var_refs, join_path, known_refs, single_var_ref, unquote
from ..scratch import settled
from .facts import expand_source_patterns
from .includes import include_tree, last_before, place_statements, placed

FILE = ["project_id", "file"]
# No group below is matched by recursion or tried again: possessive loops run in constant stack and linear time.
_STRING = r'"(?:[^"\\]++|\\.)*+(?:"|\\?\z)'
#: A string or a comment; comments go.
COMMENT = rf"(?s)({_STRING})|#[^\n]*+"
_PY_STRING = _STRING.replace(r"\z", r"\Z")
_SPACE = r"[ \t\r\n\f]"
#: A name with its parenthesis; what counts inside a call; an argument: a string where it begins with a quote, else all up to white space.
_OPENS = re.compile(rf"(?<![A-Za-z0-9_])([A-Za-z0-9_]++){_SPACE}*+\(")
_INSIDE = re.compile(rf"(?s){_PY_STRING}|[()]")
_TOKEN = re.compile(rf"(?s){_PY_STRING}|[^ \t\r\n\f]++")
_UP_TO_HERE = (Window.unboundedPreceding, 0)
#: Characters of calls that a batch holds, and for how many an argument counts beside its own.
BATCH_CHARS, _CHARS_AN_ARG = 4_000_000, 64


def _floored(rows: DataFrame, step: str, level: str, order) -> DataFrame:
    """rows with a running sum of `step` in which steps below zero don't count."""
    total = rows.withColumn("_sum", F.sum(step).over(order))
    return total.withColumn(level, F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(order))).drop("_sum")


def _calls_of(text: str) -> Iterator[tuple[str, list[str], bool, int]]:
    """Command, arguments, whether truncated, and length of each call."""
    at = 0
    while opens := _OPENS.search(text, at):
        depth, end, truncated = 1, len(text), True
        for x in _INSIDE.finditer(text, opens.end()):
            depth += {"(": 1, ")": -1}.get(x[0], 0)
            if not depth:
                end, truncated = x.start(), False
                break
        yield opens[1].lower(), _TOKEN.findall(text, opens.end(), end), truncated, end - opens.start()
        at = end + 1


def _statements_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most about BATCH_CHARS characters or as much in arguments, or one call; a file's calls may lie in many."""
    for batch in batches:
        files = batch.select(FILE)
        held, volume = [], 0

        def out(files=files, held=held):
            row, seq, command, args, truncated = zip(*held, strict=True)
            held.clear()
            columns = [pa.array(seq, pa.int64()), pa.array(command, pa.string()), pa.array(args, pa.list_(pa.string())), pa.array(truncated, pa.bool_())]
            return pa.RecordBatch.from_arrays([*files.take(pa.array(row)).columns, *columns], names=[*FILE, "seq", "command", "args", "truncated"])

        for row, text in enumerate(batch.column("text")):
            if not text.is_valid:
                continue
            for seq, (command, args, truncated, length) in enumerate(_calls_of(text.as_py())):
                held.append((row, seq, command, args, truncated))
                volume += length + _CHARS_AN_ARG * (len(args) + 2)
                if volume > BATCH_CHARS:
                    yield out()
                    volume = 0
        if held:
            yield out()


def extract_statements(scripts: DataFrame) -> DataFrame:
    """(project_id, file, seq, command, args, truncated) of scripts (project_id, file, text).

    Comments go (not inside strings), calls may span lines, argument tokens keep their quotes, and
    `seq` is the order in the file.  A call begins at a name with a parenthesis, ends at the
    parenthesis that closes it, and may be of any length and nest to any depth; one that isn't closed holds
    all up to the end of the file and is marked truncated.  What stands between calls, quotes and
    parentheses included, is passed over.  How deep a call is depends on all before it in its file, so a
    file is read from its start to its end, in Arrow batches; nothing is shuffled.  A task holds some of
    the calls at a time, however many a batch of files or a file has.
    """
    bare = scripts.select(*FILE, F.regexp_replace("text", COMMENT, "$1").alias("text"))
    kinds = dict(bare.dtypes)
    return bare.mapInArrow(_statements_of, f"project_id {kinds['project_id']}, file {kinds['file']}, seq long, command string, args array<string>, truncated boolean")


def scope_gates(statements: DataFrame, variables: DataFrame) -> DataFrame:
    """statements with gate_var, gate_value, branch: the innermost enclosing `if` over a known variable.

    `elseif` replaces the gate, `else` keeps it (branch says so); an `if` over something else doesn't
    hide an outer one.  VAR STREQUAL v gates on the value, anything else that begins with a known
    variable, bare or as ${VAR}, on its being true.  Blocks nest to any depth; an `endif`, `elseif` or
    `else` without an open `if` is passed over.

    A branch with a gate is a span of statements, and spans of a file nest.  So the innermost span
    that holds a statement is the last one that brought the number of open spans to what it is there.
    """
    known = variables.groupBy("project_id").agg(F.collect_set("name").alias("known"))  # variables of one project
    ordered = Window.partitionBy(*FILE).orderBy("seq")
    order = ordered.rowsBetween(*_UP_TO_HERE)
    is_ = lambda *c: F.col("command").isin(*c)
    first = F.regexp_replace(unquote(F.get("args", F.lit(0))), r"^\s*\$\{([A-Za-z0-9_]+)\}\s*$", "$1")
    gated = F.coalesce(F.array_contains("known", first), F.lit(False))
    value = F.when(unquote(F.get("args", F.lit(1))) == "STREQUAL", unquote(F.get("args", F.lit(2))))
    rows = statements.join(known, "project_id", "left").withColumns({
        "_step": F.when(is_("if"), 1).when(is_("endif"), -1).otherwise(0),
        "_gate": F.when(is_("if", "elseif"), F.struct(gated.alias("on"), first.alias("var"), value.alias("value"))),
    }).drop("known")
    rows = _floored(rows, "_step", "_depth", order)
    # The level of the block that a statement opens, turns or closes.
    above = F.coalesce(F.lag("_depth").over(ordered), F.lit(0))
    level = F.when(is_("if"), F.col("_depth")).when(is_("elseif", "else", "endif") & (above > 0), above)
    rows = rows.withColumn("_level", level)
    in_level = Window.partitionBy(*FILE, "_level").orderBy("seq")
    held = F.last("_gate", ignorenulls=True).over(in_level.rowsBetween(*_UP_TO_HERE))
    branch = F.col("_level").isNotNull()
    rows = rows.withColumn("_held", F.when(branch & ~is_("endif"), held))
    rows = rows.withColumn("_on", F.when(branch, F.coalesce("_held.on", F.lit(False)).cast("int")))
    before = F.when(is_("if"), 0).otherwise(F.coalesce(F.lag("_on").over(in_level), F.lit(0)))
    rows = rows.withColumn("_open", F.sum(F.when(branch, F.col("_on") - before).otherwise(0)).over(order))
    span = F.when(F.col("_on") == 1, F.struct(F.col("_held.var").alias("var"), F.col("_held.value").alias("value"), F.when(is_("else"), "else").otherwise("if").alias("branch")))
    of_count = Window.partitionBy(*FILE, "_open").orderBy("seq").rowsBetween(*_UP_TO_HERE)
    rows = rows.withColumn("_span", F.when(F.col("_open") > 0, F.last(span, ignorenulls=True).over(of_count)))
    return rows.select(*statements.columns, F.col("_span.var").alias("gate_var"), F.col("_span.value").alias("gate_value"), F.col("_span.branch").alias("branch"))


def read_build_files(statements: DataFrame, variables: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Statements with their gates, as the build files of each project are read, and the folders that
    are read: see `includes`.  Both are written to the shared folder, as much hangs on them.

    The operators below take such statements, so that lists and values go from file to file.  They also
    take plain ones; then each file is read by itself.  variables: (project_id, name, values), files:
    (project_id, path)."""
    gated = settled(scope_gates(statements, variables), "statements")
    tree = settled(include_tree(gated, variables, files), "tree")
    return settled(place_statements(gated, tree), "read"), tree


def _read(statements: DataFrame, variables: DataFrame) -> DataFrame:
    """Placed statements with gates, and `known`, the names of the project's variables."""
    rows = placed(statements if "gate_var" in statements.columns else scope_gates(statements, variables))
    known = variables.groupBy("project_id").agg(F.collect_set("name").alias("known"))
    return rows.join(known, "project_id", "left")


def _arg(k: int):
    return unquote(F.get("args", F.lit(k)))


def _in_array(array, x):
    return F.coalesce(F.array_contains(array, x), F.lit(False))


def _seen_from(folder, path):
    """A path in a build file, seen from the project's root; as it is where it leaves the project."""
    return F.when(folder == "", path).otherwise(F.coalesce(join_path(folder, path), path))


_COMPILER_FLAGS = ("CMAKE_C_FLAGS", "CMAKE_CXX_FLAGS")


def _is_default():
    """set(VAR value CACHE ...) of a known variable gives its default and nothing else."""
    return _in_array(F.col("known"), _arg(0)) & F.exists("args", lambda a: unquote(a) == "CACHE")


def _sets(rows: DataFrame) -> DataFrame:
    return rows.where("command = 'set' and size(args) > 0").where(~_is_default() & ~_arg(0).isin(*_COMPILER_FLAGS))


def _source_lists(rows: DataFrame) -> DataFrame:
    """(project_id, ctx, key, name, value): the paths of set(X_SOURCES ...), seen from the root."""
    paths = F.transform(F.slice("args", 2, F.size("args")), lambda a: _seen_from(F.col("dir"), unquote(a)))
    return _sets(rows).where(_arg(0).endswith("_SOURCES")).select("project_id", "ctx", "key", _arg(0).alias("name"), paths.alias("value"))


def _composed_values(rows: DataFrame) -> DataFrame:
    """(project_id, ctx, key, name, value): texts of other set(NAME text) that refer to a known variable."""
    refers = F.size(known_refs(_arg(1), F.col("known"))) > 0
    return _sets(rows).where(~_arg(0).endswith("_SOURCES") & refers).select("project_id", "ctx", "key", _arg(0).alias("name"), _arg(1).alias("value"))


def asof_assignments(statements: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """References ${X_SOURCES} (project_id, ctx, file, seq, name) with the paths of the latest
    set(X_SOURCES ...) read before, in the same context or one around it; null if none."""
    rows = placed(statements)
    rows = _read(rows, variables) if variables is not None else rows.withColumn("known", F.array().cast("array<string>"))
    names = F.explode(F.array_distinct(F.flatten(F.transform("args", find_var_refs))))
    refs = rows.where("command <> 'set'").select("project_id", "ctx", "chain", "file", "seq", "key", names.alias("name")).where(F.col("name").endswith("_SOURCES"))
    found = last_before(refs.withColumn("ref", F.struct("ctx", "key")), _source_lists(rows), "name")
    return found.select("project_id", "ctx", "file", "seq", "name", F.col("value").alias("assigned"))


#: What option() takes for on and off.
_ON, _OFF = ("ON", "TRUE", "YES", "1"), ("OFF", "FALSE", "NO", "0")


def variable_defaults(statements: DataFrame, variables: DataFrame) -> DataFrame:
    """(project_id, name, default) of known variables: the value of set(VAR v CACHE ...), blank as
    null, or true / false of option(VAR doc ON|OFF), null for other words; the last statement wins.
    What variants set stays in them."""
    known = variables.groupBy("project_id").agg(F.collect_set("name").alias("known"))
    rows = placed(statements).join(known, "project_id").where((F.size("tags") == 0) & (F.size("args") > 0))
    cached, option = (F.col("command") == "set") & _is_default(), (F.col("command") == "option") & _in_array(F.col("known"), _arg(0))
    value = F.when(cached, F.nullif(_arg(1), F.lit(""))).when(_arg(2).isin(*_ON), "true").when(_arg(2).isin(*_OFF), "false")
    rows = rows.where(cached | option).select("project_id", _arg(0).alias("name"), "key", value.alias("value"))
    return rows.groupBy("project_id", "name").agg(F.max(F.struct("key", "value"))["value"].alias("default"))


def _template(value, known):
    return fill_known(value, F.array_distinct(known_refs(value, known)))


def extract_defines(statements: DataFrame, variables: DataFrame) -> DataFrame:
    """Defines by kind, a row for each that is made: project_id, ctx, tags, key, at, define, kind, var,
    template, gate_var, gate_value, source_vars.  key and at order them.

    add_compile_definitions: NAME=${VAR} is bare, NAME="${VAR}" quoted, two or more known references
    composed, with a template of {VAR}.  add_definitions: bare, and a name without '=' inside a gate
    gated.  Both may leave out -D.  set() of compiler flags: -DNAME=... bare or composed; a reference
    to a composed value set before counts as that.  target_compile_definitions: names without '=' inside a gate,
    once for each gate of a context; nothing is stripped from them.

    In the end a bare define by a known variable that some statement set to two or more known
    references, the last such value where its context ends, becomes composed.
    """
    rows = _read(statements, variables)
    base = ["project_id", "ctx", "chain", "tags", "key", "known", "gate_var", "gate_value", "command"]
    is_ = lambda *c: F.col("command").isin(*c)
    flags = is_("set") & ~_is_default() & _arg(0).isin(*_COMPILER_FLAGS)
    words = (
        F.when(flags, F.filter(F.split(_arg(1), r"[ \t\r\n\f]+"), lambda w: w.startswith("-D")))
        .when(is_("target_compile_definitions"), F.transform(F.slice("args", 2, F.size("args")), unquote))
        .when(is_("add_compile_definitions", "add_definitions"), F.transform("args", unquote))
    )
    tokens = rows.select(*base, F.posexplode(words).alias("at", "token"))
    body = F.when(is_("target_compile_definitions"), F.col("token")).otherwise(F.regexp_replace("token", "^-D", ""))
    tokens = tokens.withColumn("body", body).withColumn("has_value", F.contains("body", F.lit("=")))
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    name = F.when(F.col("has_value"), trim(F.substring_index("body", "=", 1))).otherwise(F.col("body"))
    value = F.when(F.col("has_value"), trim(F.expr("substring(body, instr(body, '=') + 1)")))
    tokens = tokens.withColumns({"define": name, "value": value})
    inner = F.regexp_extract("value", '(?s)^"(.*)"$', 1)
    quoted, bare = single_var_ref(inner), single_var_ref(F.col("value"))
    refs = known_refs(F.col("value"), F.col("known"))
    is_known = lambda v: v.isNotNull() & _in_array(F.col("known"), v)
    kind = (
        F.when(is_("add_compile_definitions") & is_known(quoted), "quoted")
        .when(F.col("has_value") & ~is_("target_compile_definitions") & is_known(bare), "bare")
        .when(is_("add_compile_definitions") & (F.size(refs) >= 2), "composed")
        .when(is_("set") & bare.isNull() & (F.size(refs) >= 2), "composed")
        .when(is_("set") & bare.isNotNull(), "by value")
        .when(is_("add_definitions", "target_compile_definitions") & ~F.col("has_value") & F.col("gate_var").isNotNull() & ~(is_("target_compile_definitions") & F.col("token").isin("PRIVATE", "PUBLIC", "INTERFACE")), "gated")
    )
    tokens = tokens.withColumns({"var": F.coalesce(F.when(is_("add_compile_definitions"), quoted), bare), "kind": kind}).where("kind is not null")
    # A gated name of target_compile_definitions counts once for each gate of a context.
    earlier = F.row_number().over(Window.partitionBy("project_id", "ctx", "define", "gate_var", "gate_value", F.col("kind") == "gated").orderBy("key", "at"))
    tokens = tokens.withColumn("nth", F.when(is_("target_compile_definitions"), earlier).otherwise(1)).where("nth = 1").drop("nth")

    composed = _composed_values(rows)
    ref = F.struct("ctx", "key", "at")
    # Flags see the composed values set before them; bare defines those set when their context ends.
    last = F.array_append(F.when(F.size("chain") > 1, F.transform(F.split(F.substring_index("ctx", "/", -1), r"\."), lambda x: x.cast("long"))).otherwise(F.array().cast("array<bigint>")), F.lit((1 << 63) - 1))
    asks = tokens.where("kind in ('bare', 'by value')")
    asks = asks.select("project_id", "chain", F.when(F.col("kind") == "bare", last).otherwise(F.col("key")).alias("key"), F.col("var").alias("name"), ref.alias("ref"))
    told = last_before(asks, composed, "name").select("project_id", F.col("ref.ctx").alias("ctx"), F.col("ref.key").alias("key"), F.col("ref.at").alias("at"), F.col("value").alias("set_to"))
    tokens = tokens.join(told, ["project_id", "ctx", "key", "at"], "left")
    of_set = known_refs(F.col("set_to"), F.col("known"))
    by_set = F.col("kind").isin("bare", "by value") & (F.size(of_set) >= 2)
    out = tokens.withColumn("by_set", F.coalesce(by_set, F.lit(False))).where("by_set or kind <> 'by value'")
    is_composed = F.col("by_set") | (F.col("kind") == "composed")
    text = F.when(F.col("by_set"), F.col("set_to")).otherwise(F.col("value"))
    gated = F.col("kind") == "gated"
    sources = F.when(gated, F.array("gate_var")).when(is_composed, known_refs(text, F.col("known"))).otherwise(F.array("var"))
    return out.select(
        "project_id", "ctx", "tags", "key", "at", "define", F.when(is_composed, "composed").otherwise(F.col("kind")).alias("kind"), F.when(~is_composed & ~gated, F.col("var")).alias("var"),
        F.when(is_composed, _template(text, F.col("known"))).alias("template"), F.when(gated, F.col("gate_var")).alias("gate_var"), F.when(gated, F.col("gate_value")).alias("gate_value"),
        F.array_join(sources, ",").alias("source_vars"),
    )


def variant_defines(defines: DataFrame) -> DataFrame:
    """(project_id, driving_var, value, seq, define, kind, var) of the defines that variants opened by
    the project itself make, as flags_from_defaults takes them."""
    one = defines.where(F.size("tags") == 1)
    seq = F.row_number().over(Window.partitionBy("project_id", "ctx").orderBy("key", "at"))
    var = F.coalesce("var", "gate_var")
    return one.select("project_id", F.get("tags", F.lit(0))["var"].alias("driving_var"), F.get("tags", F.lit(0))["value"].alias("value"), seq.cast("long").alias("seq"), "define", "kind", var.alias("var"))


#: Words of a target's declaration that are no sources.
_TARGET_WORDS = ("STATIC", "SHARED", "MODULE", "INTERFACE", "OBJECT", "EXCLUDE_FROM_ALL")


def expand_targets(statements: DataFrame, variables: DataFrame) -> DataFrame:
    """Executables and libraries with all their sources: project_id, ctx, tags, file, seq, key, target,
    kind, gate_var, gate_value, sources (paths in order), driving_var.

    A source ${X_SOURCES} stands for the paths of the latest list read before; others are seen from
    the project's root.  The driving variable is the last known one that a list's paths refer to.
    """
    rows = _read(statements, variables)
    base = ["project_id", "ctx", "tags", "file", "seq", "key", "target", "kind", "gate_var", "gate_value"]
    targets = rows.where("command in ('add_executable', 'add_library') and size(args) > 0").withColumns({"target": _arg(0), "kind": F.when(F.col("command") == "add_executable", "exe").otherwise("lib")})
    parts = targets.select(*base, "chain", "dir", "known", F.posexplode_outer(F.slice("args", 2, F.size("args"))).alias("at", "arg"))
    parts = parts.withColumn("text", unquote(F.col("arg"))).where(F.col("text").isNull() | ~F.col("text").isin(*_TARGET_WORDS)).withColumn("name", single_var_ref(F.col("text")))
    asks = parts.where("name is not null").select("project_id", "chain", "key", "name", F.struct("ctx", "key", "at").alias("ref"))
    told = last_before(asks, _source_lists(rows), "name").select("project_id", F.col("ref.ctx").alias("ctx"), F.col("ref.key").alias("key"), F.col("ref.at").alias("at"), F.col("value").alias("listed"))
    parts = parts.join(told, ["project_id", "ctx", "key", "at"], "left")
    paths = F.coalesce("listed", F.when(F.col("text").isNotNull(), F.array(_seen_from(F.col("dir"), F.col("text")))), F.array().cast("array<string>"))
    drives = F.when(F.col("listed").isNotNull(), F.flatten(F.transform("listed", lambda p: known_refs(p, F.col("known")))))
    whole = parts.groupBy(*base).agg(F.array_sort(F.collect_list(F.struct("at", paths.alias("paths"), F.coalesce(drives, F.array().cast("array<string>")).alias("drives")))).alias("x"))
    sources = F.flatten(F.transform("x", lambda p: p["paths"]))
    found = whole.select(*base, sources.alias("sources"), F.try_element_at(F.flatten(F.transform("x", lambda p: p["drives"])), F.lit(-1)).alias("driving_var"))
    # A target all of whose words are such words has no part left.
    bare = targets.select(*base).join(found.select("project_id", "ctx", "key"), ["project_id", "ctx", "key"], "left_anti")
    return found.unionByName(bare.withColumns({"sources": F.array().cast("array<string>"), "driving_var": F.lit(None).cast("string")}))


def declare_targets(statements: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """(project_id, ctx, file, seq, target, kind, path): literal files of executables and libraries, those of
    ${X_SOURCES} references included; other ${...} paths go.  A target without files has a null path."""
    if variables is None:
        variables = statements.select("project_id").distinct().select("project_id", F.lit(None).cast("string").alias("name"))
    rows = expand_targets(statements, variables)
    literal = F.filter("sources", lambda p: ~F.contains(p, F.lit("${")))
    return rows.select("project_id", "ctx", "file", "seq", "target", "kind", F.explode_outer(literal).alias("path"))


def _selected(targets: DataFrame, files: DataFrame) -> DataFrame:
    """Targets whose sources a variable selects: project_id, ctx, key, target, var, value, path."""
    ref = lambda v: F.concat(F.lit("${"), v, F.lit("}"))
    rows = targets.where("driving_var is not null")
    rows = rows.withColumn("pattern", F.get(F.filter("sources", lambda p: F.contains(p, ref(F.col("driving_var")))), F.lit(0)))
    at = F.instr("pattern", ref(F.col("driving_var")))
    prefix = F.substring(F.col("pattern"), F.lit(1), at - 1)
    suffix = F.substring(F.col("pattern"), at + F.length(ref(F.col("driving_var"))), F.length("pattern"))
    rows = rows.withColumns({"prefix": prefix, "suffix": suffix})
    found = expand_source_patterns(rows.select("project_id", F.struct("pattern", "driving_var").alias("pattern"), "prefix", "suffix").distinct(), files)
    rows = rows.select("project_id", "ctx", "key", "target", F.col("driving_var").alias("var"), F.struct("pattern", "driving_var").alias("pattern"))
    return rows.join(found, ["project_id", "pattern"]).drop("pattern")


def select_sources_by_variable(statements: DataFrame, variables: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, ctx, target, var, value, path): targets with a driving variable; a row for each file
    that fits a value in the first of their sources that refers to it."""
    return _selected(expand_targets(statements, variables), files).drop("key")


def conditional_targets(statements: DataFrame, variables: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, ctx, target, kind, gate_var, gate_value, files): targets inside a gate that no
    variable selects sources for, with those of their files that exist, in order; dropped when none do."""
    targets = expand_targets(statements, variables)
    at = ["project_id", "ctx", "key"]
    left = targets.where("gate_var is not null").join(_selected(targets, files).select(*at), at, "left_anti")
    rows = left.select(*at, "target", "kind", "gate_var", "gate_value", F.posexplode("sources").alias("at", "path"))
    there = rows.join(files.select("project_id", "path"), ["project_id", "path"], "left_semi")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]), ",")
    return there.groupBy(*at, "target", "kind", "gate_var", "gate_value").agg(listed.alias("files")).drop("key")


def subdirectory_edges(tree: DataFrame) -> DataFrame:
    """(project_id, ctx, parent, child, var, value): the folders that `includes.include_tree` reads from
    another, by a literal path or by the value of a variable that opens the context."""
    opens = (F.size("tags") > 0) & (F.col("dir") == F.element_at("tops", -1))
    last = F.try_element_at("tags", F.lit(-1))
    return tree.where("parent is not null").select("project_id", "ctx", "parent", F.col("dir").alias("child"), F.when(opens, last["var"]).alias("var"), F.when(opens, last["value"]).alias("value"))


def config_presence(projects: DataFrame, configs: DataFrame) -> DataFrame:
    """(project_id, empty, reason): a project's configuration is empty when its file is missing, isn't
    JSON, or has no variables."""
    v = F.try_parse_json("content")
    has = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.configurable_variables", "variant")).startswith("OBJECT<") & (F.schema_of_variant(F.try_variant_get(v, "$.configurable_variables", "variant")) != "OBJECT<>"), F.lit(False))
    joined = projects.select("project_id").distinct().join(configs, "project_id", "left")
    reason = F.when(F.col("content").isNull(), "missing").when(v.isNull(), "malformed").when(~has, "no variables").otherwise("")
    return joined.select("project_id", reason.alias("reason")).withColumn("empty", F.col("reason") != "")
