"""Fact tables over project trees: layouts, sources, entities, lookups, requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize_path, path_status
from ..scratch import settled


def _ancestors(path: str = "path"):
    """Array of the proper ancestor directories of a path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def tree_counts(files: DataFrame) -> DataFrame:
    """Directories (without the root), files and bytes of each project."""
    dirs = files.select("project_id", F.explode(_ancestors()).alias("dir")).groupBy("project_id").agg(F.count_distinct("dir").alias("n_dirs"))
    totals = files.groupBy("project_id").agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))
    return totals.join(dirs, "project_id", "left").select("project_id", F.coalesce("n_dirs", F.lit(0)).alias("n_dirs"), "n_files", "bytes")


def discover_programs(files: DataFrame) -> DataFrame:
    """First path components that hold files, as programs; a project whose own layout is valid is one
    program, with the empty name."""
    single = validate_layout(files).where("ok").select("project_id", F.lit(True).alias("single"))
    below = files.where(F.col("path").contains("/")).join(single, "project_id", "left")
    return below.select("project_id", F.when(F.col("single"), "").otherwise(F.split("path", "/")[0]).alias("program")).distinct()


def read_vectors(files: DataFrame) -> DataFrame:
    """Test vectors of test_vectors/*.json files (project_id, path, content text) with defaults.

    Malformed files vanish: texts that aren't JSON objects, arguments that aren't all texts, a stdout
    without a textual pattern, a negative or fractional rc.
    """
    named = files.where(F.col("path").rlike(r"(^|/)test_vectors/[^/]+\.json$"))
    body = named.withColumn("v", F.try_parse_json("content")).where(F.schema_of_variant("v").startswith("OBJECT"))
    kind = lambda p: F.schema_of_variant(F.try_variant_get("v", p, "variant"))
    absent = lambda p: F.try_variant_get("v", p, "variant").isNull()
    ok = (
        (absent("$.argv") | kind("$.argv").isin("ARRAY<STRING>", "ARRAY<VOID>"))
        & (absent("$.stdin") | kind("$.stdin").isin("STRING", "VOID"))
        & (absent("$.stdout") | (kind("$.stdout.pattern") == "STRING"))
        & (absent("$.stdout.is_regex") | (kind("$.stdout.is_regex") == "BOOLEAN"))
        & (absent("$.rc") | (kind("$.rc") == "VOID") | ((kind("$.rc") == "BIGINT") & (F.try_variant_get("v", "$.rc", "bigint") >= 0)))
    )
    return body.where(F.coalesce(ok, F.lit(False))).select(
        "project_id", F.element_at(F.split("path", "/"), -1).alias("filename"), F.coalesce(F.try_variant_get("v", "$.argv", "array<string>"), F.array().cast("array<string>")).alias("argv"),
        F.try_variant_get("v", "$.stdin", "string").alias("stdin"), F.coalesce(F.try_variant_get("v", "$.stdout.pattern", "string"), F.lit("")).alias("pattern"),
        F.coalesce(F.try_variant_get("v", "$.stdout.is_regex", "boolean"), F.lit(False)).alias("is_regex"), F.try_variant_get("v", "$.rc", "bigint").alias("rc"),
        F.try_variant_get("v", "$.has_ub", "string").alias("has_ub"),
    )


_REASONS = ("compiler-artifact", "compiler-message", "build-finished")


def read_build_messages(lines: DataFrame) -> DataFrame:
    """Build messages of JSON lines (project_id, seq, line): artifacts, compiler messages, finished;
    other kinds and texts that aren't JSON are ignored."""
    v = F.try_parse_json("line")
    get = lambda p, t: F.try_variant_get("v", p, t)
    rows = lines.withColumn("v", v).withColumn("reason", get("$.reason", "string")).where(F.col("reason").isin(*_REASONS))
    return rows.select(
        "project_id", "seq", "reason", get("$.message.level", "string").alias("level"), get("$.message.message", "string").alias("text"),
        get("$.executable", "string").alias("executable"), get("$.success", "boolean").alias("success"),
        get("$.message.spans", "array<struct<file_name:string,byte_start:bigint,byte_end:bigint>>").alias("spans"),
    )


def error_messages(messages: DataFrame) -> DataFrame:
    """Compiler messages of level error."""
    return messages.where((F.col("reason") == "compiler-message") & (F.col("level") == "error"))


def validate_layout(files: DataFrame) -> DataFrame:
    """(project_id, ok, reason): needs test_case/, in it src/ or CMakeLists.txt, and test_vectors/; the
    first failing one is the reason."""
    has = lambda p: F.bool_or(F.col("path").rlike(p))
    flags = files.groupBy("project_id").agg(has("^test_case/").alias("c"), has("^test_case/(src/|CMakeLists[.]txt$)").alias("s"), has("^test_vectors/").alias("v"))
    reason = F.when(~F.col("c"), "no test_case").when(~F.col("s"), "no sources").when(~F.col("v"), "no test_vectors")
    return flags.select("project_id", reason.isNull().alias("ok"), F.coalesce(reason, F.lit("")).alias("reason"))


def select_sources(files: DataFrame) -> DataFrame:
    """Files whose extension is exactly c or h, outside build folders."""
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(F.lit("CMakeFiles"), F.lit(".cache"), F.lit("build")))
    return files.where(F.col("path").rlike(r"[^/]\.[ch]$") & ~skipped)


def classify_project_kind(files: DataFrame, targets: DataFrame) -> DataFrame:
    """(project_id, kind): by targets (project_id, kind) first, executable before library, else by a
    call at the start of a line of the root build file (project_id, text); else unknown."""
    by_target = targets.groupBy("project_id").agg(F.bool_or(F.col("kind") == "exe").alias("te"), F.bool_or(F.col("kind") == "lib").alias("tl"))
    lines = F.split("text", "\n")
    by_text = files.groupBy("project_id").agg(
        F.bool_or(F.exists(lines, lambda x: x.startswith("add_executable("))).alias("fe"), F.bool_or(F.exists(lines, lambda x: x.startswith("add_library("))).alias("fl")
    )
    on = lambda c: F.coalesce(c, F.lit(False))
    kind = F.when(on("te"), "Executable").when(on("tl"), "Library").when(on("fe"), "Executable").when(on("fl"), "Library").otherwise("Unknown")
    return by_text.join(by_target, "project_id", "full").select("project_id", kind.alias("kind"))


#: Kinds of entities and the bucket of each.
_BUCKETS = {"struct": "types", "union": "types", "enum": "types", "typedef": "types", "variable": "globals", "include": "includes", "define": "defines", "macro": "macros"}


def route_entities(entities: DataFrame) -> DataFrame:
    """entities with bucket; functions by is_definition; other kinds and system headers go."""
    table = reduce(lambda acc, kv: acc.when(F.col("kind") == kv[0], kv[1]), _BUCKETS.items(), F.when((F.col("kind") == "function") & F.col("is_definition"), "functions").when(F.col("kind") == "function", "declarations"))
    return entities.withColumn("bucket", table).where(F.col("bucket").isNotNull() & ~F.coalesce(F.col("file").startswith("/usr/"), F.lit(False)))


def public_functions(definitions: DataFrame, declarations: DataFrame) -> DataFrame:
    """Definitions (project_id, name, storage_class) that are not static, have a name, and are declared
    in a header (case doesn't matter)."""
    headers = declarations.where(F.lower("file").endswith(".h")).select("project_id", "name")
    open_ = definitions.where((F.coalesce("storage_class", F.lit("")) != "static") & (F.coalesce("name", F.lit("")) != ""))
    return open_.join(headers, ["project_id", "name"], "left_semi")


def tag_variants(entities: DataFrame, selections: DataFrame) -> DataFrame:
    """entities with tags, the (var, value) list of their file's selections in order, repeats kept."""
    tags = selections.groupBy("project_id", "file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "var", "value"))), lambda t: F.concat(t["var"], F.lit("="), t["value"])).alias("tags")
    )
    return entities.join(tags, ["project_id", "file"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def stack_outer_tags(subdirs: DataFrame, files: DataFrame) -> DataFrame:
    """files (project_id, node_id, path) with the tags of all their nested variants, outermost first.
    subdirs: (project_id, node_id, parent_id, var, value), a forest; a node whose line of parents breaks
    off, and a file of no node, has no tags.

    Every node knows the tags up to some ancestor, at first its parent; in a round it takes over what
    that ancestor knows, which doubles the way.  So the rounds are logarithmic in the depth, which is at
    most a project's nodes; a circle of parents takes more and is an error.
    """
    node = ["project_id", "node_id"]
    tag = F.concat("var", F.lit("="), "value")
    known = settled(subdirs.select(*node, F.col("parent_id").alias("up"), tag.alias("tags")), "stack")
    most = known.groupBy("project_id").count().agg(F.max("count")).first()[0] or 0
    for _ in range(most.bit_length() + 1):
        if known.where("up is not null").isEmpty():
            break
        above = known.select("project_id", F.col("node_id").alias("up"), F.col("up").alias("higher"), F.col("tags").alias("outer"))
        climbing = known.where("up is not null").join(above, ["project_id", "up"])
        climbed = climbing.select(*node, F.col("higher").alias("up"), F.concat("outer", F.lit(","), "tags").alias("tags"))
        known = settled(known.where("up is null").unionByName(climbed), "stack")
    else:
        raise ValueError("the parents of some nodes go round in a circle")
    return files.join(known.drop("up"), node, "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def expand_source_patterns(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, pattern, value, path): patterns pre${VAR}suf (project_id, pattern, prefix, suffix)
    against files; the part between must be a name.  Joined on project, the prefix's folder, which
    must be one of the file's, and depth, as a name holds no slash."""
    depth = lambda c: F.length(c) - F.length(F.replace(c, F.lit("/")))
    left = patterns.withColumns({"folder": F.regexp_extract("prefix", r"(?s)^(.*/)?[^/]*$", 1), "depth": depth(F.concat("prefix", "suffix"))})
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    right = files.select("project_id", "path", depth(F.col("path")).alias("depth"), F.explode(above).alias("folder"))
    fits = F.col("path").startswith(F.col("prefix")) & F.col("path").endswith(F.col("suffix")) & (F.length("path") > F.length("prefix") + F.length("suffix"))
    value = F.substring(F.col("path"), F.length("prefix") + 1, F.length("path") - F.length("prefix") - F.length("suffix"))
    return left.join(right, ["project_id", "folder", "depth"]).where(fits).withColumn("value", value).where(F.col("value").rlike("^[A-Za-z0-9_]+$")).select("project_id", "pattern", "value", "path")


def nearest_ancestor(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """paths (project_id, path of a directory) with the closest ancestor, itself included, that owns a
    marker (project_id, dir); null if none."""
    up = F.array_append(_ancestors(), F.col("path"))
    each = paths.select("project_id", "path", F.explode(up).alias("dir")).join(markers.select("project_id", "dir").distinct(), ["project_id", "dir"])
    nearest = each.groupBy("project_id", "path").agg(F.max_by("dir", F.length("dir")).alias("ancestor"))
    return paths.select("project_id", "path").distinct().join(nearest, ["project_id", "path"], "left")


def lookup_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    """requests (project_id, request) -> status (ok, absolute, outside, directory, under_file, missing)
    and size (and content, if files have it) of the file found."""
    named = requests.withColumns({"status": path_status(F.col("request")), "path": normalize_path(F.col("request"))})
    dirs = files.select("project_id", F.explode(_ancestors()).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    over = named.select("project_id", "path", F.explode(_ancestors()).alias("up")).join(files.select("project_id", F.col("path").alias("up")), ["project_id", "up"], "left_semi")
    under = over.select("project_id", "path").distinct().withColumn("under", F.lit(True))
    rest = ["content"] if "content" in files.columns else []
    found = named.join(files.select("project_id", "path", "size", *rest), ["project_id", "path"], "left").join(dirs, ["project_id", "path"], "left").join(under, ["project_id", "path"], "left")
    status = (
        F.when(F.col("status") != "ok", F.col("status")).when(F.col("size").isNotNull(), "ok").when(F.col("is_dir"), "directory")
        .when(F.col("under"), "under_file").otherwise("missing")
    )
    return found.select("project_id", "request", status.alias("status"), "size", *rest)


def check_new_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """new (project_id, request) with status: ok, or why the file can't be created."""
    looked = lookup_files(new, files)
    status = F.when(F.col("request") == "", "empty").when(F.col("request").endswith("/"), "directory").when(F.col("status") == "ok", "exists").when(F.col("status") == "missing", "ok").otherwise(F.col("status"))
    return looked.select("project_id", "request", status.alias("status"))


def align_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests and responses (project_id, seq, text) zipped by position; the shorter length counts,
    and a difference in number is flagged."""
    def placed(df, name):
        w = Window.partitionBy("project_id")
        return df.select("project_id", F.row_number().over(w.orderBy("seq")).alias("pos"), F.col("text").alias(name), F.count("*").over(w).alias(f"n_{name}"))

    joined = placed(requests, "request").join(placed(responses, "response"), ["project_id", "pos"])
    return joined.select("project_id", F.col("pos").cast("long").alias("pos"), "request", "response", (F.col("n_request") != F.col("n_response")).alias("mismatch"))


def collect_dependencies(responses: DataFrame) -> DataFrame:
    """Distinct sorted dependency names of each project, trimmed, blanks left out, joined by commas."""
    names = responses.select("project_id", F.explode("dependencies").alias("name")).withColumn("name", F.trim("name")).where("name <> ''").distinct()
    return names.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("dependencies"))


#: Order of the sections of a recombined file.
_SECTIONS = ("imports", "macros", "types", "globals", "functions")


def recombine(responses: DataFrame) -> DataFrame:
    """Per project the code of all sections in order, empty parts skipped, joined by blank lines."""
    rank = F.array_position(F.array(*map(F.lit, _SECTIONS)), F.col("section"))
    parts = responses.withColumns({"rank": rank, "code": F.trim("rust_code")}).where("rank > 0 and code <> ''")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos", "code"))), lambda x: x["code"])
    return parts.groupBy("project_id").agg(F.array_join(ordered, "\n\n").alias("code"))


def build_requests(files: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """One JSON payload for each project: its files (path, text) in order of path, and, if given, its
    entities (name, kind, text) in order of entity_seq; a project without entities has an empty list.
    Projects without files give none."""
    items = F.array_sort(F.collect_list(F.struct("path", F.col("text").alias("contents"))))
    grouped = files.groupBy("project_id").agg(items.alias("files"), F.count("*").alias("n_files"))
    if entities is None:
        return grouped.select("project_id", F.to_json(F.struct("files")).alias("payload"), "n_files")
    one = F.struct("entity_seq", F.struct("name", "kind", F.col("text").alias("source")).alias("entity"))
    named = entities.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["entity"]).alias("entities"))
    kind = dict(named.dtypes)["entities"]
    both = grouped.join(named, "project_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast(kind)))
    return both.select("project_id", F.to_json(F.struct("files", "entities")).alias("payload"), "n_files", F.size("entities").cast("long").alias("n_entities"))


def build_facts_summary(**tables: DataFrame) -> DataFrame:
    """Per project the number of rows in each table."""
    counted = [t.select("project_id", F.lit(name).alias("fact")) for name, t in tables.items()]
    return reduce(DataFrame.union, counted).groupBy("project_id").pivot("fact", list(tables)).count().na.fill(0)


#: Extensions of what a release folder holds beside its program.
_NO_PROGRAM = ("d", "rlib", "rmeta", "pdb", "exp", "lib")


def pick_artifact(files: DataFrame, rule: str = "library") -> DataFrame:
    """One file for each project.  `library`: by extension so, dylib, dll, then the lowest path.
    `program`: the lowest path whose name isn't hidden and hasn't one of the extensions that go along
    with a program."""
    if rule == "program":
        name = F.regexp_extract("path", r"(?s)([^/]*)$", 1)
        extension = F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)
        plain = files.where(~name.startswith(".") & ~extension.isin(*_NO_PROGRAM))
        return plain.groupBy("project_id").agg(F.min("path").alias("artifact"))
    if rule != "library":
        raise ValueError(f"rule must be library or program, not {rule!r}")
    order = F.when(F.col("path").endswith(".so"), 0).when(F.col("path").endswith(".dylib"), 1).when(F.col("path").endswith(".dll"), 2)
    return files.withColumn("o", order).where("o is not null").groupBy("project_id").agg(F.min(F.struct("o", "path"))["path"].alias("artifact"))


def in_buckets(entities: DataFrame, buckets: list[str]) -> DataFrame:
    """Entities of some buckets, with the place of their bucket in the list."""
    return entities.withColumn("bucket_no", F.array_position(F.array(*map(F.lit, buckets)), F.col("bucket"))).where("bucket_no > 0")


def library_only_targets(conditional: DataFrame, selections: DataFrame) -> DataFrame:
    """Distinct conditional target names that no selection names."""
    return conditional.select("project_id", "target").distinct().join(selections.select("project_id", "target"), ["project_id", "target"], "left_anti")


def parse_response(responses: DataFrame, column: str, schema: str, required: list[str]) -> DataFrame:
    """Other columns, the fields of schema, and status: error where the text (fences removed) isn't JSON
    of that schema or a required field is missing."""
    from ..functions import strip_fences

    names = [f.split()[0] for f in schema.split(",")]
    body = strip_fences(F.col(column))
    typed = F.from_json(body, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = responses.withColumn("_j", typed)
    good = F.col("_j._corrupt").isNull() & F.col("_j").isNotNull()
    for name in required:
        good = good & F.col(f"_j.{name}").isNotNull()
    rest = [c for c in responses.columns if c != column]
    return rows.select(*rest, *[F.when(good, F.col(f"_j.{n}")).alias(n) for n in names], F.when(good, "ok").otherwise("error").alias("status"))
