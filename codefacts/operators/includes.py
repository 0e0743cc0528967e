"""Build files of a project in the order in which they are read: includes, variants and scopes.

A build file reads others: add_subdirectory(path) goes on in that folder's file and comes back, each
folder once; add_subdirectory(${VAR}) opens a *variant* for each value of the variable whose folder has
a build file, and variants see what was set before them but not one another.  So statements live in a
context (the project's, or a variant's in another context), and a context is a walk over folders.

Every statement gets a key: the places of the statements that led to it, outermost first, and its own.
Keys of one project order as the walk does, so "the last value set before this" is a window over keys
in the statement's context and those around it.  A folder is read where it is met first, which is its
least key in the context; the walk is a relaxation over edges, one round for each level of folders
and variants, over all projects at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import join_path, single_var_ref, unquote
from ..scratch import settled

BUILD_FILE = "CMakeLists.txt"
PLACE = ["project_id", "ctx"]


def folder_of(path) -> F.Column:
    """The folder of a path; '' at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def build_folders(files: DataFrame) -> DataFrame:
    """(project_id, dir): folders with a build file, of files (project_id, path)."""
    return files.where((F.col("path") == BUILD_FILE) | F.col("path").endswith("/" + BUILD_FILE)).select("project_id", folder_of(F.col("path")).alias("dir")).distinct()


def subdirectory_calls(statements: DataFrame, variables: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, dir, seq, vi, var, value, child): the folders with a build file that another's
    statement reads, once for a literal path (var, vi and value null) and for each value of a known
    variable.  Paths that leave the project go."""
    folders = build_folders(files).withColumnRenamed("dir", "child")
    known = variables.select("project_id", F.col("name").alias("var"), "values")
    text = unquote(F.get("args", F.lit(0)))
    calls = statements.where("command = 'add_subdirectory' and size(args) > 0").select("project_id", folder_of(F.col("file")).alias("dir"), "seq", text.alias("path"), single_var_ref(text).alias("var"))
    calls = calls.join(known, ["project_id", "var"], "left")
    one = F.array(F.lit(None).cast("string"))
    rows = calls.select("project_id", "dir", "seq", "path", F.when(F.col("values").isNotNull(), F.col("var")).alias("var"), F.posexplode(F.coalesce("values", one)).alias("vi", "value"))
    rows = rows.where("var is null or value is not null").withColumn("child", join_path(F.col("dir"), F.coalesce("value", "path")))
    return rows.join(folders, ["project_id", "child"], "left_semi").select("project_id", "dir", F.col("seq").cast("long").alias("seq"), F.when(F.col("var").isNotNull(), F.col("vi").cast("long")).alias("vi"), "var", "value", "child")


_AT = ["project_id", "ctx", "dir"]
_CONTEXT = ["chain", "tags", "tops", "trail"]
_START = (
    "project_id", "'' as ctx", "dir", "cast(array() as array<bigint>) as key", "cast(null as string) as parent", "array('') as chain",
    "cast(array() as array<struct<var:string,value:string>>) as tags", "array('') as tops", "cast(array() as array<struct<ctx:string,dir:string,key:array<bigint>>>) as trail",
)


def include_tree(statements: DataFrame, variables: DataFrame, files: DataFrame) -> DataFrame:
    """The folders that each context reads: project_id, ctx, dir, key, parent, chain, tags, tops.

    statements: (project_id, file, seq, command, args); variables: (project_id, name, values); files:
    (project_id, path).  ctx is '' for the project itself; chain holds a context and those around it,
    tags the (var, value) choices that lead to it, outermost first, tops the folders that those
    contexts begin in; parent is the folder whose file reads this one.  A project without a build file
    at its root has no rows.  A folder is read once in a context.  A variant whose folder already
    begins a context around it would go on for ever and is not opened.

    A round goes one folder deeper everywhere.  It may reach a folder before the walk's first way to it
    is known; a later round then finds the smaller key and what hangs on it.  Variants that were
    opened on a way that turned out not to be the first go in the end.
    """
    edges = settled(subdirectory_calls(statements, variables, files), "edges")
    frontier = settled(build_folders(files).where("dir = ''").selectExpr(*_START), "met")
    met = frontier
    opens = F.col("var").isNotNull()
    key = F.concat("at", F.when(opens, F.array("seq", "vi")).otherwise(F.array("seq")))
    inner = F.concat_ws("/", "outer", F.array_join(F.transform("key", lambda x: x.cast("string")), "."))
    more = lambda c, x: F.when(opens, F.concat(c, F.array(x))).otherwise(F.col(c))
    while True:
        reached = frontier.withColumnsRenamed({"dir": "parent_dir", "key": "at", "ctx": "outer"}).drop("parent").join(edges.withColumnRenamed("dir", "parent_dir"), ["project_id", "parent_dir"])
        reached = reached.where(~opens | ~F.array_contains("tops", F.col("child"))).withColumn("key", key).withColumn("ctx", F.when(opens, inner).otherwise(F.col("outer")))
        reached = reached.select(
            "project_id", "ctx", F.col("child").alias("dir"), "key", F.col("parent_dir").alias("parent"), more("chain", F.col("ctx")).alias("chain"), more("tags", F.struct("var", "value")).alias("tags"),
            more("tops", F.col("child")).alias("tops"), more("trail", F.struct(F.col("outer").alias("ctx"), F.col("parent_dir").alias("dir"), F.col("at").alias("key"))).alias("trail"),
        )
        had = met.groupBy(*_AT).agg(F.min("key").alias("had"))
        better = _first_ways(reached).join(had, _AT, "left").where(F.col("had").isNull() | (F.col("key") < F.col("had"))).drop("had")
        frontier = settled(better, "met")
        if frontier.isEmpty():
            break
        met = met.unionByName(frontier)
    found = settled(_first_ways(met), "walk")
    first = found.select("project_id", F.col("ctx").alias("of"), "dir", F.col("key").alias("first"))
    steps = found.select("project_id", "ctx", F.explode("trail").alias("step")).select("project_id", "ctx", F.col("step.ctx").alias("of"), F.col("step.dir").alias("dir"), F.col("step.key").alias("key")).distinct()
    stale = steps.join(first, ["project_id", "of", "dir"]).where("key <> first").select("project_id", "ctx").distinct()
    return found.join(stale, PLACE, "left_anti").drop("trail")


def _first_ways(rows: DataFrame) -> DataFrame:
    """For each folder of a context the row with the least key."""
    best = rows.groupBy(*_AT).agg(F.min(F.struct("key", "parent")).alias("met"), *[F.first(c).alias(c) for c in _CONTEXT])
    return best.select(*_AT, "met.key", "met.parent", *_CONTEXT)


def place_statements(statements: DataFrame, tree: DataFrame) -> DataFrame:
    """statements as they are read: with ctx, chain, tags, dir and key, once for each context that reads their file."""
    at = tree.select("project_id", F.when(F.col("dir") == "", BUILD_FILE).otherwise(F.concat("dir", F.lit("/" + BUILD_FILE))).alias("file"), "ctx", "chain", "tags", "dir", F.col("key").alias("at"))
    placed = statements.join(at, ["project_id", "file"])
    return placed.withColumn("key", F.concat("at", F.array(F.col("seq").cast("long")))).drop("at")


def placed(statements: DataFrame) -> DataFrame:
    """statements with places; those that have none are read file by file, each at a root of its own."""
    if "key" in statements.columns:
        return statements
    return statements.withColumns({
        "ctx": F.col("file"), "chain": F.array("file"), "tags": F.array().cast("array<struct<var:string,value:string>>"), "dir": F.lit(""), "key": F.array(F.col("seq").cast("long")),
    })


def last_before(refs: DataFrame, sets: DataFrame, *by: str) -> DataFrame:
    """refs (project_id, chain, key, ref, by) with `value` of the latest of sets (project_id, ctx, key,
    by, value) whose key is smaller, in a context of the chain; null if there is none.

    ref must tell refs apart.  A ref looks into each context of its chain by itself, so a project's
    sets are never copied; what it finds there with the largest key counts.
    """
    looks = refs.withColumn("ctx", F.explode("chain"))
    marked = sets.select("project_id", "ctx", *by, "key", F.struct("key", "value").alias("set"), F.lit(None).cast(dict(refs.dtypes)["ref"]).alias("ref"))
    asking = looks.select("project_id", "ctx", *by, "key", F.lit(None).cast(marked.schema["set"].dataType).alias("set"), "ref")
    # At one key a statement asks before it sets.
    order = Window.partitionBy("project_id", "ctx", *by).orderBy("key", F.col("ref").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = marked.unionByName(asking).withColumn("set", F.last("set", ignorenulls=True).over(order)).where("ref is not null")
    latest = seen.where("set is not null").groupBy("project_id", "ref", *by).agg(F.max_by("set.value", "set.key").alias("value"))
    return refs.join(latest, ["project_id", "ref", *by], "left")
