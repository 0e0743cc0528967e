"""File trees as tables, and results written back to files."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count, groupby
from operator import itemgetter

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import settled

#: Paths or bytes that a batch holds at most.
BATCH_PATHS, BATCH_BYTES = 10_000, 8_000_000


class _Shared:
    """Folders that all executors share; names may be any bytes."""

    def entries(self, folder: bytes) -> Iterator[tuple[bytes, bool]]:
        with os.scandir(folder) as found:
            for x in found:
                if x.is_dir(follow_symlinks=False):
                    yield os.fsencode(x.path), True
                elif x.is_file():
                    yield os.fsencode(x.path), False

    def read(self, path: bytes) -> bytes:
        with open(path, "rb") as f:
            return f.read()


class _Store:
    """A store that Arrow opens, in the task itself."""

    def __init__(self, store: fs.FileSystem):
        self.store = store

    def entries(self, folder: bytes) -> Iterator[tuple[bytes, bool]]:
        for x in self.store.get_file_info(fs.FileSelector(folder.decode())):
            if x.type in (fs.FileType.Directory, fs.FileType.File):
                yield x.path.encode(), x.type == fs.FileType.Directory

    def read(self, path: bytes) -> bytes:
        with self.store.open_input_file(path.decode()) as f:
            return f.read()


def _walked(spark: SparkSession, root: bytes, opened: Callable[[], _Shared | _Store]) -> DataFrame:
    """full, content, size of all files below root.

    Folders are listed in tasks, a level a round, each folder by itself; what a round finds is a
    table, and the driver asks only whether it holds folders.  Files are read where their names are dealt to,
    so a folder with very many isn't one task's work.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def listed(batches):
        store, held = opened(), []

        def out():
            paths, folders = zip(*held, strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(paths, type=pa.binary()), pa.array(folders)], names=["raw", "folder"])

        for batch in batches:
            for folder in batch.column("raw").to_pylist():
                for x in store.entries(folder):
                    held.append(x)
                    if len(held) >= BATCH_PATHS:
                        yield out()
        if held:
            yield out()

    def read(batches):
        store, held, volume = opened(), [], 0

        def out():
            raw, content = zip(*held, strict=True)
            held.clear()
            columns = [pa.array([x.decode("utf-8", "replace") for x in raw], type=pa.string()), pa.array(content, type=pa.binary()), pa.array(map(len, content), type=pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["full", "content", "size"])

        for batch in batches:
            for raw in batch.column("raw").to_pylist():
                held.append((raw, store.read(raw)))
                volume += len(held[-1][1]) + 1000
                if volume > BATCH_BYTES:
                    yield out()
                    volume = 0
        if held:
            yield out()

    found, folders = [], spark.createDataFrame([(root,)], "raw binary")
    while True:
        level = settled(folders.repartition(tasks, "raw").mapInArrow(listed, "raw binary, folder boolean"), "listed")
        found.append(level.where("not folder").select("raw"))
        folders = level.where("folder").select("raw")
        if folders.isEmpty():
            break
    return reduce(DataFrame.unionByName, found).repartition(tasks, "raw").mapInArrow(read, "full string, content binary, size long")


def _listed_by_spark(spark: SparkSession, root: str) -> DataFrame:
    """full, content, size through Spark's reader, whose index of files is the driver's."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = found.select(F.col("path").alias("full"), "content", F.col("length").alias("size"))
    # The reader leaves empty files out; the index that it lists, names encoded, has them.
    listed = spark.createDataFrame([(p,) for p in found.inputFiles()], "full string")
    listed = listed.select(F.url_decode(F.replace("full", F.lit("+"), F.lit("%2B"))).alias("full"))
    empty = listed.join(files.select("full"), "full", "left_anti").select("full", F.unhex(F.lit("")).alias("content"), F.lit(0).cast("long").alias("size"))
    return files.unionByName(empty)


def _opener(root: str) -> tuple[Callable[[], fs.FileSystem] | None, str]:
    """How tasks open the store of a URI, and the path in it; no way if Arrow doesn't know its scheme."""
    try:
        _, path = fs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, OSError):
        return None, root
    return (lambda: fs.FileSystem.from_uri(root)[0]), path


def load_tree(spark: SparkSession, root: str, store: Callable[[], fs.FileSystem] | None = None) -> DataFrame:
    """Every regular file below root: project_id (first path component), path below it, content, size.
    Files at the root itself belong to project ''.

    root: a folder that all executors share, as a path or file: URI, or the URI of a store that Arrow
    opens (s3, gs, abfs, hdfs), or a path in the store that `store` opens in a task.  These are listed in
    tasks, level by level.  Other URIs go through Spark's reader, which lists on the driver.
    """
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", root)
    if store:
        base = root.strip("/")
        files = _walked(spark, base.encode(), lambda: _Store(store()))
    elif not scheme or scheme[1] == "file":
        base = os.path.abspath("/" + root[5:].lstrip("/") if scheme else root)
        files = _walked(spark, os.fsencode(base), _Shared)
    else:
        way, path = _opener(root)
        base = path.rstrip("/") if way else root.rstrip("/")
        files = _walked(spark, base.encode(), lambda: _Store(way())) if way else _listed_by_spark(spark, root)
    below = files.withColumn("below", F.substring("full", len(base) + 2 if base else 1, 1 << 30))
    return below.select(
        F.when(F.instr("below", "/") > 0, F.substring_index("below", "/", 1)).otherwise("").alias("project_id"),
        F.expr("substring(below, instr(below, '/') + 1)").alias("path"), "content", "size",
    )


def materialize_tree(files: DataFrame, root: str) -> None:
    """Write files (project_id, path, content) below root, a folder that all executors share.  Paths
    are checked first: one that is absolute or leaves its project is an error before anything is written."""
    from ..functions import normalize_path, path_status

    bad = files.where((path_status(F.col("path")) != "ok") | F.col("project_id").contains("/")).select("path").take(1)
    if bad:
        raise ValueError(f"unsafe path: {bad[0]['path']!r}")

    def write(rows):
        for row in rows:
            target = os.path.join(root, row["project_id"], row["path"])
            os.makedirs(os.path.dirname(target), exist_ok=True)
            partial = f"{target}.{os.getpid()}.part"
            with open(partial, "wb") as f:
                f.write(row["content"] or b"")
            os.replace(partial, target)  # a repeated task leaves whole files

    files.select("project_id", normalize_path(F.col("path")).alias("path"), "content").foreachPartition(write)


def write_results_csv(rows: DataFrame, path: str) -> None:
    """The ten columns of results.csv_rows as CSV with a header."""
    rows.write.mode("overwrite").csv(path, header=True)


#: What Spark writes as %XX in the name of a partition's folder, and the name for null and ''.
_ESCAPED, _NO_NAME = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]"), "__HIVE_DEFAULT_PARTITION__"


def _shared_folder(spark: SparkSession, path: str) -> str | None:
    """The path as tasks open it where Spark takes it for a folder that all executors share, else None."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(at).toUri().getPath() if store.getUri().getScheme() == "file" else None


def _write_by_project(rows: DataFrame, path: str, suffix: str) -> None:
    """Lines (project_id, value) as text in the layout of Spark's partitionBy("project_id"), in place of what
    path held.  A project's lines are dealt to one task, or to few where they are many.

    In a shared folder tasks write the files themselves: Spark's committer moves each project's folder
    on the driver, one after the other, and its local files cost a process each.  Files stay small
    enough to be read whole.
    """
    spark = rows.sparkSession
    dealt = settled(rows, "lines").repartitionByRange("project_id", F.xxhash64("value")).sortWithinPartitions("project_id")
    root = _shared_folder(spark, path)
    if root is None:
        dealt.write.mode("overwrite").partitionBy("project_id").option("lineSep", "\n").text(path)
        return

    def write(batches):
        part = TaskContext.get().partitionId()
        lines = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for project, own in groupby(lines, itemgetter(0)):
            folder = os.path.join(root, "project_id=" + (_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", project) if project else _NO_NAME))
            os.makedirs(folder, exist_ok=True)
            for k in count():
                held, volume = [], 0
                for _, value in own:
                    held.append(value)
                    volume += len(value) + 1
                    if volume > BATCH_BYTES:
                        break
                if not held:
                    break
                name = f"part-{part:05d}-{k}{suffix}"
                partial = os.path.join(folder, f"_{name}.{os.getpid()}")
                with open(partial, "wb") as f:
                    f.writelines(x for value in held for x in (value, b"\n"))
                os.replace(partial, os.path.join(folder, name))  # a repeated task leaves whole files
        yield from ()

    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(at, True)
    store.mkdirs(at)
    dealt.select("project_id", F.col("value").cast("binary")).mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
    store.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")).close()


def read_by_project(spark: SparkSession, path: str) -> DataFrame:
    """(project_id, value): the lines that write_failed_vectors or write_error_text has written.  In a shared folder they
    are listed in tasks, as Spark's index of so many folders is slow and the driver's."""
    root = _shared_folder(spark, path)
    if root is None:
        return spark.read.schema("value string, project_id string").option("lineSep", "\n").text(path).select("project_id", "value")
    files = load_tree(spark, root).where(F.col("project_id").startswith("project_id=") & F.col("path").startswith("part-"))
    name = F.substring("project_id", len("project_id=") + 1, 1 << 30)
    project = F.when(name != _NO_NAME, F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))))
    lines = F.split(F.expr("substring(content, 1, length(content) - 1)").cast("string"), "\n")
    return files.select(project.alias("project_id"), F.explode(lines).alias("value"))


def write_failed_vectors(vectors: DataFrame, results: DataFrame, path: str) -> None:
    """The vectors that failed as JSON, a folder for each project; nulls are left out."""
    failed = results.where("not passed and not skipped").select("project_id", "filename").distinct()
    kept = vectors.join(failed, ["project_id", "filename"], "left_semi")
    _write_by_project(kept.select("project_id", F.to_json(F.struct(*[c for c in kept.columns if c != "project_id"])).alias("value")), path, ".json")


def write_error_text(errors: DataFrame, path: str) -> None:
    """Error lines (project_id, line) as text, a folder for each project that has any."""
    _write_by_project(errors.select("project_id", F.col("line").alias("value")).where("value is not null"), path, ".txt")
