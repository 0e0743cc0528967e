"""Evaluation results: judging outputs, and rolling them up by program, combination and corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import success_rate

_TRIM = r"(?U)^\s+|\s+$"


def _compiles(pattern: Column) -> Column:
    """Whether a text is a pattern to the engine of rlike."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


#: What the escapes of a pattern mean; a pattern's letters, digits and spaces are those of Unicode.
_CLASSES = {"d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{Nd}\p{Pc}", "s": r"\s\x{85}\p{Z}"}


def _spelled_out(pattern: str) -> str:
    """\\d, \\w and \\s (and \\D, \\W, \\S outside brackets) by their Unicode classes."""
    out, inside, k = [], False, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            name = pattern[k + 1]
            known = _CLASSES.get(name) or (None if inside else _CLASSES.get(name.lower()))
            out.append(pattern[k : k + 2] if not known else known if inside else f"[{known}]" if name.islower() else f"[^{known}]")
            k += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        k += 1
    return "".join(out)


@F.arrow_udf(BooleanType())
def _found(texts: pa.Array, patterns: pa.Array) -> pa.Array:
    """Whether each pattern occurs in its text; a text that is no pattern is found nowhere.  The engine
    takes time in proportion to the text and constant stack, whatever the pattern."""
    coded = patterns.dictionary_encode()
    of = coded.indices.fill_null(-1).to_numpy()
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(len(coded.dictionary) + 1))
    out = np.zeros(len(of), dtype=bool)
    for k, pattern in enumerate(coded.dictionary.to_pylist()):
        rows = order[cuts[k] : cuts[k + 1]]
        try:
            hits = pc.match_substring_regex(texts.take(pa.array(rows)), _spelled_out(pattern))
        except pa.ArrowInvalid:
            continue
        out[rows] = hits.fill_null(False).to_numpy(zero_copy_only=False)
    return pa.array(out)


def judge_output(vectors: DataFrame, outputs: DataFrame) -> DataFrame:
    """Vectors (project_id, filename, pattern, is_regex, has_ub) against outputs (project_id, filename,
    actual): passed and skipped per vector.

    A vector flagged as undefined behaviour passes as skipped; else a regex must be found in the
    output, or the trimmed texts be equal.  No output fails.  An invalid pattern fails its vectors
    only; look-around and back references are invalid.  Patterns are matched in Arrow batches by an
    engine without backtracking, so no pattern or output can end the job; only the rows of regular expressions
    go there.
    """
    joined = vectors.join(outputs, ["project_id", "filename"], "left")
    ub = F.col("has_ub").isNotNull()
    asks = F.col("is_regex") & ~ub
    same = F.regexp_replace("actual", _TRIM, "") == F.regexp_replace("pattern", _TRIM, "")
    found = _found(F.when(asks, F.col("actual")), F.when(asks, F.col("pattern")))
    passed = F.when(F.col("is_regex"), found).otherwise(same)
    return joined.select(
        "project_id", "filename", (ub | F.coalesce(F.col("actual").isNotNull() & passed, F.lit(False))).alias("passed"), ub.alias("skipped")
    )


def combo_results(results: DataFrame, builds: DataFrame) -> DataFrame:
    """(project_id, combo, combo_passed): built, and every vector passed or was skipped.  builds:
    (project_id, combo, built); a combination without results that was built passes."""
    tested = results.groupBy("project_id", "combo").agg(F.bool_and(F.col("passed") | F.col("skipped")).alias("all_passed"))
    return builds.join(tested, ["project_id", "combo"], "left").select(
        "project_id", "combo", (F.coalesce("built", F.lit(False)) & F.coalesce("all_passed", F.lit(True))).alias("combo_passed")
    )


def first_tested_combo(results: DataFrame) -> DataFrame:
    """The earliest combination of each program that was tested."""
    return results.groupBy("project_id").agg(F.min("combo").alias("combo"))


def program_rollup(programs: DataFrame, vectors: DataFrame, results: DataFrame) -> DataFrame:
    """Totals of each program, from its first tested combination.

    The total is the number of its vectors whatever happened to it, so a program that was not
    translated keeps its total with nothing passed.
    """
    totals = vectors.groupBy("project_id").agg(F.count("*").alias("total_tests"))
    counts = results.groupBy("project_id", "combo").agg(
        F.count_if(F.col("passed") & ~F.col("skipped")).alias("passed_tests"), F.count_if("skipped").alias("skipped_tests")
    )
    first = counts.groupBy("project_id").agg(F.min_by(F.struct("passed_tests", "skipped_tests"), "combo").alias("of"))
    joined = programs.join(totals, "project_id", "left").join(first, "project_id", "left")
    zero = F.lit(0).cast("long")
    ran = F.col("translated") & F.col("built")
    joined = joined.select(
        "project_id", "translated", "built", F.coalesce("total_tests", zero).alias("total_tests"),
        F.when(ran, F.coalesce("of.passed_tests", zero)).otherwise(zero).alias("passed_tests"),
        F.when(ran, F.coalesce("of.skipped_tests", zero)).otherwise(zero).alias("skipped_tests"),
    )
    evaluated = F.greatest(F.col("total_tests") - F.col("skipped_tests"), zero)
    return joined.withColumns(
        {"evaluated_tests": evaluated, "failed_tests": F.greatest(evaluated - F.col("passed_tests"), zero),
         "success_rate": success_rate(F.col("passed_tests"), F.col("total_tests"), F.col("skipped_tests"))}
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(0.0)


def summary_stats(programs: DataFrame) -> DataFrame:
    """One row of corpus sums and rates over a program rollup; rates of nothing are 0.0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = programs.agg(
        F.count("*").alias("num_programs"), F.count_if("translated").alias("translated"), F.count_if("built").alias("built"),
        total("total_tests").alias("total_tests"), total("skipped_tests").alias("skipped_tests"), total("passed_tests").alias("passed_tests"),
    )
    return sums.withColumns(
        {"overall_rate": success_rate(F.col("passed_tests"), F.col("total_tests"), F.col("skipped_tests")),
         "translation_rate": _share(F.col("translated"), F.col("num_programs")), "build_rate": _share(F.col("built"), F.col("num_programs"))}
    )


def strict_pass(combos: DataFrame) -> DataFrame:
    """Whether a program passes in all of its combinations."""
    return combos.groupBy("project_id").agg(F.bool_and("combo_passed").alias("strict_passed"), F.count("*").alias("combos"))


def failing_programs(programs: DataFrame) -> DataFrame:
    """Programs that failed, and why: not translated, not built, failing tests."""
    why = F.array_compact(
        F.array(F.when(~F.col("translated"), "translation"), F.when(~F.col("built"), "build"), F.when(F.col("failed_tests") > 0, "tests"))
    )
    return programs.withColumn("reasons", F.array_join(why, ",")).where("reasons <> ''").select("project_id", "reasons")


def csv_rows(programs: DataFrame, combos: DataFrame) -> DataFrame:
    """The ten text columns of the results file: a row for each program and combination, or a
    `default` row that failed where a program has none."""
    from ..functions import pct2

    joined = programs.join(combos, "project_id", "left")
    text = lambda c: F.col(c).cast("string").alias(c)
    return joined.select(
        F.col("project_id").alias("program_name"), F.col("translated").cast("string").alias("translation_success"), F.col("built").cast("string").alias("rust_build_success"),
        text("total_tests"), text("passed_tests"), text("skipped_tests"), pct2(F.col("success_rate")).alias("success_rate"),
        F.coalesce("error_message", F.lit("")).alias("error_message"), F.coalesce(F.col("combo").cast("string"), F.lit("default")).alias("feature_combo"),
        F.coalesce("combo_passed", F.lit(False)).cast("string").alias("combo_passed"),
    )


def name_filter(df: DataFrame, column: str, pattern: str, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by a regex found anywhere in a name; a null name matches nothing.  A pattern
    that doesn't compile is an error before any job."""
    if not df.sparkSession.range(1).select(_compiles(F.lit(pattern))).first()[0]:
        raise ValueError(f"not a pattern: {pattern!r}")
    match = F.coalesce(F.col(column).rlike(pattern), F.lit(False))
    good = match if keep else ~match
    return df.where(good), df.where(~good)


def diff_counts(outputs: DataFrame) -> DataFrame:
    """Per project, lines of `output` that start with 'PASS ' (passed), 'FAIL ' or 'WARN ' (both
    failures, kept in order); other lines don't count."""
    lines = outputs.select("project_id", F.posexplode(F.split("output", "\n")).alias("pos", "line"))
    bad = F.col("line").startswith("FAIL ") | F.col("line").startswith("WARN ")
    failures = F.transform(F.array_sort(F.collect_list(F.when(bad, F.struct("pos", "line")))), lambda x: x["line"])
    return lines.groupBy("project_id").agg(
        F.count_if(F.col("line").startswith("PASS ")).alias("passed"), F.count_if(bad).alias("failed"), F.array_join(failures, "\n").alias("failures")
    ).withColumn("total", F.col("passed") + F.col("failed"))


def diff_compare(left: DataFrame, right: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """keys and verdict PASS, FAIL or WARN of `value` in two tables of (keys, value).

    A missing side or an unknown kind warns; `void` passes where both sides are; `string` values are
    equal or both null; `scalar` values are equal, and NaN equals nothing.
    """
    a = left.select(*keys, F.col("value").alias("a"), F.lit(True).alias("has_a"))
    b = right.select(*keys, F.col("value").alias("b"), F.lit(True).alias("has_b"))
    both = F.col("has_a") & F.col("has_b")
    if kind == "void":
        good = F.lit(True)
    elif kind == "string":
        good = F.col("a").eqNullSafe(F.col("b"))
    elif kind == "scalar":
        numeric = dict(a.dtypes)["a"] in ("double", "float")
        good = F.coalesce((F.col("a") == F.col("b")) & (~F.isnan("a") if numeric else F.lit(True)), F.lit(False))
    else:
        both, good = F.lit(False), F.lit(False)
    verdict = F.when(~F.coalesce(both, F.lit(False)), "WARN").when(good, "PASS").otherwise("FAIL")
    return a.join(b, keys, "full").select(*keys, verdict.alias("verdict"))


def build_status(messages: DataFrame) -> DataFrame:
    """Per project: success of the last `finished` message (false if none), counts, and the first
    executable in message order."""
    finished = F.col("reason") == "build-finished"
    return messages.groupBy("project_id").agg(
        F.coalesce(F.max_by(F.when(finished, F.col("success")), F.when(finished, F.col("seq"))), F.lit(False)).alias("success"),
        F.count_if(F.col("reason") == "compiler-artifact").alias("artifacts"),
        F.count_if(F.col("reason") == "compiler-message").alias("messages"),
        F.min_by("executable", F.when(F.col("executable").isNotNull(), F.col("seq"))).alias("executable"),
    )


def run_numbers(runs: DataFrame) -> DataFrame:
    """runs with run_id: the nth start of its tool, as tool_007."""
    n = F.row_number().over(Window.partitionBy("project_id", "tool").orderBy("run_seq"))
    return runs.withColumn("run_id", F.concat("tool", F.lit("_"), F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.lit(3)), F.lit("0"))))


def artifact_versions(runs: DataFrame) -> DataFrame:
    """runs with version: successes of the project so far; failures don't raise it."""
    so_far = Window.partitionBy("project_id").orderBy("run_seq").rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("version", F.sum(F.col("success").cast("long")).over(so_far))


def latest_artifact(artifacts: DataFrame, exactly_one: tuple[str, ...] = ()) -> DataFrame:
    """Per project and kind the highest artifact id; kinds that must be single carry status error if not."""
    found = artifacts.groupBy("project_id", "kind").agg(F.max("artifact_id").alias("artifact_id"), F.count("*").alias("n"))
    single = F.col("kind").isin(*exactly_one) if exactly_one else F.lit(False)
    return found.withColumn("status", F.when(single & (F.col("n") != 1), "error").otherwise("ok"))


def repair_passes(artifacts: DataFrame, kind: str) -> DataFrame:
    """Successive artifacts of a kind per project as pass_0, pass_1, ..."""
    n = F.row_number().over(Window.partitionBy("project_id").orderBy("artifact_id")) - 1
    return artifacts.where(F.col("kind") == kind).select("project_id", "artifact_id", F.concat(F.lit("pass_"), n).alias("pass"))


def token_usage(usage: DataFrame) -> DataFrame:
    """Sums of three counters for each project, call kind and overall (rollup; null stands for all)."""
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    return usage.rollup("project_id", "call_kind").agg(total("prompt"), total("output"), total("total"))
