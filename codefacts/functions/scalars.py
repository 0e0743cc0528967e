"""Scalar functions over paths, names, texts and rates, as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _walk(p: Column) -> Column:
    """'/a/b' for the path's components, or '!' where it climbs over its root."""
    step = lambda acc, x: (
        F.when(acc == "!", acc).when(x.isin("", "."), acc)
        .when(x == "..", F.when(acc == "", F.lit("!")).otherwise(F.regexp_replace(acc, "/[^/]*$", "")))
        .otherwise(F.concat(acc, F.lit("/"), x))
    )
    return F.aggregate(F.split(p, "/"), F.lit(""), step)


def path_status(p: Column) -> Column:
    """ok, absolute, outside (climbs over its root) or directory (ends in '..' or names nothing)."""
    walked = _walk(p)
    named = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    return (
        F.when(p.startswith("/"), "absolute").when(walked == "!", "outside")
        .when((F.size(named) == 0) | (F.element_at(named, -1) == "..") | (walked == ""), "directory").otherwise("ok")
    )


def normalize_path(p: Column) -> Column:
    """The path with '.', '..' and doubled slashes resolved; null where its status isn't ok."""
    return F.when(path_status(p) == "ok", F.substring(_walk(p), 2, 1 << 30))


def join_path(folder: Column, p: Column) -> Column:
    """A relative path seen from a folder of the project ('' is its root), normalized; '' for the root
    itself, null where the path is absolute or climbs over the root."""
    walked = _walk(F.concat_ws("/", folder, p))
    return F.when(p.startswith("/") | (walked == "!"), F.lit(None)).otherwise(F.substring(walked, 2, 1 << 30))


def sanitize_name(s: Column) -> Column:
    """Characters other than ASCII letters, digits, '_' and '-' as '_'; '_' before a leading digit or '-'."""
    return F.regexp_replace(F.regexp_replace(s, "[^A-Za-z0-9_-]", "_"), "^(?=[0-9-])", "_")


def strip_fences(s: Column) -> Column:
    """The text inside a leading and a closing code fence, trimmed; null where nothing is left."""
    body = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    inner = F.regexp_extract(body, r"(?s)^```(?:json|rust)?(.*)```$", 1)
    text = F.when(body.rlike(r"(?s)^```.*```$") & (F.length(body) >= 6), inner).otherwise(body)
    text = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(text != "", text)


def find_var_refs(s: Column) -> Column:
    """Names in ${NAME} references, in order."""
    return F.regexp_extract_all(s, F.lit(r"\$\{([A-Za-z0-9_]+)\}"), 1)


def single_var_ref(s: Column) -> Column:
    """NAME where the text is one ${NAME} reference, but for white space around it; else null."""
    return F.nullif(F.regexp_extract(s, r"(?U)^\s*\$\{([A-Za-z0-9_]+)\}\s*$", 1), F.lit(""))


def known_refs(s: Column, known: Column) -> Column:
    """Names in ${NAME} references that an array holds, in order, repeats kept."""
    return F.filter(find_var_refs(s), lambda v: F.coalesce(F.array_contains(known, v), F.lit(False)))


def fill_known(s: Column, known: Column) -> Column:
    """${NAME} as {NAME} for the names in an array; other references stay."""
    replaced = lambda acc, v: F.replace(acc, F.concat(F.lit("${"), v, F.lit("}")), F.concat(F.lit("{"), v, F.lit("}")))
    return F.aggregate(known, s, replaced)


def unquote(s: Column) -> Column:
    """Without outer double quotes and the backslashes of escapes inside; other texts as they are."""
    quoted = s.rlike('(?s)^".*"$') & (F.length(s) >= 2)
    inner = F.substring(s, F.lit(2), F.length(s) - 2)
    return F.when(quoted, F.regexp_replace(inner, r"(?s)\\(.?)", "$1")).otherwise(s)


def success_rate(passed: Column, total: Column, skipped: Column) -> Column:
    """100 * passed / (total - skipped), 0.0 where nothing was evaluated."""
    evaluated = F.greatest(total - skipped, F.lit(0))
    return F.when(evaluated > 0, passed * F.lit(100.0) / evaluated).otherwise(0.0)


def pct2(x: Column) -> Column:
    """Two decimals, rounding the exact binary value half to even (of non-negative numbers)."""
    below = F.floor(x * 100).cast("double")
    # 100 * x against the half-way point without rounding: x is cut into a short part, whose product
    # with 100 is exact, and the rest.
    short = x.cast("float").cast("double")
    past = (short * 100 - (below + 0.5)) + (x - short) * 100
    up = (past > 0) | ((past == 0) & (below % 2 == 1))
    return F.format_string("%.2f", (below + up.cast("double")) / 100)


def lossy_utf8(b: Column) -> Column:
    """Bytes as text, invalid ones replaced by U+FFFD."""
    return F.make_valid_utf8(b.cast("string"))


def relativize(p: Column, root: Column) -> Column:
    """Without the root and its slash, where the path lies below it."""
    prefix = F.concat(root, F.lit("/"))
    return F.when(F.startswith(p, prefix), F.substring(p, F.length(prefix) + 1, F.length(p))).otherwise(p)


def fill_template(t: Column, entries: Column) -> Column:
    """{KEY} replaced by values, one entry of an array of (key, value) after the other."""
    return F.aggregate(entries, t, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def line_hint(text: Column, key: str) -> Column:
    """The non-empty double-quoted value of the first line that starts with key; null if none."""
    literal = key.replace("\\E", "\\E\\\\E\\Q")  # the key stands for itself
    found = F.regexp_extract(text, rf'(?m)^[ \t]*\Q{literal}\E[^"\n]*"([^"\n]+)"', 1)
    return F.when(found != "", found)
