"""Configuration matrices: feature groups, combinations, even samples, sweeps, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settled

MOST_COMBOS = 1024


def group_features(features: DataFrame) -> DataFrame:
    """(project_id, group_seq, group_name, kind, variants): features that share the text before their
    last '_' with another are one group (one-of), every other is an on/off flag.

    Groups by name come first, then flags by name; members are sorted; a flag's variants are its name
    and the empty string.
    """
    names = features.select("project_id", "name").distinct()
    prefix = F.regexp_extract("name", r"^(.*)_[^_]*$", 1)
    named = names.withColumn("prefix", F.when(prefix != "", prefix))
    shared = F.count("*").over(Window.partitionBy("project_id", "prefix"))
    named = named.withColumn("one_of", F.col("prefix").isNotNull() & (shared > 1))
    groups = (
        named.withColumns({"kind": F.when(F.col("one_of"), "enum").otherwise("flag"), "group_name": F.when(F.col("one_of"), F.col("prefix")).otherwise(F.col("name"))})
        .groupBy("project_id", "kind", "group_name").agg(F.array_sort(F.collect_list("name")).alias("members"))
    )
    variants = F.when(F.col("kind") == "enum", F.col("members")).otherwise(F.array("group_name", F.lit("")))
    seq = F.row_number().over(Window.partitionBy("project_id").orderBy("kind", "group_name"))
    return groups.select("project_id", seq.cast("long").alias("group_seq"), "group_name", "kind", variants.alias("variants"))


def sample_indices(total: Column, n: int) -> Column:
    """Array of floor(i * total / n), i < n; all indices when there are no more than n."""
    chosen = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * total / F.lit(n)).cast("long"))
    return F.when(total <= n, F.sequence(F.lit(0).cast("long"), total - 1)).otherwise(chosen)


def sample_evenly(df: DataFrame, n: int, partition: list[str], order: list[str]) -> DataFrame:
    """Rows at places floor(i * P / n) of each partition, i < n; all when P <= n."""
    w = Window.partitionBy(*partition)
    placed = df.withColumns({"_r": F.row_number().over(w.orderBy(*order)) - 1, "_p": F.count("*").over(w)})
    i = F.ceil(F.col("_r") * n / F.col("_p"))
    keep = (F.col("_p") <= n) | ((i < n) & (F.floor(i * F.col("_p") / n) == F.col("_r")))
    return placed.where(keep).drop("_r", "_p")


def enumerate_combos(groups: DataFrame, mode: str | int, projects: DataFrame | None = None) -> DataFrame:
    """(project_id, combo_index, label): the product of a project's groups, first group slowest.

    mode `all` lists all and refuses more than 1024, `default` gives one row, n > 0 samples n evenly.
    A project of `projects` (project_id) without groups gives one row, labelled default.  Labels are sorted, joined by
    commas, `none` if empty.

    Row i of n stands for combination floor(i * P / n) of P.  Its digits, one a group, come by long
    division of i by n in the mixed radix of the groups: what is left of a digit, below n, goes into the
    next.  So neither the product nor an index beyond 2**63 is ever formed; such an index is null.
    """
    if mode != "all" and mode != "default" and (not str(mode).isdigit() or int(mode) <= 0):
        raise ValueError(f"mode must be all, default or a positive number, not {mode!r}")
    lists = groups.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_seq", "variants"))), lambda g: g["variants"]).alias("radix"))
    zero = F.lit(0).cast("long")
    alone = None
    if projects is not None:
        alone = projects.select("project_id").distinct().join(lists.select("project_id"), "project_id", "left_anti").select("project_id", zero.alias("combo_index"), F.lit("default").alias("label"))
    if mode == "default":
        rows = lists.select("project_id", zero.alias("combo_index"), F.lit("default").alias("label"))
        return rows if alone is None else rows.unionByName(alone)
    most = MOST_COMBOS if mode == "all" else int(mode)
    # The number of combinations, counted no further than one more than is wanted.
    total = F.aggregate("radix", F.lit(1).cast("long"), lambda acc, g: F.least(acc * F.size(g), F.lit(most + 1).cast("long")))
    lists = lists.withColumn("total", total)
    n = F.least("total", F.lit(most))
    if mode == "all":
        n = F.when(F.col("total") > most, F.raise_error(F.concat(F.lit("too many combinations: "), F.col("project_id")))).otherwise(F.col("total"))
    rows = lists.withColumn("n", n.cast("long")).withColumn("i", F.explode(F.sequence(zero, F.col("n") - 1)))

    def divide(state, g):
        part = state["rest"] * F.size(g)
        digit = (part - part % F.col("n")) / F.col("n")
        index = F.try_add(F.try_multiply(state["index"], F.size(g).cast("long")), digit.cast("long"))
        name = F.element_at(g, (digit + 1).cast("int"))
        return F.struct((part % F.col("n")).alias("rest"), index.alias("index"), F.when(name == "", state["chosen"]).otherwise(F.array_append(state["chosen"], name)).alias("chosen"))

    # The index may become null on the way, which its start must allow for.
    start = F.struct(F.col("i").alias("rest"), F.when(F.col("i") >= 0, zero).alias("index"), F.array().cast("array<string>").alias("chosen"))
    rows = rows.withColumn("combo", F.aggregate("radix", start, divide))
    label = F.when(F.size("combo.chosen") > 0, F.array_join(F.array_sort("combo.chosen"), ",")).otherwise("none")
    rows = rows.select("project_id", F.col("combo.index").alias("combo_index"), label.alias("label"))
    return rows if alone is None else rows.unionByName(alone)


def ovat_sweep(params: DataFrame, values: DataFrame) -> DataFrame:
    """(fn, vector_no, args): first values of all parameters, then one varied at a time.

    params: (fn, pos, ty), values: (ty, ord, val) with ord from 0.  A function with a type without
    values is left out.
    """
    of_type = values.groupBy("ty").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "val"))), lambda v: v["val"]).alias("vals"))
    lists = params.join(of_type, "ty", "left").groupBy("fn").agg(
        F.array_sort(F.collect_list(F.struct("pos", "vals"))).alias("p"), F.bool_or(F.col("vals").isNull()).alias("unknown")
    ).where("not unknown").select("fn", F.transform("p", lambda x: x["vals"]).alias("p"))
    base = F.transform("p", lambda v: v[0])
    varied = F.flatten(
        F.transform("p", lambda v, i: F.transform(F.slice(v, 2, F.size(v)), lambda x: F.transform("p", lambda w, j: F.when(i == j, x).otherwise(w[0]))))
    )
    rows = lists.select("fn", F.posexplode(F.concat(F.array(base), varied)).alias("vector_no", "args"))
    return rows.select("fn", F.col("vector_no").cast("long").alias("vector_no"), "args")


#: Representative arguments for each scalar type, the neutral one first; types that
#: share them are parted by a bar.
BOUNDARY_VALUES = {
    "int|signed int|signed": ["0", "1", "-1", "INT_MAX", "INT_MIN"],
    "unsigned int|unsigned": ["0", "1", "UINT_MAX"],
    "long|signed long|long int": ["0", "1", "-1", "LONG_MAX", "LONG_MIN"],
    "unsigned long|unsigned long int": ["0", "1", "ULONG_MAX"],
    "long long|signed long long|long long int": ["0", "1", "-1", "LLONG_MAX", "LLONG_MIN"],
    "unsigned long long|unsigned long long int": ["0", "1", "ULLONG_MAX"],
    "short|signed short|short int": ["0", "1", "-1", "SHRT_MAX", "SHRT_MIN"],
    "unsigned short|unsigned short int": ["0", "1", "USHRT_MAX"],
    "char": ["0", "'a'", "CHAR_MAX", "CHAR_MIN"],
    "signed char": ["0", "1", "-1", "SCHAR_MAX", "SCHAR_MIN"],
    "unsigned char": ["0", "'a'", "UCHAR_MAX"],
    "float": ["0.0f", "1.0f", "-1.0f"],
    "double": ["0.0", "1.0", "-1.0"],
    "long double": ["0.0L", "1.0L", "-1.0L"],
    "size_t": ["0", "1", "SIZE_MAX"],
    "ssize_t|ptrdiff_t|intptr_t": ["0", "1", "-1"],
    "uintptr_t": ["0", "1"],
    "bool|_Bool": ["0", "1"],
    "int8_t|int_least8_t|int_fast8_t": ["0", "1", "-1", "INT8_MAX", "INT8_MIN"],
    "int16_t|int_least16_t|int_fast16_t": ["0", "1", "-1", "INT16_MAX", "INT16_MIN"],
    "int32_t|int_least32_t|int_fast32_t": ["0", "1", "-1", "INT32_MAX", "INT32_MIN"],
    "int64_t|int_least64_t|int_fast64_t": ["0", "1", "-1", "INT64_MAX", "INT64_MIN"],
    "uint8_t|uint_least8_t|uint_fast8_t": ["0", "1", "UINT8_MAX"],
    "uint16_t|uint_least16_t|uint_fast16_t": ["0", "1", "UINT16_MAX"],
    "uint32_t|uint_least32_t|uint_fast32_t": ["0", "1", "UINT32_MAX"],
    "uint64_t|uint_least64_t|uint_fast64_t": ["0", "1", "UINT64_MAX"],
}
STRING_VALUES = ["NULL", '""', '"hello"']
#: Spellings of a text's type, and how deep types are followed.
STRING_TYPES = ("char *", "const char *", "char*", "const char*")
MOST_NESTED = 4


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _type_parts(types: DataFrame) -> DataFrame:
    """types (ty) with what each is: a text, a pointer to `inner`, or a value; `struct` is the structure's name if it is one."""
    name = _trimmed(F.col("ty"))
    inner = _trimmed(F.regexp_replace(_trimmed(F.regexp_replace(name, r"\*$", "")), "^(const)+", ""))
    kind = F.when(name.isin(*STRING_TYPES), "text").when(name.endswith("*"), "pointer").otherwise("value")
    base = F.when(name.endswith("*"), inner).otherwise(name)
    return types.select("ty", name.alias("name"), kind.alias("kind"), F.when(kind == "pointer", inner).alias("inner"), _trimmed(F.regexp_replace(base, "^(struct)+", "")).alias("struct"))


def boundary_values(types: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """types (ty) with their representative values in order; unknown types give no rows.

    Texts (char *, const or not) take null, the empty and a short one; a pointer to a known type takes
    the address of its neutral (first) value and null; any other pointer takes null alone.  fields
    (struct, literal, pos, field, ty): the fields of structures, and the type's name in a literal.  A structure's
    value is one literal of its fields' neutral values; fields of unknown types are left out, and
    one without any is {0}.  Types are followed four levels deep, below that all are unknown, so a
    structure that holds itself ends.

    The values at each level are made from those one level down, which is a join on the distinct types;
    there are far fewer of them than uses.
    """
    spark = types.sparkSession
    rows = [(t, vs) for names, vs in BOUNDARY_VALUES.items() for t in names.split("|")]
    scalars = F.broadcast(spark.createDataFrame(rows, "name string, own array<string>"))  # a fixed table
    if fields is None:
        fields = spark.createDataFrame([], "struct string, literal string, pos int, field string, ty string")
    literals = fields.groupBy("struct").agg(F.first("literal").alias("literal"))
    needed = types.select("ty").union(fields.select("ty")).distinct()
    every = needed
    for _ in range(MOST_NESTED):  # what pointers point at are types, too; written, as each is spelled by the one before
        needed = settled(_type_parts(needed).where("kind = 'pointer'").select(F.col("inner").alias("ty")).distinct(), "pointees")
        every = every.union(needed)
    parts = _type_parts(every.distinct()).join(scalars, "name", "left").join(literals, "struct", "left")
    parts = settled(parts, "types")
    null = F.array(F.lit("NULL"))
    values = parts.select("ty", F.lit(None).cast("array<string>").alias("vals")).where("false")
    for _ in range(MOST_NESTED + 1):
        first = values.select(F.col("ty").alias("inner"), F.get("vals", F.lit(0)).alias("neutral"))
        inits = fields.join(first.withColumnRenamed("inner", "ty"), "ty").where("neutral is not null").groupBy("struct").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "field", "neutral"))), lambda x: F.concat(F.lit("."), x["field"], F.lit(" = "), x["neutral"])), ", ").alias("inits")
        )
        rows = parts.join(first, "inner", "left").join(inits, "struct", "left")
        literal = F.concat(F.lit("("), "literal", F.lit("){"), F.coalesce("inits", F.lit("0")), F.lit("}"))
        value = (
            F.when(F.col("kind") == "text", F.array(*map(F.lit, STRING_VALUES)))
            .when((F.col("kind") == "pointer") & (F.col("inner") == "void"), null)
            .when((F.col("kind") == "pointer") & F.col("literal").isNotNull(), F.array(F.concat(F.lit("&"), literal), F.lit("NULL")))
            .when((F.col("kind") == "pointer") & F.col("neutral").isNotNull(), F.array(F.concat(F.lit("&("), "inner", F.lit("){"), "neutral", F.lit("}")), F.lit("NULL")))
            .when(F.col("kind") == "pointer", null)
            .when(F.col("literal").isNotNull(), F.array(literal))
            .otherwise(F.col("own"))
        )
        values = settled(rows.select("ty", value.alias("vals")).where("vals is not null"), "values")
    asked = types.select("ty").distinct().join(values, "ty")
    return asked.select("ty", F.posexplode("vals").alias("ord", "val")).select("ty", F.col("ord").cast("long").alias("ord"), "val")


def classify_variables(config: DataFrame) -> DataFrame:
    """(project_id, name, kind, numeric, n_values) of config (project_id, name, body VARIANT array).

    Boolean when all values are booleans; numeric when all are numbers or texts of integers; null,
    array and object values are left out and set both false.  An empty list is an enum, not numeric.
    """
    one = F.explode_outer(F.try_variant_get("body", "$", "array<variant>")).alias("v")
    values = config.select("project_id", "name", one)
    kind = F.schema_of_variant("v")
    text = F.try_variant_get("v", "$", "string")
    number = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|INT|SMALLINT|TINYINT|FLOAT)")
    integer = (kind == "STRING") & text.rlike("^[+-]?[0-9]+$") & F.try_variant_get("v", "$", "string").try_cast("bigint").isNotNull()
    there = F.col("v").isNotNull()
    return values.groupBy("project_id", "name").agg(
        F.bool_and(F.when(there, kind == "BOOLEAN")).alias("all_bool"), F.bool_and(F.when(there, number | F.coalesce(integer, F.lit(False)))).alias("all_number"),
        F.count_if(there & (number | kind.isin("BOOLEAN", "STRING"))).alias("n_values"),
    ).select(
        "project_id", "name", F.when(F.coalesce("all_bool", F.lit(False)), "Boolean").otherwise("Enum").alias("kind"), F.coalesce("all_number", F.lit(False)).alias("numeric"), "n_values"
    )


def default_selection(config_vars: DataFrame) -> DataFrame:
    """(project_id, selection): booleans whose default is true, and VAR_default of each enum, where a
    missing or unlisted default is its first value; sorted, joined by commas."""
    listed = F.when(F.array_contains("values", F.col("default")), F.col("default")).otherwise(F.get("values", F.lit(0)))
    one = F.when(F.col("kind") == "Boolean", F.when(F.col("default") == "true", F.col("name"))).otherwise(F.concat("name", F.lit("_"), listed))
    return config_vars.withColumn("one", one).groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list("one")), ",").alias("selection"))


def _flag(kind, define, name, default):
    """-DNAME=value: by its define where the kind is bare or quoted, else by the given name."""
    named = F.when(kind.isin("bare", "quoted"), define).otherwise(name)
    value = F.when(kind == "quoted", F.concat(F.lit('"'), default, F.lit('"'))).otherwise(default)
    return F.concat(F.lit("-D"), named, F.lit("="), value)


def flags_from_defaults(config_vars: DataFrame, defines: DataFrame, subdirs: DataFrame | None = None) -> DataFrame:
    """(project_id, flags): -DNAME=value for each variable with a default, by its first define (kinds
    bare, quoted, composed, gated); composed and gated ones give the variable's own name.

    subdirs (project_id, driving_var, value, seq, define, kind, var): the defines of subdirectories, one
    of which is chosen by a variable.  Those of the subdirectory whose value is the driving variable's
    default follow, in order of seq, with the default of their own variable; a composed one gives none,
    and neither does one whose variable is unknown or has no default.
    """
    first = defines.groupBy("project_id", F.col("var").alias("name")).agg(F.min_by(F.struct("define", "kind"), "seq").alias("d"))
    known = config_vars.where("default is not null")
    rows = known.join(first, ["project_id", "name"], "left")
    flag = _flag(F.coalesce("d.kind", F.lit("")), F.col("d.define"), F.col("name"), F.col("default"))
    flags = rows.select("project_id", F.lit(0).alias("part"), "name", F.lit(0).cast("long").alias("seq"), flag.alias("flag"))
    if subdirs is not None:
        chosen = subdirs.join(known.select("project_id", F.col("name").alias("driving_var"), F.col("default").alias("value")), ["project_id", "driving_var", "value"], "left_semi")
        valued = chosen.where("kind <> 'composed'").join(known.select("project_id", F.col("name").alias("var"), "default"), ["project_id", "var"])
        flag = _flag(F.col("kind"), F.col("define"), F.col("define"), F.col("default"))
        flags = flags.unionByName(valued.select("project_id", F.lit(1).alias("part"), F.col("driving_var").alias("name"), F.col("seq").cast("long").alias("seq"), flag.alias("flag")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "name", "seq", "flag"))), lambda x: x["flag"])
    return flags.groupBy("project_id").agg(F.array_join(ordered, " ").alias("flags"))


def resolve_defines(combos: DataFrame, defines: DataFrame) -> DataFrame:
    """(project_id, combo, define, value) under each combination (project_id, combo, settings MAP).

    Templates are filled with the settings of their {VAR} placeholders; unknown ones stay, and a
    template in which none is known gives no row.  Gated flags are there, with an empty value, where
    the gate's variable has the gate's value.
    """
    joined = combos.join(defines, "project_id")
    entries = F.map_entries("settings")
    filled = F.aggregate(entries, F.col("template"), lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    gate = F.coalesce(F.col("settings")[F.col("gate_var")] == F.coalesce("gate_value", F.lit("true")), F.lit(False))
    value = F.when(F.col("kind") == "gated", F.when(gate, F.lit(""))).otherwise(F.when(filled != F.col("template"), filled))
    return joined.withColumn("value", value).where("value is not null").select("project_id", "combo", "define", "value")


def mutual_exclusion(selected: DataFrame, config_vars: DataFrame) -> DataFrame:
    """(project_id, name, status): for each enum variable one selected feature VAR_value is ok, none is
    missing, more are a conflict."""
    features = config_vars.where("kind = 'Enum'").select("project_id", "name", F.explode("values").alias("value"))
    hits = features.join(selected.select("project_id", "feature", F.lit(1).alias("on")), (features["project_id"] == selected["project_id"]) & (F.concat("name", F.lit("_"), "value") == F.col("feature")), "left")
    return hits.groupBy(features["project_id"], "name").agg(F.count("on").alias("active")).select(
        "project_id", "name", F.when(F.col("active") == 0, "missing").when(F.col("active") > 1, "conflict").otherwise("ok").alias("status")
    )
