"""Engine tables derived from the driver's tables, as SQL that Spark and DuckDB both read.

Each view may use the views before it.  `view(spark, sf_dir, name)` gives one as a DataFrame;
`with_views(sql)` puts the definitions that a DuckDB query needs before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {
    "v_results": """
        select concat('u', user_id) as project_id, event_id % 4 as combo, concat('v', cast(floor(event_id / 4) as bigint) % 13) as filename,
               event_type <> 'error' as passed, event_type = 'signup' as skipped from events""",
    "v_programs": """
        select distinct concat('u', user_id) as project_id, user_id % 11 <> 0 as translated, (user_id % 11 <> 0 and user_id % 7 <> 0) as built,
               case when user_id % 11 = 0 then 'no package' when user_id % 7 = 0 then 'error: build, failed' end as error_message from events""",
    "v_vectors": "select distinct project_id, filename from v_results",
    "v_builds": "select distinct concat('u', user_id) as project_id, event_id % 4 as combo, (user_id + event_id % 4) % 5 <> 0 as built from events",
    "v_judged_vectors": """
        select concat('u', user_id) as project_id, concat('e', event_id) as filename,
               case when event_id % 21 = 0 then '(' when event_id % 3 = 0 then concat('^ *', substring(event_type, 1, 2), '.') else event_type end as pattern,
               event_id % 3 = 0 as is_regex, case when event_id % 17 = 0 then 'overflow' end as has_ub from events""",
    "v_outputs": """
        select concat('u', b.user_id) as project_id, concat('e', b.event_id) as filename, concat('  ', a.event_type, chr(10)) as actual
        from events a join events b on a.event_id = b.event_id + 1""",
    "v_files": """
        select source as project_id, concat('d', lang, '/', case when doc_id % 3 = 0 then 'sub/' else '' end, doc_id, case doc_id % 5 when 0 then '.c' when 1 then '.h' when 2 then '.so' when 3 then '.CC' else '.dll' end) as path,
               doc_id, text, cast({bytes}(text) as bigint) as size from documents""",
    "v_lines": """
        select project_id, concat('f', doc_id % 40) as file, doc_id, cast(seq as bigint) as seq, line from ({lines})""",
    "v_items": """
        select source as project_id, concat('d', doc_id) as file, cast(seq as bigint) as item_seq, coalesce(sum(n) over (partition by doc_id order by seq rows between unbounded preceding and 1 preceding), 0) as start_off, n, item_line from (
            select source, doc_id, seq, cast({bytes}(line) + 1 as bigint) as n, line as item_line from ({lines}))""",
    "v_spans": "select project_id, file, item_seq, cast(start_off as bigint) as start_off, cast(start_off + n - 1 as bigint) as end_off from v_items where n > 1",
    "v_diagnostics": """
        select d.source as project_id, concat('d', d.doc_id) as file, e.event_id as seq, cast(floor(e.value * 10) as bigint) as byte_start,
               cast(floor(e.value * 10) as bigint) + e.event_id % 80 as byte_end from (select *, event_id % (select count(*) from documents) as doc from events) e join documents d on d.doc_id = e.doc""",
    "v_entities": """
        select project_id, file, 0 as pool, item_seq * 2 as entity_seq, start_off, end_off from v_spans
        union all select project_id, file, 0 as pool, item_seq * 2 + 1 as entity_seq, start_off, cast(floor((start_off + end_off) / 2) as bigint) as end_off from v_spans where item_seq % 2 = 1""",
    "v_patches": "select project_id, file, start_off, end_off, item_seq as seq, case when item_seq % 6 = 0 then '' else concat('[', item_seq, ']') end as replacement from v_spans where item_seq % 3 = 0",
    "v_left": "select l_orderkey, l_linenumber, l_quantity as value, l_linestatus as status from lineitem",
    "v_right": """
        select l_orderkey, l_linenumber, case when l_orderkey % 97 = 0 then l_quantity + 1 else l_quantity end as value, case when l_orderkey % 89 = 0 then null else l_linestatus end as status
        from lineitem where l_orderkey % 101 <> 0""",
    "v_features": """
        select distinct concat('p', cast(floor(p_partkey / 23) as bigint)) as project_id, concat(case p_partkey % 3 when 0 then 'BACKEND_' when 1 then 'WORD_SIZE_' else 'ENABLE' end, case when p_partkey % 3 = 2 then concat('X', p_size % 2) else concat('v', p_size % 4) end) as name from part""",
    "v_params": """
        select concat('f', cast(floor(p_partkey / 5) as bigint)) as fn, cast(p_partkey % 5 as bigint) as pos,
               case p_partkey % 12 when 0 then 'int' when 1 then ' double ' when 2 then 'bool' when 3 then 'blob' when 4 then 'unsigned long' when 5 then 'size_t' when 6 then 'int_fast8_t' when 7 then 'char *'
               when 8 then 'const char*' when 9 then 'void *' when 10 then 'const float *' else 'struct pair' end as ty from part""",
    "v_values": "select p_type as ty, cast(row_number() over (partition by p_type order by p_size) - 1 as bigint) as ord, cast(p_size as {string}) as val from (select distinct p_type, p_size from part)",
    "v_fn_params": "select concat('f', cast(floor(p_partkey / 6) as bigint)) as fn, cast(p_partkey % 6 as bigint) as pos, p_type as ty from part",
    "v_usage": "select concat('c', cast(floor(conv_id / 10) as bigint)) as project_id, role as call_kind, cast(length(text) as bigint) as prompt, turn as output, cast(length(text) as bigint) + turn as total from conversations",
    "v_requests": "select concat('c', conv_id) as project_id, turn as seq, text from conversations where role = 'user'",
    "v_responses": "select concat('c', conv_id) as project_id, turn as seq, text from conversations where role = 'assistant'",
    "v_runs": "select concat('k', o_custkey) as project_id, o_orderkey as run_seq, o_orderpriority as tool, o_orderstatus <> 'P' as success, o_orderkey as artifact_id from orders",
    "v_messages": """
        select concat('u', user_id) as project_id, event_id as seq,
               case event_type when 'error' then 'compiler-message' when 'view' then 'compiler-message' when 'click' then 'compiler-artifact' when 'purchase' then 'build-finished' else 'build-script-executed' end as reason,
               case event_type when 'error' then 'error' when 'view' then 'warning' end as level, concat(event_type, ' ', props) as text,
               case when event_type = 'click' and event_id % 3 = 0 then concat('bin', event_id) end as executable, case when event_type = 'purchase' then event_id % 2 = 0 end as success from events""",
    "v_vars": """
        select distinct concat('u', user_id) as project_id, concat('VAR_', event_id % 5) as name, case when event_id % 5 = 4 then 'Boolean' else 'Enum' end as kind, event_id % 5 as k from events where event_id % 5 <> 3""",
    "v_script_lines": """
        select concat('u', user_id) as project_id, event_id,
            case event_type
                when 'click' then concat('set(VAR_', event_id % 5, ' "v', event_id % 3, '" CACHE STRING "doc # (x)") # note')
                when 'view' then concat('option(VAR_', event_id % 5, ' "d(', event_id, ')" ', case when event_id % 2 = 0 then 'ON' else 'OFF' end, ')')
                when 'purchase' then concat('if(VAR_', event_id % 6, ')', chr(10), 'set(A_SOURCES src/a', event_id % 4, '.c', chr(10), ' src/b.c)', chr(10),
                    repeat(concat('if(', case when event_id % 2 = 0 then 'OTHER GREATER 3' else '((((OTHER) AND (X)) OR Y))' end, ')', chr(10)), case when event_id % 10 = 0 then 12 else 1 end),
                    'add_executable(t', event_id % 8, ' ${{A_SOURCES}} main_${{VAR_0}}.c)', chr(10), repeat(concat('endif()', chr(10)), case when event_id % 10 = 0 then 12 else 1 end),
                    'else()', chr(10), 'add_library(l', event_id % 8, ' STATIC src/b.c)', chr(10), 'endif()')
                when 'signup' then concat('if(', case when event_id % 4 = 1 then concat('${{VAR_', event_id % 5, '}}') else concat('VAR_', event_id % 5) end, ' STREQUAL "v1")', chr(10), 'add_compile_definitions(MODE_', event_id % 3, ' -DNAME=${{VAR_', event_id % 5, '}} Q="${{VAR_1}}" C=${{VAR_1}}_${{VAR_2}})', chr(10), 'elseif(VAR_2)', chr(10), 'add_subdirectory(sub/../lib', event_id % 3, ')', chr(10), 'endif()')
                else concat(case when event_id % 97 = 0 then 'list(APPEND C 2' else concat('message("${{B_SOURCES}} ', event_id, '")') end, chr(10), 'set(B_SOURCES x', event_id % 3, '.c)') end as line from events""",
    # Build files in folders that read one another: a line for each event, in one of seven files.
    "v_tree_lines": """
        select concat('u', user_id) as project_id, event_id,
            concat(case event_id % 7 when 2 then 'lib/' when 3 then 'lib/sub/' when 4 then 'v1/' when 5 then 'v2/' when 6 then 'lib/v1/' else '' end, 'CMakeLists.txt') as file,
            case cast(floor(event_id / 7) as bigint) % 13
                when 0 then 'add_subdirectory(lib)' when 1 then 'add_subdirectory(sub)' when 2 then 'add_subdirectory("../lib")' when 3 then 'add_subdirectory(${{VAR_1}})'
                when 4 then concat('set(A_SOURCES main_${{VAR_0}}.c a', event_id % 3, '.c)') when 5 then concat('set(B_SOURCES ../x', event_id % 3, '.c "b.c")')
                when 6 then concat('add_executable(t', event_id % 5, ' ${{A_SOURCES}} b.c)') when 7 then concat('if(VAR_0)', chr(10), 'add_library(l', event_id % 4, ' STATIC ${{B_SOURCES}} main_${{VAR_0}}.c)', chr(10), 'endif()')
                when 8 then case when event_id % 2 = 0 then 'set(P "${{VAR_0}}_${{VAR_1}}")' else 'set(VAR_0 "${{VAR_1}}.${{VAR_2}}")' end
                when 9 then concat('set(CMAKE_C_FLAGS "-DX', event_id % 3, '=${{P}} -DY=${{VAR_0}} DW=${{VAR_0}} -DZ=${{VAR_0}}${{VAR_2}}")')
                when 10 then concat('if(${{VAR_1}} STREQUAL "v1")', chr(10), 'add_definitions(-DTAG', event_id % 2, ' -DN=${{VAR_2}} C=${{VAR_0}}${{VAR_1}})', chr(10), 'target_compile_definitions(t PRIVATE TAG', event_id % 2, ' X=1)', chr(10), 'endif()')
                when 11 then 'add_compile_definitions(-DQ="${{VAR_0}}" R=${{VAR_1}} S=${{VAR_0}}-${{VAR_2}} FLAG)'
                else concat('set(VAR_', event_id % 3, ' "v', event_id % 2, '" CACHE STRING "doc")', chr(10), 'option(VAR_2 "doc" ', case event_id % 3 when 0 then 'ON' when 1 then 'NO' else 'MAYBE' end, ')') end as line from events""",
    "v_tree_scripts": "select project_id, file, {agg} as text from v_tree_lines group by project_id, file",
    "v_tree_vars": """
        select distinct concat('u', user_id) as project_id, concat('VAR_', k) as name, ord, case when k = 2 then 'true' when k = 0 then case ord when 0 then 'alpha' else 'beta' end else concat('v', ord + 1) end as value
        from (select user_id, event_id % 3 as k, 0 as ord from events where event_id % 11 <> 0 union all select user_id, event_id % 3, 1 from events where event_id % 3 <> 2 and event_id % 11 <> 0) x""",
    "v_tree_files": """
        select project_id, file as path from v_tree_scripts union
        select concat('u', user_id), concat(case event_id % 3 when 0 then '' when 1 then 'lib/' else 'v1/' end, case cast(floor(event_id / 3) as bigint) % 7 when 0 then 'main_alpha.c' when 1 then 'main_beta.c' when 2 then 'main_alpha.h' when 3 then 'b.c' when 4 then 'x1.c' when 5 then 'x2.c' else 'a0.c' end) from events""",
    "v_scripts": "select project_id, 'CMakeLists.txt' as file, {agg} as text from v_script_lines group by project_id",
}


def _fill(sql: str, spark: bool) -> str:
    lines = (
        "select source, doc_id, source as project_id, seq, line from documents lateral view posexplode(split(text, '\\n')) t as seq, line"
        if spark
        else "select source, doc_id, source as project_id, unnest(range(len(string_split(text, chr(10))))) as seq, unnest(string_split(text, chr(10))) as line from documents"
    )
    return sql.format(bytes="octet_length" if spark else "strlen", string="string" if spark else "varchar", lines=lines, agg="listagg(line, chr(10)) within group (order by event_id)" if spark else "string_agg(line, chr(10) order by event_id)")


def _needs(sql: str) -> list[str]:
    """Views that a query uses, in order of definition."""
    wanted: set[str] = set()
    queue = [sql]
    while queue:
        for name in set(re.findall(r"\bv_\w+", queue.pop())) & set(VIEWS) - wanted:
            wanted.add(name)
            queue.append(VIEWS[name])
    return [name for name in VIEWS if name in wanted]


def _prefix(sql: str, spark: bool) -> str:
    return ", ".join(f"{name} as ({_fill(VIEWS[name], spark)})" for name in _needs(sql))


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it uses; `sql` may begin with further CTEs (`with ...`)."""
    prefix, body = _prefix(sql, spark=False), sql.strip()
    if not prefix:
        return body
    recursive = re.match(r"with\s+recursive\s", body)
    if recursive:
        return f"with recursive {prefix}, {body[recursive.end():]}"
    return f"with {prefix}, {body[5:]}" if body.startswith("with ") else f"with {prefix} {body}"


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Spark SQL over the driver's tables and the views."""
    prefix = _prefix(sql, spark=True)
    used = [t for t in TABLES if re.search(rf"\b{t}\b", prefix + sql)]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    text = f"with {prefix} {sql}" if prefix else sql
    text = text.replace("${", "$' || '{")  # in literals only; Spark would take it for a variable
    for t in used:  # tables by name, as arguments of this one statement
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(_double(text, used), **tables)


def _double(text: str, used: list[str]) -> str:
    """Braces that aren't a table's are doubled for the argument formatter."""
    parts = re.split(r"(\{(?:%s)\})" % "|".join(used), text)
    return "".join(p if k % 2 else p.replace("{", "{{").replace("}", "}}") for k, p in enumerate(parts))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return query(spark, sf_dir, f"select * from {name}")