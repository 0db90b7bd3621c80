"""Queries of the engine's operators over the given tables, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import jsx, modules, text
from weftline.operators import autofix, catalog, css, scan, validation
from weftline.operators.order import numbered
from weftline.plans import tools
from weftline.sources import derived, files
from weftline.sources.catalog import Catalog, catalog_json, parse_catalog
from weftline.sources.kept import kept, shared_folder
from weftline.streaming import index
from weftline.streaming.sink import IndexTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where it has one."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


_PART = "select p_partkey pos, p_name || '#' || p_partkey name, p_brand description, p_type category, './' || lower(p_type) || '/' || p_partkey import_path, p_size from part"


@query(f"select pos, name, description, category, import_path from ({_PART}) where category = 'ECONOMY' and (lower(name) like '%ring%' or lower(description) like '%ring%')")
def q2_list_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_components(derived.part_components(spark, sf_dir), "ECONOMY", "RING")


@query("select p_type category, count(*) n, min(p_name || '#' || p_partkey) first_name from part group by p_type")
def a1_components_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.components_by_category(derived.part_components(spark, sf_dir))
    return rows.select("category", F.size("components").cast("long").alias("n"), F.get("components", F.lit(0)).alias("first_name"))


@query("select p_type as name, '' description, count(*) + (p_type = 'SMALL')::int component_count from part where p_type <> 'LARGE' group by p_type")
def q1_list_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_categories(derived.part_catalog(spark, sf_dir).categories).select("name", "description", F.col("component_count").cast("long").alias("component_count"))


def _search_sql(keyword: str) -> str:
    return f"""select name, pos, description, category, import_path, reason from (select *, case when lower(name) like '%{keyword}%' then 'name' when lower(description) like '%{keyword}%' then 'description'
        when 'size' || p_size like '%{keyword}%' then 'prop:size' || p_size when lower(split_part(name, '#', 1) || 'Item' || pos) like '%{keyword}%' then 'sub-component:' || split_part(name, '#', 1) || 'Item' || pos end reason
        from ({_PART})) where reason is not null"""


@query(_search_sql("#2"))
def q9_search_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_components(derived.part_components(spark, sf_dir), "#2")


@query(_search_sql("e1"))
def q9_search_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.search_components(derived.part_components(spark, sf_dir), "E1")


@query("""with hit as (select p_name || '#' || p_partkey alias, p_partkey pos, 0 prio from part union all select p_name || 'Item' || p_partkey, p_partkey, 1 from part),
    asked as (select p_name || case when p_partkey % 2 = 0 then '#' else 'Item' end || p_partkey alias from part where p_size < 10)
    select p_partkey pos, p_name || '#' || p_partkey name from part where p_partkey in (select pos from hit join asked using (alias))""")
def q5_component_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = derived.table(spark, sf_dir, "part").where("p_size < 10").selectExpr("p_partkey as at", "concat(p_name, if(p_partkey % 2 = 0, '#', 'Item'), p_partkey) as name")
    return catalog.component_details(derived.part_components(spark, sf_dir), names).select("pos", "name")


@query("select n_name as name, '#' || lpad(n_nationkey::varchar, 3, '0') as value, 'region' || n_regionkey category from nation where n_regionkey = 1")
def q7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_tokens(derived.part_catalog(spark, sf_dir).tokens, "region1").drop("pos")


@query("""select 0 scope, 'in-' || r_name as rule, 'warning' severity from region
    union all select 1, 'use-' || p_type, case when p_size = 1 then 'fatal' else 'info' end from part where p_name || '#' || p_partkey = (select p_name || '#' || p_partkey from part where p_partkey = 7)""")
def q8_guidelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = derived.part_catalog(spark, sf_dir)
    name = parts.components.where("pos = 7").first()["name"]
    return catalog.list_guidelines(parts, name).select("scope", "rule", "severity")


@query("""with c as (select * from part), cat as (select distinct p_type from part where p_type <> 'LARGE')
    select 'catalog version is required' error, '' subject
    union all select 'unknown category', p_name || '#' || p_partkey from c where p_type = 'LARGE'
    union all select 'prop type is required', p_name || '#' || p_partkey || '.size' || p_size from c where p_size % 7 = 0
    union all select 'invalid severity', p_name || '#' || p_partkey || '.use-' || p_type from c where p_size = 1
    union all select 'category lists an unknown component', 'SMALL.nothing'""")
def v1_catalog_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.integrity_errors(derived.part_catalog(spark, sf_dir))


#: One row for each line of an order as it stands on the order's page, with the line of its element.
_LINES = """with raw as (select l.*, 'Brand' || split_part(p_brand, '#', 2) brand, split_part(p_brand, '#', 2)::int n from lineitem l join part on p_partkey = l_partkey
      where l_orderkey in (select o_orderkey from orders)),
    i as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) rn,
      count(*) filter (l_discount >= 0.03) over (partition by l_orderkey) k, count(*) over (partition by l_orderkey) items,
      case when l_linenumber % 2 = 0 then 'Brand1' else brand end || 'Item' child from raw),
    e as (select *, k + 3 + 3 * (rn - 1) + 1 line from i),
    imp as (select l_orderkey, brand, arg_max(case when l_discount < 0.08 then '@/parts/brand' || n else '@/wrong' end, rn) source from i where l_discount >= 0.03 group by all),
    icons as (select distinct l_orderkey, child from i where l_quantity % 2 = 0),
    v as (select l_orderkey page_id, 'deprecated-component' as rule, 'warning' severity, brand component, '' prop, line from e where n % 11 = 0
      union all select l_orderkey, 'missing-import', 'error', brand, '', line from e left join imp using (l_orderkey, brand) where source is null
      union all select l_orderkey, 'wrong-import-path', 'error', brand, '', line from e join imp using (l_orderkey, brand) where source <> '@/parts/brand' || n
      union all select l_orderkey, 'missing-required-prop', 'error', brand, 'quantity', line from e where n % 5 = 0 and l_quantity <= 10
      union all select l_orderkey, 'unknown-prop', 'info', brand, 'ship', line from e where l_linestatus = 'O'
      union all select l_orderkey, 'deprecated-prop', 'warning', brand, 'tax', line from e where l_tax = 0
      union all select l_orderkey, 'invalid-prop-value', 'warning', brand, 'flag', line from e where l_returnflag = 'R'
      union all select l_orderkey, 'composition-violation', 'error', child, '', line + 1 from e where child <> brand || 'Item'
      union all select l_orderkey, 'missing-child', 'error', child, 'Icon', line + 1 from e left join icons using (l_orderkey, child) where icons.child is null
      union all select l_orderkey, 'unknown-component', 'warning', 'Mystery', '', k + 3 + 3 * items + 1 from (select distinct l_orderkey, k, items from i) join orders on o_orderkey = l_orderkey where o_orderstatus = 'P')"""


def _validated(spark: SparkSession, sf_dir: str, auto_fix: bool = False) -> tools.Validation:
    return tools.validate_pages(derived.order_pages(spark, sf_dir), derived.brand_components(spark, sf_dir), auto_fix)


@query(f"{_LINES} select page_id, rule, severity, component, prop, line::int line from v")
def r_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).violations.drop("message", "suggestion")


@query(f"""{_LINES}, c as (select page_id, count(*) filter (severity = 'error') e, count(*) filter (severity = 'warning') w, count(*) filter (severity = 'info') f from v group by page_id),
    p as (select distinct l_orderkey page_id from i)
    select page_id, coalesce(e, 0) errors, coalesce(w, 0) warnings, coalesce(f, 0) infos, coalesce(e, 0) = 0 valid,
      case when coalesce(e + w + f, 0) = 0 then 'no issues found' else concat_ws(', ', case when e > 0 then e || ' error(s)' end, case when w > 0 then w || ' warning(s)' end, case when f > 0 then f || ' info(s)' end) end summary
    from p left join c using (page_id)""")
def a3_page_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).results


@query(f"{_LINES} select page_id, line::int line, component, prop from v where severity = 'error'")
def q12_errors_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.with_severity(_validated(spark, sf_dir).violations, "error").select("page_id", "line", "component", "prop")


@query(f"""{_LINES} select page_id, 'import' kind, min(line)::int line, component, '' as old, '@/parts/' || lower(component) as new from v where rule = 'missing-import' group by page_id, component
    union all select page_id, 'path', line::int, component, '', '@/parts/' || lower(component) from v where rule = 'wrong-import-path'
    union all select page_id, 'value', line::int, component, 'R', 'A' from v where rule = 'invalid-prop-value'""")
def af_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = derived.brand_components(spark, sf_dir)
    return autofix.fix_rows(_validated(spark, sf_dir).violations, components)


@query(f"""{_LINES}, f as (select page_id, 'import' kind, min(line) line, component, '@/parts/' || lower(component) path from v where rule = 'missing-import' group by page_id, component
      union all select page_id, 'path', line, component, '@/parts/' || lower(component) from v where rule = 'wrong-import-path'
      union all select page_id, 'value', line, component, '' from v where rule = 'invalid-prop-value'),
    imps as (select l_orderkey page_id, rn, brand, case when l_discount < 0.08 then '@/parts/brand' || n else '@/wrong' end source from i where l_discount >= 0.03),
    hits as (select f.page_id, f.line, f.component, f.path, min(imps.rn) rn from f join imps on imps.page_id = f.page_id and source <> path and contains('import {{ ' || brand || ' }} from "' || source || '"', component) where kind = 'path' group by all),
    puts as (select page_id, rn, path from (select *, row_number() over (partition by page_id, rn order by line, component) nth from hits) where nth = 1),
    tops as (select page_id, string_agg('import {{ ' || brand || ' }} from "' || coalesce(path, source) || '"', chr(10) order by rn) kept from imps left join puts using (page_id, rn) group by page_id),
    news as (select page_id, string_agg('import {{ ' || component || ' }} from "' || path || '"', chr(10) order by line desc, component desc) added from f where kind = 'import' group by page_id),
    body as (select l_orderkey page_id, string_agg('      <' || brand || ' flag="' || case l_returnflag when 'R' then 'A' else l_returnflag end || '"' || case when l_quantity > 10 then ' quantity={{1 + 1}}' else '' end || case when l_tax = 0 then ' tax' else '' end
        || case when l_linestatus = 'O' then ' ship="O"' else '' end || '>' || chr(10) || '        <' || child || case when l_quantity % 2 = 0 then '><Icon /></' || child || '>' else ' />' end || chr(10) || '      </' || brand || '>', chr(10) order by rn) elements from i group by l_orderkey)
    select page_id, concat_ws(chr(10), kept, added, 'export default function Page() {{', '  return (', '    <>', elements, case when o_orderstatus = 'P' then '      <Mystery />' end, '    </>', '  );', '}}') fixed_code
    from (select distinct page_id from f) join body using (page_id) join orders on o_orderkey = page_id left join tops using (page_id) left join news using (page_id)""")
def af_fixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with all their fixes; a path is put right in the first line that names the component, as its name may begin another's."""
    return _validated(spark, sf_dir, auto_fix=True).fixed.select("page_id", "fixed_code")


@query(f"""{_LINES}, kids as (select l_orderkey, brand component_name, count(*) n from i group by all),
    u as (select l_orderkey page_id, 0 o, rn, brand component_name, line, brand parent from e union all select l_orderkey, 1, rn, child, line + 1, '' from e
      union all select l_orderkey, 2, rn, 'Icon', line + 1, '' from e where l_quantity % 2 = 0
      union all select l_orderkey, 3, 0, 'Mystery', k + 3 + 3 * items + 1, '' from (select distinct l_orderkey, k, items from i) join orders on o_orderkey = l_orderkey where o_orderstatus = 'P'),
    firsts as (select page_id, component_name, min(line) line from u group by all)
    select u.page_id, u.component_name, u.line::int line,
      coalesce(case when firsts.line is null then 0 when u.o = 0 then (select n from kids where kids.l_orderkey = u.page_id and kids.component_name = u.component_name)
        when u.o = 1 then (select count(*) from e where e.l_orderkey = u.page_id and e.child = u.component_name and e.l_quantity % 2 = 0) else 0 end, 0)::bigint children_count
    from u left join firsts on firsts.page_id = u.page_id and firsts.component_name = u.component_name and firsts.line = u.line""")
def an1_children_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.analysis(derived.order_pages(spark, sf_dir)).select("page_id", "component_name", "line", "children_count")


@query(f"{_LINES} select l_orderkey page_id, rn - 1 - (select count(*) from i j where j.l_orderkey = i.l_orderkey and j.rn < i.rn and j.l_discount < 0.03) pos, case when l_discount < 0.08 then '@/parts/brand' || n else '@/wrong' end as source, brand as name from i where l_discount >= 0.03")
def x3_page_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsx.imports(derived.order_pages(spark, sf_dir)).select("page_id", F.col("pos").cast("long").alias("pos"), "source", F.explode("names").alias("name"))


@query("""select 'tsx' ext, lower(p_type) || '/p' || p_partkey || '.tsx' path, 'P' || p_partkey || 'Props' as name, 'interface' kind, true is_exported from part
    union all select 'tsx', lower(p_type) || '/p' || p_partkey || '.tsx', case when p_size % 2 = 0 then 'P' else 'p' end || p_partkey, 'function', true from part
    union all select 'tsx', lower(p_type) || '/p' || p_partkey || '.tsx', 'P' || p_partkey || 'Extra', 'variable', false from part where p_size % 3 = 0""")
def x4_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modules.symbols(modules.modules(derived.part_modules(spark, sf_dir)))
    return rows.select(F.lit("tsx").alias("ext"), "path", "name", "kind", "is_exported")


def _detected(spark: SparkSession, sf_dir: str, tokens: DataFrame | None = None) -> DataFrame:
    rows = modules.modules(derived.part_modules(spark, sf_dir))
    return kept(scan.detected(modules.component_facts(rows), modules.symbol_names(rows, tokens), modules.module_exports(rows)))


@query("""select lower(p_type) || '/p' || p_partkey || '.tsx' path, 'P' || p_partkey as name, 'function' kind, 'P' || p_partkey || 'Props' props_type from part where p_size % 2 = 0
    union all select lower(p_type) || '/p' || p_partkey || '.tsx', 'P' || p_partkey || 'Extra', 'memo', '' from part where p_size % 3 = 0""")
def d1_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select("path", "name", "kind", "props_type")


@query("select lower(p_type) || '/p' || p_partkey || '.tsx' path, 'P' || p_partkey parent, 'P' || p_partkey || 'Extra' as name from part where p_size % 6 = 0")
def c1_compound_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.compound_groups(_detected(spark, sf_dir))


@query("""with c as (select * from part where p_size % 2 = 0)
    select lower(p_type) || '/p' || p_partkey || '.tsx' path, 'P' || p_partkey component, 'size' as name, 'number' as type, true required, p_size::varchar as default, 'Size in mm.' description, '' allowed from c
    union all select lower(p_type) || '/p' || p_partkey || '.tsx', 'P' || p_partkey, 'brand', 'string', false, '', '', p_brand || ',none' from c""")
def p1_component_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modules.modules(derived.part_modules(spark, sf_dir))
    tokens = modules.siblings(rows)
    props = scan.component_props(_detected(spark, sf_dir, tokens), modules.interface_props(rows, tokens), modules.variant_sets(rows, tokens), modules.props_heads(rows))
    return props.select("path", "component", "name", "type", "required", "default", "description", F.array_join("allowed_values", ",").alias("allowed"))


@query("""select min(p_partkey) || 'px' as value, 'chart-' || p_size as name, 'chart' category from part group by p_size
    union all select '#' || lpad((p_partkey % 1000)::varchar, 3, '0'), 'tone-' || p_partkey, 'color' from part
    union all select 'Serif', 'font-' || p_partkey, 'typography' from part""")
def c4_design_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return css.design_tokens(derived.part_styles(spark, sf_dir))


@query("""select name, category, import_path, names, n_props from (select 'P' || p_partkey as name, lower(p_type) category, './' || lower(p_type) || '/p' || p_partkey import_path,
      'P' || p_partkey || case when p_size % 3 = 0 then ',P' || p_partkey || 'Extra' else '' end as names, 2 n_props from part where p_size % 2 = 0
    union all select 'P' || p_partkey || 'Extra', lower(p_type), './' || lower(p_type) || '/p' || p_partkey, 'P' || p_partkey || 'Extra', 0 from part where p_size % 3 = 0 and p_size % 2 = 1)""")
def c3_built_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = scan.scan(derived.part_modules(spark, sf_dir)).components
    return built.select("name", "category", "import_path", F.array_join("imported_names", ",").alias("names"), F.size("props").alias("n_props"))


_CHANGES = """select 'src/u' || user_id || case when user_id % 10 = 0 then '.md' else '.ts' end path, ts, event_id seq, value,
    case event_type when 'view' then 'write' when 'click' then 'create' when 'error' then 'remove' when 'signup' then 'rename' else 'write' end op from events"""


@query(f"""with w as ({_CHANGES}), f as (select * from w where path like '%.ts' and op in ('write', 'create')),
    s as (select *, case when ts - lag(ts) over (partition by path order by ts) <= interval 6 hours then 0 else 1 end fresh from f),
    g as (select *, sum(fresh) over (partition by path order by ts) burst from s)
    select path, max(ts) ts, arg_max(op, ts) op, count(*) events from g group by path, burst""")
def t6_debounced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts with a delay of hours, as the events are minutes apart."""
    return index.debounced(derived.event_changes(spark, sf_dir), "6 hours")


@query(f"select path, arg_max(op, seq) op, max(seq) seq, arg_max(value, seq) as value from ({_CHANGES}) group by path having arg_max(op, seq) in ('write', 'create')")
def t1_latest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.latest_files(derived.event_changes(spark, sf_dir).select("path", "op", "seq", "value")).select("path", "op", "seq", "value")


@query(f"""with c as ({_CHANGES}), f as (select 'Sym' || (seq % 500) fqn, path, seq, value from c)
    select fqn, arg_max(path, seq) path, max(seq) seq, arg_max(value, seq) as value from f group by fqn""")
def t2_symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.event_changes(spark, sf_dir).selectExpr("concat('Sym', seq % 500) as fqn", "path", "seq", "0 as pos", "value")
    return index.symbol_table(rows).select("fqn", "path", "seq", "value")


@query(f"select path, sum(10 * length('f' || seq) + 50 * (seq % 3) + case when seq % 2 = 0 then 20 else 0 end)::bigint // 4 tokens from ({_CHANGES}) group by path")
def a11_token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.event_changes(spark, sf_dir).selectExpr("path", "concat('f', seq) as name", "slice(array('a', 'b'), 1, cast(seq % 3 as int)) as parameters", "if(seq % 2 = 0, 'T', '') as return_type")
    return index.token_estimates(rows)


@query("""with k as (select user_id, count(*) filter (event_type = 'error') e, count(*) filter (event_type = 'signup') w, count(*) filter (event_type = 'view') f from events group by user_id)
    select user_id, case when e + w + f = 0 then 'no issues found' else concat_ws(', ', case when e > 0 then e || ' error(s)' end, case when w > 0 then w || ' warning(s)' end, case when f > 0 then f || ' info(s)' end) end summary from k""")
def a2_severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return derived.table(spark, sf_dir, "events").groupBy("user_id").agg(validation.summary(n("error"), n("signup"), n("view")).alias("summary"))


@query("select doc_id, length(text) - length(replace(text, chr(10), '')) + 1 n_lines, sha256(text) digest from documents")
def f3_lines_and_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.line_count(F.col("text")).alias("n_lines"), text.content_hash(F.col("text")).alias("digest"))


@query("select event_id, case when octet_length(encode(props)) > 9 then 'props_len' else 'props' end as key, case when octet_length(encode(props)) > 9 then octet_length(encode(props))::varchar else props end as value from events")
def f6_sanitized_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "events").select("event_id", text.sanitized_params(F.create_map(F.lit("props"), F.col("props")), 9).alias("_m"))
    return rows.select("event_id", F.explode("_m").alias("key", "value"))


def _seventh(spark: SparkSession, sf_dir: str) -> str:
    """The name of the seventh part's sub-component."""
    return derived.table(spark, sf_dir, "part").where("p_partkey = 7").selectExpr("concat(p_name, 'Item', p_partkey) as name").first()["name"]


@query(f"select pos, name, import_path from ({_PART}) where pos = 7")
def q3_component_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sub-component's name finds its parent."""
    return catalog.get_component(derived.part_components(spark, sf_dir), _seventh(spark, sf_dir)).select("pos", "name", "import_path")


@query("select p_partkey pos, p_name || '#' || p_partkey name from part where p_size < 10 and p_partkey % 2 = 0")
def q4_components_by_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of sub-components find nothing here; repeated requests count once."""
    names = derived.table(spark, sf_dir, "part").where("p_size < 10").selectExpr("p_partkey as at", "concat(p_name, if(p_partkey % 2 = 0, '#', 'Item'), p_partkey) as name")
    return catalog.get_components(derived.part_components(spark, sf_dir), names.union(names)).select("pos", "name")


@query("select 'Size ' || p_size title, p_brand description, '<P' || p_partkey || ' />' code from part where p_partkey = 7")
def q6_component_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    example = F.expr("array(named_struct('title', replace(props[0].name, 'size', 'Size '), 'description', description, 'code', concat('<P', pos, ' />')))")
    return catalog.component_examples(derived.part_components(spark, sf_dir).withColumn("examples", example), _seventh(spark, sf_dir))


@query("select p_name || '#' || p_partkey as name, true is_sub_component, 'size' || p_size prop from part where p_partkey = 7")
def q10_inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspect a sub-component; each has its parent's props here."""
    own = F.transform("sub_components", lambda s: s.withField("props", F.col("props")))
    found = catalog.inspect(derived.part_components(spark, sf_dir).withColumn("sub_components", own), _seventh(spark, sf_dir))
    return found.select("name", "is_sub_component", F.explode("sub_component_props.name").alias("prop"))


@query(f"""with f as (select 'Sym' || (seq % 500) fqn, path, seq from ({_CHANGES}))
    select * from (select fqn, arg_max(path, seq) path, max(seq) seq from f group by fqn) where seq % 2 = 0""")
def q11_found_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The condition is on the last writers."""
    rows = derived.event_changes(spark, sf_dir).selectExpr("concat('Sym', seq % 500) as fqn", "path", "seq", "0 as pos")
    return index.find_symbols(rows, F.col("seq") % 2 == 0).select("fqn", "path", "seq")


@query("""select p_name || '#' || p_partkey component, 'size' || p_size as name, case when p_size % 7 = 0 then 'string' else 'number' end as type, p_size > 25 or p_size % 2 = 0 required, p_size::varchar as default, 'doc' description,
      case p_size % 3 when 0 then '' when 1 then 'a,b' else 'x' end allowed, p_size = 3 deprecated from part
    union all select p_name || '#' || p_partkey, 'tone', 'ReactNode', false, '', '', '', false from part where p_size % 4 = 3""")
def j13_enriched_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Props of the catalog and of cleaned reports; what only a report has is appended."""
    base = derived.part_catalog(spark, sf_dir).props
    props = scan.enriched(base, scan.docgen_rows(derived.part_reports(spark, sf_dir)))
    return props.select("component", "name", "type", "required", "default", "description", F.array_join("allowed_values", ",").alias("allowed"), "deprecated")


@query("""select p_name || '#' || p_partkey component, 'size' || p_size as name, p_size::varchar as default, case p_size % 3 when 0 then '' when 1 then 'a,b' else 'x' end allowed, p_size = 3 deprecated from part
    union all select p_name || '#' || p_partkey, 'tone', '', '', false from part where p_size % 4 = 3""")
def f21_docgen_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan.docgen_rows(derived.part_reports(spark, sf_dir))
    return rows.select("component", "name", "default", F.array_join("allowed_values", ",").alias("allowed"), "deprecated")


_TYPED = "(select lower(p_type) || '/t' || p_partkey || '.tsx' path, p_partkey k, p_size from part)"


@query(f"""select path, 'tone' || k variable, 'tone' as name, 'soft,k' || p_size allowed, 'soft' as default from {_TYPED} union all select path, 'tone' || k, 'size', 'sm,lg', '' from {_TYPED}""")
def p6_variant_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modules.variant_sets(modules.modules(derived.part_variants(spark, sf_dir)))
    return rows.select("path", "variable", "name", F.array_join("allowed_values", ",").alias("allowed"), "default")


@query(f"""with t as (select * from {_TYPED} where p_size % 2 = 0 or p_size % 3 <> 0)
    select path, 'T' || k component, 'label' as name, true required, '' allowed, '' as default from {_TYPED}
    union all select path, 'T' || k, 'tone', false, 'soft,k' || p_size, 'soft' from t union all select path, 'T' || k, 'size', false, 'sm,lg', '' from t""")
def j12_variant_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A set gives props to the component whose props type extends it, or to a file's only component."""
    rows = modules.modules(derived.part_variants(spark, sf_dir))
    tokens = modules.siblings(rows)
    found = kept(scan.detected(modules.component_facts(rows), modules.symbol_names(rows, tokens), modules.module_exports(rows)))
    props = scan.component_props(found, modules.interface_props(rows, tokens), modules.variant_sets(rows, tokens), modules.props_heads(rows))
    return props.select("path", "component", "name", "required", F.array_join("allowed_values", ",").alias("allowed"), "default")


@query(f"select path, 'when' || k as name, 'Key' || p_size as type from {_TYPED} union all select path, 'raw' || k, 'Row' || p_size from {_TYPED} union all select path, 'count' || k, 'number' from {_TYPED} union all select path, 'a', 'string' from {_TYPED}")
def x7_type_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.type_annotations(modules.modules(derived.part_variants(spark, sf_dir))).select("path", "name", "type")


@query(f"""select path, 'C' || k || '.count' || k fqn, 'field' kind, 'private' as scope, 'static' modifiers from {_TYPED} union all select path, 'C' || k || '.load', 'method', '', 'async' from {_TYPED}""")
def x4_class_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members at any indent; what stands inside a method or its parameters is none."""
    rows = modules.symbols(modules.modules(derived.part_variants(spark, sf_dir))).where("kind in ('method', 'field')")
    return rows.select("path", "fqn", "kind", "scope", F.array_join("modifiers", ",").alias("modifiers"))


_SCOPES = """(select *, 1 + length(l1) o2, 2 + length(l1 || l2) o3, 3 + length(l1 || l2 || l3) o4, 4 + length(l1 || l2 || l3 || l4) o5, 5 + length(l1 || l2 || l3 || l4 || l5) o6, 6 + length(l1 || l2 || l3 || l4 || l5 || l6) o7, 7 + length(l1 || l2 || l3 || l4 || l5 || l6 || l7) o8
    from (select lower(p_type) || '/n' || p_partkey || '.ts' path, p_partkey k, p_size s, '// class Fake' || k || ' {}' l1, 'export namespace N' || k || ' {' l2, '  const text' || k || ' = "class Str { }";' l3,
    '  export class K' || k || ' extends Base<Map<string, number>> {' l4, '    private static async load' || k || '({ a, b = ' || s || ' }: Opts' || s || ', cb: (x: Map<string, number>) => void, ...rest: string[]): Promise<Row' || s || '[]> {' l5,
    '      let deep' || k || ' = ' || repeat('{ a: ', s) || '1' || repeat(' }', s) || ';' l6, '      function inner' || k || '(z?: number) { return "}"; }' l7 from part))"""


@query(f"""select path, 'N' || k fqn, 'namespace' kind, '' as scope, '' modifiers, true is_exported, '' parameters, '' types, '' return_type, 2 start_line, 10 end_line, (o2 + 7)::int start_byte, (o8 + 11)::int end_byte from {_SCOPES}
    union all select path, 'N' || k || '.text' || k, 'variable', '', 'const', false, '', '', '', 3, 3, (o3 + 2)::int, (o4 - 1)::int from {_SCOPES}
    union all select path, 'N' || k || '.K' || k, 'class', '', '', true, '', '', '', 4, 9, (o4 + 9)::int, (o8 + 9)::int from {_SCOPES}
    union all select path, 'N' || k || '.K' || k || '.load' || k, 'method', 'private', 'static,async', false, '{{ a, b = ' || s || ' }};cb;...rest', 'Opts' || s || ';(x: Map<string, number>) => void;string[]', 'Promise<Row' || s || '[]>', 5, 8, (o5 + 4)::int, (o8 + 5)::int from {_SCOPES}
    union all select path, 'N' || k || '.K' || k || '.deep' || k, 'variable', '', '', false, '', '', '', 6, 6, (o6 + 6)::int, (o7 - 1)::int from {_SCOPES}
    union all select path, 'N' || k || '.K' || k || '.inner' || k, 'function', '', '', false, 'z', 'number', '', 7, 7, (o7 + 6)::int, (o8 - 1)::int from {_SCOPES}""")
def x4b_nested_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes, signatures and locations of nested declarations."""
    rows = modules.symbols(modules.modules(derived.part_scopes(spark, sf_dir)))
    text = [F.array_join(c, by).alias(n) for c, by, n in (("modifiers", ",", "modifiers"), ("parameters", ";", "parameters"), ("parameter_types", ";", "types"))]
    return rows.select("path", "fqn", "kind", "scope", *text, "is_exported", "return_type", "start_line", "end_line", "start_byte", "end_byte")


@query(f"""select path, (10 * (1 + 4 + 1 + 4 + 4 + 5 + 6 * length(k::varchar)) + 50 * (3 + 1) + 20)::bigint // 4 tokens from {_SCOPES}""")
def a11_module_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the symbols of each module take, their parameters and return types among it."""
    return index.token_estimates(modules.symbols(modules.modules(derived.part_scopes(spark, sf_dir))))


_TYPES = "(select lower(p_type) || '/y' || p_partkey || '.tsx' path, p_partkey k, p_size s, p_brand b from part)"


@query(f"""select path, 'T' || k || 'Props' as owner, 0 pos, 'tone' as name, 'string' as type, true required, 'Tone of ' || b || '.' description, false deprecated, 'a;' || b allowed from {_TYPES}
    union all select path, 'T' || k || 'Props', 1, 'level', 'union', false, '', false, '1;' || s || ';true' from {_TYPES}
    union all select path, 'T' || k || 'Props', 2, 'mixed', '"x" | Row' || s, true, 'use tone' || k, true, '' from {_TYPES}
    union all select path, 'T' || k || 'Props', 3, 'nest', 'object', true, '', false, '' from {_TYPES}
    union all select path, 'T' || k || 'Props', 4, 'list', 'array', true, 'list of ' || k, false, '' from {_TYPES}
    union all select path, 'T' || k || 'Props', 5, 'gen', 'Array', false, '', false, '' from {_TYPES}
    union all select path, 'T' || k || 'Props', 6, 'cb', 'function', true, '', false, '' from {_TYPES}
    union all select path, 'T' || k || 'Props', 7, 'both', 'A' || k || ' & {{ z: string }}', true, '', false, '' from {_TYPES}""")
def p2_prop_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unions, intersections, generics, functions and objects of any depth, with comments of all kinds."""
    rows = modules.interface_props(modules.modules(derived.part_types(spark, sf_dir)))
    return rows.select("path", "owner", "pos", "name", "type", "required", "description", "deprecated", F.array_join("allowed_values", ";").alias("allowed"))


@query(f"""select path, 'T' || k component, 'size' as name, 'string' as type, 's' || s as default, 's' || s || ';lg' allowed from {_TYPES} union all select path, 'T' || k, 'rest', 'unknown', '', '' from {_TYPES}""")
def p4_inline_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Props that a component takes apart, typed by the object type written beside them."""
    rows = modules.modules(derived.part_types(spark, sf_dir))
    tokens = modules.siblings(rows)
    found = kept(scan.detected(modules.component_facts(rows), modules.symbol_names(rows, tokens), modules.module_exports(rows)))
    props = scan.component_props(found, modules.interface_props(rows, tokens), modules.variant_sets(rows, tokens), modules.props_heads(rows), modules.inline_props(rows, tokens))
    return props.select("path", "component", "name", "type", "default", F.array_join("allowed_values", ";").alias("allowed"))


_SCRIPTS = "(select 'n' || s_nationkey || '/s' || s_suppkey || '.js' path, s_suppkey k, s_nationkey n from supplier)"


@query(f"""select path, 'lib-' || n as source, 'a' || k || ':*' as names, 'namespace' as type, true is_external, '' target from {_SCRIPTS}
    union all select path, './s' || k, 'b:b', 'named', false, path from {_SCRIPTS} union all select path, './s' || k, '', 'named', false, path from {_SCRIPTS}
    union all select path, '../z', 'e:e', 'named', false, 'z.js' from {_SCRIPTS}""")
def x5c_commonjs_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = modules.module_imports(modules.modules(derived.supplier_scripts(spark, sf_dir)))
    names = F.array_join(F.transform(F.map_entries("imported"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return rows.select("path", "source", names.alias("names"), "type", "is_external", text.resolved_import(F.col("path"), F.col("source"), ".js").alias("target"))


@query("select lower(p_type) || '/p' || p_partkey || '.tsx' path, 'react' as source, 'named' as type, true is_external from part")
def x5_module_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.module_imports(modules.modules(derived.part_modules(spark, sf_dir))).select("path", "source", "type", "is_external")


@query("""with p as (select lower(p_type) || '/p' || p_partkey || '.tsx' path, p_partkey k, p_size from part)
    select path, 'P' || k || 'Props' as name, 'named' as type, 'interface' kind from p union all select path, case when p_size % 2 = 0 then 'P' else 'p' end || k, 'named', 'function' from p
    union all select path, 'P' || k || 'Extra', 'named', 'const' from p where p_size % 3 = 0""")
def x6_module_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.module_exports(modules.modules(derived.part_modules(spark, sf_dir))).select("path", "name", "type", "kind")


@query(f"""select path, 'default' as name, 'default' as type from {_SCRIPTS} where k % 2 = 0 union all select path, 'x' || k, 'named' from {_SCRIPTS} where k % 2 = 1
    union all select path, 'y', 'named' from {_SCRIPTS} where k % 2 = 1 union all select path, 'g' || k, 'named' from {_SCRIPTS}""")
def x6c_commonjs_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.module_exports(modules.modules(derived.supplier_scripts(spark, sf_dir))).select("path", "name", "type")


_PATHS = """(select event_id, case event_id % 6 when 0 then 'src/' when 1 then 'node_modules/x/' when 2 then 'src/__tests__/' when 3 then '' when 4 then 'dist/' else 'lib/dist/' end || 'f' || user_id
    || case event_id % 7 when 0 then '.ts' when 1 then '.test.ts' when 2 then '.TSX' when 3 then '.js' when 4 then '.md' when 5 then '.mjs' else '.stories.jsx' end path from events)"""


@query(f"""select event_id, path, case when event_id % 7 in (0, 1, 2) then 'TypeScript' when event_id % 7 = 4 then 'Unknown' else 'JavaScript' end as language,
    case when event_id % 7 in (0, 1) then 'TypeScript' when event_id % 7 in (3, 6) then 'JavaScript' else 'Unknown' end watched from {_PATHS}""")
def s11_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return derived.event_paths(spark, sf_dir).select("event_id", "path", files.language(path).alias("language"), files.watched_language(path).alias("watched"))


@query(f"select event_id, path from {_PATHS} where event_id % 6 in (0, 3, 5) and event_id % 7 in (0, 3)")
def s5_scanned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that the globs of a scan take."""
    path = F.col("path")
    return derived.event_paths(spark, sf_dir).where(files.globs_match(path, files.SCAN_INCLUDE) & ~files.globs_match(path, files.SCAN_EXCLUDE))


@query(f"select event_id, path from {_PATHS} where event_id % 6 not in (1, 4) and event_id % 7 in (0, 1, 3, 6)")
def s7_workspace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that the symbol index takes, tests and stories among them."""
    path = F.col("path")
    return derived.event_paths(spark, sf_dir).where(files.globs_match(path, files.SCAN_INCLUDE) & ~files.globs_match(path, files.WORKSPACE_EXCLUDE))


@query("select c_custkey, substring(c_name, 3, 4) part, c_name as whole from customer")
def s13_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode("c_name", "UTF-8")
    part, whole = files.byte_range(content, F.lit(2), F.lit(6)), files.byte_range(content, F.lit(0), F.lit(0))
    return derived.table(spark, sf_dir, "customer").select("c_custkey", part.alias("part"), whole.alias("whole"))


@query(f"select path, ts, op from ({_CHANGES}) where path like '%.ts' and op in ('remove', 'rename')")
def t7_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.removals(derived.event_changes(spark, sf_dir))


@query("""with u as (select distinct user_id, 'src/u' || user_id || case when user_id % 10 = 0 then '.md' else '.ts' end path from events)
    select path, case when user_id % 2 = 0 then 'N' else 'S' end || user_id fqn, user_id % 3 = 0 dirty from u where user_id % 2 = 0 or user_id % 5 <> 0""")
def t3_upserted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files' rows replace theirs, removed files' rows go, and files changed since are marked."""
    users = derived.event_changes(spark, sf_dir).select("path").distinct().withColumn("user", F.regexp_extract("path", "[0-9]+", 0).cast("int"))
    rows = lambda where, prefix: users.where(where).select("path", F.concat(F.lit(prefix), "user").alias("fqn"), F.lit(False).alias("dirty"))
    after = index.upserted(rows("true", "S"), rows("user % 2 = 0", "N"), users.where("user % 5 = 0 and user % 2 <> 0"))
    return index.marked_dirty(after, users.where("user % 3 = 0"))


@query(f"""{_LINES} select l_orderkey page_id, brand component_name, line::int line, true has_children, '' parent_component from e
    union all select l_orderkey, child, (line + 1)::int, l_quantity % 2 = 0, brand from e union all select l_orderkey, 'Icon', (line + 1)::int, false, child from e where l_quantity % 2 = 0
    union all select l_orderkey, 'Mystery', (k + 3 + 3 * items + 1)::int, false, '' from (select distinct l_orderkey, k, items from i) join orders on o_orderkey = l_orderkey where o_orderstatus = 'P'""")
def x1_usages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsx.usages(derived.order_pages(spark, sf_dir)).select("page_id", "component_name", "line", "has_children", "parent_component")


@query("""select row_number() over (order by category, name) - 1 as pos, name, category from (select 'chart-' || p_size as name, 'chart' category from part group by p_size
    union all select 'tone-' || p_partkey, 'color' from part union all select 'font-' || p_partkey, 'typography' from part)""")
def o3_token_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens numbered in their order over all style sheets."""
    return numbered(css.design_tokens(derived.part_styles(spark, sf_dir)), "category", "name").select(F.col("pos").cast("long").alias("pos"), "name", "category")


@query("""select row_number() over (order by name) - 1 as pos, name from (select 'P' || p_partkey as name from part where p_size % 2 = 0 union all select 'P' || p_partkey || 'Extra' from part where p_size % 3 = 0 and p_size % 2 = 1)""")
def o4_catalog_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a built catalog, which is valid, in its order."""
    return scan.scan(derived.part_modules(spark, sf_dir)).components.select(F.col("pos").cast("long").alias("pos"), "name")


@query("select distinct 'Brand' || split_part(p_brand, '#', 2) as name, '@/parts/brand' || split_part(p_brand, '#', 2) import_path from part")
def s2_checked_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog's document, written, read and checked: a valid one is read as it is."""
    components = derived.brand_components(spark, sf_dir)
    row = lambda sql: spark.sql(f"select {sql}")
    listed = components.groupBy("category").agg(F.sort_array(F.collect_list("name")).alias("components")).selectExpr("0 as pos", "category as name", "'' as description", "components")
    none = derived.part_catalog(spark, sf_dir)
    whole = Catalog(row("'brands' as name, '1.0' as version, 'react' as framework, '' as source"), components, listed, none.tokens, none.guidelines)
    return parse_catalog(catalog_json(whole)).components.select("name", "import_path")


_FILES = f"(select event_id, path, case when event_id % 7 = 4 then 'unknown language' when event_id % 11 = 0 then 'no content' when event_id % 13 = 0 then 'no UTF-8' else '' end failure from {_PATHS})"


def _event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files some of which can't be read."""
    return derived.event_paths(spark, sf_dir).selectExpr("event_id", "path", "case when event_id % 11 = 0 then null when event_id % 13 = 0 then unhex('c328') else cast(concat('let a', event_id, ' = 1') as binary) end as content")


@query(f"select path, failure, count(*) n from {_FILES} group by path, failure")
def x8_failed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.file_status(_event_files(spark, sf_dir)).groupBy("path", "failure").agg(F.count("*").alias("n"))


@query(f"select count(*) files, count(*) filter (failure = '') files_indexed, count(*) filter (failure <> '') files_failed, round(count(*) filter (failure = '') / count(*), 9) success_rate from {_FILES}")
def a9_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.range(0)
    return scan.scan_stats(_event_files(spark, sf_dir), none, none, 1000.0).select("files", "files_indexed", "files_failed", F.round("success_rate", 9).alias("success_rate"))


def _symbols_of(changed: DataFrame) -> DataFrame:
    """A symbol for each changed file; files of every fifth change can't be read."""
    return changed.select("path", F.concat(F.lit("S"), "seq").alias("fqn"), (F.col("seq") % 5 == 0).alias("failed"))


@query(f"""with c as (select path, op, seq, seq % 3 = 0 later, regexp_extract(path, '[0-9]+') u from ({_CHANGES})),
    l as (select path, later, max(seq) seq, arg_max(op, seq) op from c group by path, later),
    a as (select path, seq from l where not later and op in ('write', 'create') and seq % 5 <> 0),
    b as (select * from l where later)
    select path, 'S' || b.seq fqn, false dirty from b where op in ('write', 'create') and seq % 5 <> 0
    union all select a.path, 'S' || a.seq, b.path is not null from a left join b using (path) where b.path is null or (b.op in ('write', 'create') and b.seq % 5 = 0)""")
def t6b_durable_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of changes, each of them applied twice: files that fail keep their rows and are dirty."""
    changes = derived.event_changes(spark, sf_dir).select("path", "op", "seq")
    table = IndexTable(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", "path string, fqn string", 8)
    for batch, part in enumerate((changes.where("seq % 3 <> 0"), changes.where("seq % 3 = 0"), changes.where("seq % 3 = 0"))):
        table.apply(part, min(batch, 1), _symbols_of)
    return table.rows().select("path", "fqn", "dirty")


@query("select count(*) files, count(*) filter (p_size % 2 = 0) + count(*) filter (p_size % 3 = 0) components, 2 * count(*) filter (p_size % 2 = 0) props from part")
def a7_scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    code, rows = derived.part_modules(spark, sf_dir), modules.modules(derived.part_modules(spark, sf_dir))
    tokens = modules.siblings(rows)
    found = _detected(spark, sf_dir, tokens)
    props = scan.component_props(found, modules.interface_props(rows, tokens), modules.variant_sets(rows, tokens), modules.props_heads(rows))
    return scan.scan_stats(code, found, props, 1000.0).select("files", "components", "props")


@query("""select category as name, string_agg(name, ',' order by name) components from (select lower(p_type) category, 'P' || p_partkey as name from part where p_size % 2 = 0
    union all select lower(p_type), 'P' || p_partkey || 'Extra' from part where p_size % 3 = 0 and p_size % 2 = 1) group by category""")
def a8_built_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = scan.scan(derived.part_modules(spark, sf_dir)).categories
    return built.select("name", F.array_join("components", ",").alias("components"))


@query("select p_partkey, p_type category, p_brand || '.' || p_size field from part")
def f9_capture_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(".", "p_type", "p_brand", "p_size")
    return derived.table(spark, sf_dir, "part").select("p_partkey", text.capture_name(name).alias("_c")).select("p_partkey", "_c.category", "_c.field")


@query("""select p_partkey, case p_size % 6 when 0 then 'string' when 1 then 'function' when 2 then 'function' when 3 then 'ReactNode' when 4 then 'ReactElement' else p_type end as docgen,
    case p_size % 5 when 0 then 'string' when 1 then 'boolean' when 2 then 'number' when 3 then 'string' else p_type end literal from part""")
def f12_type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("element_at(array('enum', '() => void', '(...args: any[]) => any', 'React.ReactNode', 'React.ReactElement', p_type), cast(p_size % 6 + 1 as int))")
    value = F.expr("element_at(array('\"x\"', 'true', concat('-', p_size), '`t`', p_type), cast(p_size % 5 + 1 as int))")
    return derived.table(spark, sf_dir, "part").select("p_partkey", text.docgen_type(kind).alias("docgen"), text.literal_type(value).alias("literal"))


@query("select user_id, event_id, octet_length(encode('{\"op\":\"' || event_type || '\",\"seq\":' || event_id || '}'))::int response_bytes, octet_length(encode('{\"op\":\"' || event_type || '\",\"seq\":' || event_id || '}')) // 4 tokens from events")
def f7_response_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = text.response_bytes(F.struct(F.col("event_type").alias("op"), F.col("event_id").alias("seq")))
    return derived.table(spark, sf_dir, "events").select("user_id", "event_id", size.alias("response_bytes"), text.token_estimate(size).alias("tokens"))
