"""Queries of the staging, join, aggregation, resolution, path, export and text operators, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.functions import labels as L
from loomgraph.functions import paths
from loomgraph.operators import pattern as P
from loomgraph.operators import resolve as R
from loomgraph.operators import staging as S
from loomgraph.plans.graph_queries import E, N, _count, graph, query
from loomgraph.plans.nlq import QUESTIONS, ask
from loomgraph.schema import content_hash, edge_type, symbol_id
from loomgraph.session import load
from loomgraph.sources import extract, files, metadata, sinks

_BS = "chr(92)"
_MODULES = ["id", "name", "type", "file_path", "parent_id", "visibility", "return_type"]


@query(f"with {N} select id, name, type, file_path, parent_id, visibility, return_type from n")
def k01_upsert_last(spark, d):
    s = load(spark, d, "symbols").where("id is not null").select(*_MODULES, "updated_at")
    return S.upsert_last(s, ["id"], ["updated_at"]).select(*_MODULES)


@query("select min(id) as id, source_id, target_id, reference_type, line_number, column_number from symbol_references group by all")
def k02_insert_first(spark, d):
    r = load(spark, d, "symbol_references").select("id", "source_id", "target_id", "reference_type", "line_number", "column_number")
    return S.insert_first(r, S.edge_keys(), ["id"])


@query("""select id, source_id, target_id, upper(reference_type) as reference_type, line_number, column_number from
(select *, row_number() over (partition by source_id, target_id, line_number, column_number order by id) as rn from symbol_references) where rn = 1""")
def k02_insert_first_legacy(spark, d):
    r = load(spark, d, "symbol_references").select("id", "source_id", "target_id", F.upper("reference_type").alias("reference_type"), "line_number", "column_number")
    return S.insert_first(r, S.edge_keys(False), ["id"])


@query("select min(id) as id, config_file, config_key, class_name from config_references group by all")
def k03_config_first(spark, d):
    c = load(spark, d, "config_references").select("id", "config_file", "config_key", "class_name")
    return S.insert_first(c, ["config_file", "config_key", "class_name"], ["id"])


_FILES = """cf as (select file_path, content from (select *, row_number() over (partition by file_path order by fetched_at desc nulls last, content desc) as rn from source_files where file_path is not null) where rn = 1),
h as (select file_path, hash from (select *, row_number() over (partition by file_path order by last_parsed desc nulls last, hash desc nulls last) as rn from file_hashes) where rn = 1),
stale as (select cf.file_path, md5(cf.content) as new_hash, h.hash as stored_hash from cf left join h using (file_path) where cf.content is not null and h.hash is distinct from md5(cf.content))"""


def _current(spark, d) -> DataFrame:
    s = load(spark, d, "source_files").where("file_path is not null").select("file_path", "content", "fetched_at")
    return S.upsert_last(s, ["file_path"], ["fetched_at"])


@query(f"with {_FILES} select * from stale")
def i01_needs_parsing(spark, d):
    return S.needs_parsing(_current(spark, d), load(spark, d, "file_hashes"))


@query(f"with {_FILES} select file_path, hash from h where file_path not in (select file_path from stale) union all select file_path, new_hash from stale")
def k04_replace_files(spark, d):
    h = load(spark, d, "file_hashes")
    stored = S.upsert_last(h.select("file_path", "hash", "last_parsed"), ["file_path"], ["last_parsed"]).select("file_path", "hash")
    return S.replace_files(stored, S.needs_parsing(_current(spark, d), h).select("file_path", F.col("new_hash").alias("hash")))


@query(f"with {N}, {_FILES} select n.file_path, count(*) as symbols from n join stale using (file_path) group by 1")
def i02_symbols_to_replace(spark, d):
    stale = S.needs_parsing(_current(spark, d), load(spark, d, "file_hashes")).select("file_path")
    return _count(graph(spark, d).nodes.select("file_path").join(stale, "file_path"), "file_path", name="symbols")


@query(f"""with {N}, q as (select replace(replace(coalesce(x, ''), {_BS}, {_BS} || {_BS}), '''', {_BS} || '''') as v, x from (select '' as x)),
esc as (select *, {', '.join(f"replace(replace({c}, {_BS}, {_BS} || {_BS}), '''', {_BS} || '''') as q_{c}" for c in ('id', 'name', 'type', 'file_path', 'namespace', 'visibility'))} from n)
select 'CREATE (:' || case when type = 'file' then 'File' when type = 'directory' then 'Directory' when coalesce(type, '') = '' then 'Symbol' else 'Symbol:' || type end || ' {{' ||
concat_ws(', ', {', '.join(f"'{c}: ''' || q_{c} || ''''" for c in ('id', 'name', 'type', 'file_path', 'namespace', 'visibility'))}, 'line_number: ' || line_number) || '}});' as line from esc""")
def k06_script_nodes(spark, d):
    return sinks.script_nodes(graph(spark, d).nodes)


@query(f"""with {E} select 'MATCH (s {{id: ''' || replace(replace(coalesce(src, ''), {_BS}, {_BS} || {_BS}), '''', {_BS} || '''') || '''}}), (t {{id: ''' || replace(replace(coalesce(dst, ''), {_BS}, {_BS} || {_BS}), '''', {_BS} || '''') || '''}}) CREATE (s)-[:' || type || ']->(t);' as line from e""")
def k06_script_edges(spark, d):
    return sinks.script_edges(graph(spark, d).edges)


_GROUP = "case type when 'class' then 'PHPClass' when 'interface' then 'PHPInterface' when 'trait' then 'PHPTrait' when 'method' then 'PHPMethod' when 'property' then 'PHPProperty' when 'function' then 'PHPFunction' when 'constant' then 'PHPConstant' when 'namespace' then 'PHPNamespace' when 'file' then 'File' when 'directory' then 'Directory' end"


@query(f"""with {N}, l as (select *, {_GROUP} as g from n) select id as "id:ID", name, type, coalesce(file_path, '') as file_path, coalesce(line_number, 0) as "line_number:int", coalesce(namespace, '') as namespace, coalesce(visibility, '') as visibility, 'Symbol;' || g as ":LABEL", g as label from l where g is not null""")
def k08_csv_nodes(spark, d):
    return sinks.csv_nodes(graph(spark, d).nodes)


@query(f"""with {E} select src as ":START_ID", dst as ":END_ID", coalesce(line_number, 0) as "line:int", coalesce(column_number, 0) as "column:int", type as ":TYPE", type from e""")
def k09_csv_edges(spark, d):
    return sinks.csv_edges(graph(spark, d).edges)


@query(f"""with {N}, o as (select * from (select id, visibility, return_type, namespace, row_number() over (partition by id order by updated_at, visibility nulls first, return_type nulls first, namespace nulls first) as rn from symbols) where rn = 1)
select n.id, coalesce(n.visibility, o.visibility) as visibility, coalesce(n.return_type, o.return_type) as return_type, coalesce(n.namespace, o.namespace) as namespace from n join o using (id)""")
def k13_merge_nodes(spark, d):
    s = load(spark, d, "symbols").where("id is not null").select("id", "visibility", "return_type", "namespace", "updated_at")
    old, new = S.insert_first(s, ["id"], ["updated_at"]), S.upsert_last(s, ["id"], ["updated_at"])
    return S.merge_props(old.drop("updated_at"), new.drop("updated_at"))


@query(f"with {E} select src, dst, type, max(eid) as eid, arg_max(line_number, eid) as line_number from e group by 1, 2, 3")
def k14_merge_edges(spark, d):
    return S.merge_edges(graph(spark, d).edges).select("src", "dst", "type", "eid", "line_number")


@query(f"with {N} select id, name, exists (select 1 from config_references c where c.class_name = n.name) as requires_registration from n where type = 'class'")
def k17_set_on_match(spark, d):
    known = load(spark, d, "config_references").select(F.col("class_name").alias("name"), F.lit(True).alias("hit")).distinct()
    n = graph(spark, d).node("class").join(known, "name", "left").withColumn("requires_registration", F.lit(False))
    return S.set_where(n, "requires_registration", F.lit(True), F.col("hit")).select("id", "name", "requires_registration")


@query(f"""with {N}, {E} select case when e.type = 'CONTAINS' and s.type = 'file' and t.type in ('class', 'interface', 'trait', 'directory') then 'DEFINES' else e.type end as type, count(*) as n from e left join n s on s.id = e.src left join n t on t.id = e.dst group by 1""")
def k18_rewrite_type(spark, d):
    g = graph(spark, d)
    return _count(S.rewrite_type(g.edges, g.nodes, "CONTAINS", "DEFINES", ["file"], ["class", "interface", "trait", "directory"]), "type")


@query("select id, count(*) as n from symbols group by 1 having count(*) > 1")
def k19_duplicate_ids(spark, d):
    return S.duplicate_keys(load(spark, d, "symbols"), ["id"])


@query(f"with {N}, {E} select e.type, count(*) as edges, count(*) filter (s.id is null or t.id is null) as skipped from e left join n s on s.id = e.src left join n t on t.id = e.dst group by 1")
def k20_skipped_edges(spark, d):
    g = graph(spark, d)
    return S.skipped_edges(g.edges, g.nodes)


@query(f"with {N}, {E} select e.eid, e.src, e.dst, e.type from e where exists (select 1 from n where n.id = e.src) and exists (select 1 from n where n.id = e.dst)")
def j04_valid_edges(spark, d):
    g = graph(spark, d)
    return S.valid_edges(g.edges, g.nodes).select("eid", "src", "dst", "type")


@query(f"with {N}, {E} select s.name as source, e.type, t.name as target, e.line_number from e join n s on s.id = e.src join n t on t.id = e.dst where e.type in ('EXTENDS', 'IMPLEMENTS', 'USES_TRAIT', 'THROWS')")
def j02_reference_listing(spark, d):
    g = graph(spark, d)
    r = P.expand1(g, "EXTENDS", "IMPLEMENTS", "USES_TRAIT", "THROWS").join(g.edges.select("eid", "line_number"), "eid")
    return r.select(F.col("s_name").alias("source"), F.col("r_type").alias("type"), F.col("t_name").alias("target"), "line_number")


_ENDS = f"""c as (select id as class_id, lower(replace(list_extract(string_split(name, {_BS}), -1), 'Controller', '')) as base from n where type = 'class' and lower(name) like '%controller'),
m as (select parent_id as class_id, id as method_id, lower(substr(name, 6)) as act from n where type = 'method' and lower(name) like 'fetch%'),
ends as (select c.class_id, m.method_id, base || '/action/' || act as key, base || '/' || act as short_key from c join m using (class_id))"""


@query(f"with {N}, {_ENDS} select * from ends")
def j05_endpoints(spark, d):
    return R.endpoints(graph(spark, d).nodes, "Controller", "fetch")


@query(f"""with {N}, {_ENDS}, calls as (select method_id as call_id, short_key as key from ends union all select 'x_' || method_id, key from ends),
f as (select key, max(method_id) as m from ends group by 1), s as (select short_key as key, max(method_id) as m from ends group by 1)
select call_id, coalesce(f.m, s.m) as method_id from calls left join f using (key) left join s using (key) where coalesce(f.m, s.m) is not null""")
def j05_link_calls(spark, d):
    ends = R.endpoints(graph(spark, d).nodes, "Controller", "fetch")
    calls = ends.select(F.col("method_id").alias("call_id"), F.col("short_key").alias("key"))
    return R.link_calls(calls.unionByName(ends.select(F.concat(F.lit("x_"), "method_id").alias("call_id"), "key")), ends)


@query(f"""with {N}, f as (select file_path, min(id) as file_id from n where type = 'file' group by 1) select file_id, id as symbol_id from n join f using (file_path) where id not like 'file\\_%' escape '\\' and id not like 'dir\\_%' escape '\\'""")
def j06_file_links(spark, d):
    return R.file_links(graph(spark, d).nodes)


@query(f"with {N} select c.id as class_id, m.id as method_id from n c join n m on c.file_path = m.file_path and c.namespace is not distinct from m.namespace where c.type = 'class' and m.type = 'method'")
def j07_defines_repair(spark, d):
    return R.defines_repair(graph(spark, d).nodes)


@query(f"""with s as (select * from (select *, row_number() over (partition by id order by updated_at desc) as rn from symbols) where rn = 1) select id, name, unnest(from_json(implements, '["VARCHAR"]')) as interface from s where type in ('class', 'trait') and implements is not null""")
def j10_implements(spark, d):
    s = S.upsert_last(load(spark, d, "symbols").where("id is not null").select("id", "name", "type", "implements", "updated_at"), ["id"], ["updated_at"])
    return s.where("type in ('class', 'trait')").select("id", "name", F.explode(F.from_json("implements", "array<string>")).alias("interface"))


@query(f"""with {N}, {E}, u as (select src as id, dst as o from e where type = 'THROWS' union all select dst, src from e where type = 'THROWS' and src <> dst) select id, count(*) as n from u group by 1""")
def j15_undirected(spark, d):
    e = graph(spark, d).edge("THROWS")
    return _count(P._oriented(e, "both").select(F.col("a").alias("id")), "id")


@query(f"with {N}, {E} select label, cast(sum(c) as bigint) as n from (select n.label, e.type as t, count(*) as c from e join n on n.id = e.src join n b on b.id = e.dst group by 1, 2) group by 1")
def a07_sum_of_counts(spark, d):
    r = P.expand1(graph(spark, d)).groupBy(F.col("s_label").alias("label"), "r_type").agg(F.count("*").alias("c"))
    return r.groupBy("label").agg(F.sum("c").alias("n"))


@query(f"with {N} select count(distinct file_path) as files, count(distinct name) as names, count(distinct namespace) as namespaces from n")
def a08_count_distinct(spark, d):
    return graph(spark, d).nodes.agg(F.countDistinct("file_path").alias("files"), F.countDistinct("name").alias("names"), F.countDistinct("namespace").alias("namespaces"))


@query(f"""with {N}, {E}, o as (select src as id, count(*) as c from e group by 1), i as (select dst as id, count(*) as c from e group by 1)
select n.id, coalesce(o.c, 0) as out_degree, coalesce(i.c, 0) as in_degree from n left join o using (id) left join i using (id)""")
def a09_degrees(spark, d):
    return P.degrees(graph(spark, d))


@query(f"with {N}, s as (select regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1) as extension from n where type = 'file') select extension, count(*) as n from s group by 1 order by 2 desc, 1 limit 10")
def a13_extensions(spark, d):
    n = graph(spark, d).node("File").select(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1).alias("extension"))
    return _count(n, "extension").orderBy(F.desc("n"), "extension").limit(10)


@query(f"""with {N}, {E} select count(*) as edges, (select count(*) from n) as nodes, round(count(*) / (select count(*) from n), 6) as edges_per_node, round(count(*) filter (t.id is null) / count(*), 6) as unresolved_rate from e left join n t on t.id = e.dst""")
def a14_ratios(spark, d):
    g = graph(spark, d)
    e = g.edges.join(g.nodes.select(F.col("id").alias("dst"), F.lit(1).alias("hit")), "dst", "left").agg(F.count("*").alias("edges"), F.count("hit").alias("hits"))
    e = e.withColumn("nodes", g.nodes.agg(F.count("*")).scalar())
    return e.select("edges", "nodes", F.round(F.col("edges") / F.col("nodes"), 6).alias("edges_per_node"), F.round((F.col("edges") - F.col("hits")) / F.col("edges"), 6).alias("unresolved_rate"))


# Least counts of edge types that a complete load shows.
EXPECTED = {"EXTENDS": 1, "IMPLEMENTS": 1, "USES_TRAIT": 2, "IMPORTS": 3, "THROWS": 3, "USES_CONSTANT": 4, "CALLS": 5, "CALLS_STATIC": 1, "INSTANTIATES": 2, "ACCESSES": 3, "PARAMETER_TYPE": 3, "RETURNS": 1, "INSTANCEOF": 1}


@query(f"""with {E}, x(type, least) as (values {', '.join(f"('{k}', {v})" for k, v in EXPECTED.items())}), c as (select type, count(*) as n from e group by 1) select x.type, x.least, coalesce(c.n, 0) as n, coalesce(c.n, 0) >= x.least as passed from x left join c using (type)""")
def a15_thresholds(spark, d):
    x = spark.createDataFrame(list(EXPECTED.items()), "type string, least int")
    n = F.coalesce("n", F.lit(0))
    return x.join(_count(graph(spark, d).edges, "type"), "type", "left").select("type", "least", n.alias("n"), (n >= F.col("least")).alias("passed"))


# config classes written in five ways: absolute, imported, in the own namespace, full, and short
_WRITTEN = f"""cr as (select id, class_name as c, list_extract(string_split(class_name, {_BS}), -1) as short, array_to_string(string_split(class_name, {_BS})[1:-2], {_BS}) as ns, id % 5 as v from config_references),
cs as (select * from (select *, row_number() over (partition by id order by updated_at desc) as rn from symbols where id is not null) where rn = 1),
refs as (select distinct cast(id as varchar) as ref_id, case v when 0 then {_BS} || c when 3 then c else short end as name, case when v = 2 then ns end as namespace, case when v = 1 then [c] end as imports from cr)"""
_CLASSREFS = f"""cs as (select * from (select *, row_number() over (partition by id order by updated_at desc) as rn from symbols where id is not null) where rn = 1),
refs as (select id as ref_id, extends as name, namespace, from_json(uses, '["VARCHAR"]') as imports from cs where extends is not null and type = 'class')"""
_RESOLVED = f"""cand as (
  select ref_id, 1 as prio, ltrim(name, {_BS}) as key from refs where starts_with(name, {_BS})
  union all select ref_id, 2, list_filter(imports, lambda i: lower(list_extract(string_split(i, {_BS}), -1)) = lower(string_split(name, {_BS})[1]))[1] || case when contains(name, {_BS}) then {_BS} || substr(name, instr(name, {_BS}) + 1) else '' end from refs where not starts_with(name, {_BS})
  union all select ref_id, 3, namespace || {_BS} || name from refs where not starts_with(name, {_BS}) and coalesce(namespace, '') <> ''
  union all select ref_id, 4, name from refs where not starts_with(name, {_BS})),
known as (select id, name from cs where type in ('class', 'interface', 'trait', 'function', 'namespace', 'enum')),
hits as (select c.ref_id, c.prio, k.id from cand c join known k on k.name = c.key
  union all select r.ref_id, 5, k.id from refs r join known k on contains(k.name, {_BS}) and lower(list_extract(string_split(k.name, {_BS}), -1)) = lower(r.name) where not contains(r.name, {_BS})),
best as (select ref_id, prio, id, row_number() over (partition by ref_id order by prio, id) as rn from hits)"""


def _class_refs(spark, d) -> tuple[DataFrame, DataFrame]:
    s = load(spark, d, "symbols").where("id is not null").select("id", "name", "type", "namespace", "extends", "uses", "parent_id", "updated_at")
    now = S.upsert_last(s, ["id"], ["updated_at"])
    refs = now.where("extends is not null and type = 'class'").select(F.col("id").alias("ref_id"), F.col("extends").alias("name"), "namespace", F.from_json("uses", "array<string>").alias("imports"))
    return refs, now


def _written(spark, d) -> tuple[DataFrame, DataFrame]:
    cr = load(spark, d, "config_references").select("id", F.col("class_name").alias("c"), F.substring_index("class_name", "\\", -1).alias("short"), (F.col("id") % 5).alias("v"))
    cr = cr.withColumn("ns", F.expr("substring(c, 1, length(c) - length(short) - 1)"))
    v = F.col("v")
    refs = cr.select(
        F.col("id").cast("string").alias("ref_id"), F.when(v == 0, F.concat(F.lit("\\"), "c")).when(v == 3, F.col("c")).otherwise(F.col("short")).alias("name"),
        F.when(v == 2, F.col("ns")).alias("namespace"), F.when(v == 1, F.array("c")).alias("imports"),
    )
    return refs.distinct(), _class_refs(spark, d)[1]


@query(f"with {_WRITTEN}, {_RESOLVED} select ref_id, id as target_id, cast(prio as integer) as prio from best where rn = 1")
def r01_resolve(spark, d):
    return R.resolve(*_written(spark, d))


@query("""select distinct nullif(case when lower(regexp_replace(regexp_replace(return_type, '^\\?', ''), '(\\[\\])+$', '')) in ('int', 'string', 'bool', 'float', 'array', 'object', 'void', 'mixed', 'null', 'resource', 'callable') then null else regexp_replace(regexp_replace(return_type, '^\\?', ''), '(\\[\\])+$', '') end, '') as type_name, return_type from symbols where return_type is not null""")
def r02_clean_types(spark, d):
    return load(spark, d, "symbols").where("return_type is not null").select(R.clean_type("return_type").alias("type_name"), "return_type").distinct()


@query(f"""with {_WRITTEN}, {_RESOLVED}, m as (select parent_id, name, min(id) as member_id from cs where type = 'method' group by 1, 2)
select b.ref_id || ':' || m.name as ref_id, m.member_id from best b join m on m.parent_id = b.id where b.rn = 1""")
def r03_members(spark, d):
    refs, now = _written(spark, d)
    best = R.resolve(refs, now)
    called = best.join(now.where("type = 'method'").select(F.col("parent_id").alias("target_id"), F.col("name").alias("method")).distinct(), "target_id")
    calls = called.select(F.concat_ws(":", "ref_id", "method").alias("ref_id"), "method", "target_id", "prio")
    return R.members(calls.select("ref_id", "method"), calls.select("ref_id", "target_id", "prio"), now, "method", "method")


@query(f"""with {_CLASSREFS}, {_RESOLVED}, lost as (select distinct ltrim(name, {_BS}) as name from refs where ref_id not in (select ref_id from best))
select 'external_' || md5(name) as id, name, case when contains(name, 'Interface') then 'interface' when contains(name, 'Trait') then 'trait' else 'class' end as type, '<external>' as file_path from lost""")
def r05_externals(spark, d):
    refs, now = _class_refs(spark, d)
    return R.externals(refs, R.resolve(refs, now))


@query(f"with {_CLASSREFS}, {_RESOLVED} select 'extends' as kind, count(*) as n, count(distinct name) as names from refs where ref_id not in (select ref_id from best)")
def r07_unresolved(spark, d):
    refs, now = _class_refs(spark, d)
    return R.unresolved_report(refs.withColumn("kind", F.lit("extends")), R.resolve(refs, now))


_PATHS = f"""p as (select distinct replace(file_path, {_BS}, '/') as p from source_files where file_path is not null)"""


@query(f"""with {_PATHS}, k as (select * from p where not regexp_matches(p, '/(\\.[^/]*|vendor|node_modules)/')),
parts as (select p, string_split(p, '/') as s from k), dirs as (select distinct array_to_string(s[1:i], '/') as p from (select s, unnest(range(2, len(s))) as i from parts)),
f as (select p from k where lower(regexp_extract(p, '\\.([^./]+)$', 1)) in ('php', 'js', 'jsx', 'ts', 'tsx', 'json', 'yml', 'yaml', 'xml', 'html', 'css', 'scss')),
u as (select 'dir_' as pre, 'directory' as type, p from dirs union all select 'file_', 'file', p from f), w as (select *, array_to_string(string_split(p, '/')[1:-2], '/') as up from u)
select pre || md5(p) as id, list_extract(string_split(p, '/'), -1) as name, type, p as file_path, case when up <> '' then 'dir_' || md5(up) end as parent_id from w""")
def s01_structure(spark, d):
    return files.structure(load(spark, d, "source_files"))


@query(f"""with {_PATHS} select p as file_path, regexp_matches(p, '/(node_modules|vendor)/') as skipped_js, lower(regexp_extract(p, '\\.([^./]+)$', 1)) as extension,
lower(regexp_extract(p, '\\.([^./]+)$', 1)) in ('js', 'jsx', 'mjs', 'ts', 'tsx') and not regexp_matches(p, '/(node_modules|vendor)/') as js, lower(regexp_extract(p, '\\.([^./]+)$', 1)) in ('ts', 'tsx') and not regexp_matches(p, '/(node_modules|\\.next|dist|build|out)/') and not regexp_matches(p, '/\\.[^/]+/') as ts,
lower(regexp_extract(p, '\\.([^./]+)$', 1)) = 'py' and not regexp_matches(p, '/(__pycache__|venv|env|\\.venv|node_modules|vendor)/') as py, lower(regexp_extract(p, '\\.([^./]+)$', 1)) = 'php' as php from p""")
def s05_discovery(spark, d):
    p = load(spark, d, "source_files").where("file_path is not null").select(paths.norm("file_path").alias("file_path")).distinct()
    c = F.col("file_path")
    return p.select("file_path", c.rlike("/(node_modules|vendor)/").alias("skipped_js"), paths.extension(c).alias("extension"), *[paths.discovered(c, x).alias(x) for x in ("js", "ts", "py", "php")])


@query("select id, source_id, target_id, line_number from symbol_references where upper(replace(reference_type, '-', '_')) = 'INSTANCEOF'")
def s12_edges_of_type(spark, d):
    return load(spark, d, "symbol_references").where(edge_type() == "INSTANCEOF").select("id", "source_id", "target_id", "line_number")


@query(f"""with {_PATHS}, parts as (select p, string_split(p, '/') as s from p), up as (select array_to_string(s[1:i], '/') as directory, i - 1 as depth, p from (select p, s, unnest(range(2, len(s))) as i from parts))
select directory, cast(depth as integer) as depth, count(distinct p) as files from up group by 1, 2""")
def t11_directory_tree(spark, d):
    p = load(spark, d, "source_files").where("file_path is not null").select(paths.norm("file_path").alias("p")).distinct()
    up = p.select("p", F.explode(paths.prefixes(F.col("p"))).alias("directory"))
    return _count(up.select("directory", (F.size(F.split("directory", "/")) - 1).alias("depth")), "directory", "depth", name="files")


_RULES = {
    "symbol": "['Symbol'] || case when type in ('class', 'interface', 'trait', 'function', 'method', 'property', 'constant', 'namespace', 'file', 'directory', 'variable', 'import') then [upper(type[1]) || substr(type, 2)] else [] end",
    "typed": "case when type in ('file', 'directory') then [label] else ['Symbol', label] end",
    "plain": "[case when type in ('class', 'interface', 'trait', 'function', 'method', 'property', 'constant', 'namespace', 'file', 'directory', 'variable', 'import') then upper(type[1]) || substr(type, 2) else 'Symbol' end]",
    "csv": f"case when {_GROUP} is not null then ['Symbol', {_GROUP}] end",
    "single": f"[coalesce({_GROUP}, case when starts_with(id, 'js_') then 'JSSymbol' end, 'PHPSymbol')]",
    "prefix": "[case when starts_with(id, 'dir_') then 'Directory' when starts_with(id, 'file_') then 'File' when starts_with(id, 'js_') then 'JSSymbol' else 'PHP' || upper(type[1]) || substr(type, 2) end]",
    "mixed": f"[coalesce({_GROUP}, case when starts_with(id, 'js_') then 'JSSymbol' else 'PHPSymbol' end)]",
}


@query(f"with {N} " + " union all ".join(f"select '{r}' as rule, array_to_string({sql}, ':') as labels, count(*) as n from n group by 2" for r, sql in _RULES.items()))
def l01_label_rules(spark, d):
    n = graph(spark, d).nodes
    return S.union_all([n.groupBy(F.lit(r).alias("rule"), F.array_join(L.labels(r), ":").alias("labels")).agg(F.count("*").alias("n")) for r in _RULES])


@query("select id, md5(name || ':' || type || ':' || coalesce(namespace, '')) as hash_now, md5(file_path || ':' || name || ':' || line_number || ':' || column_number) as default_id from symbols")
def d01_ids(spark, d):
    return load(spark, d, "symbols").select("id", content_hash("name", "type", "namespace").alias("hash_now"), symbol_id("file_path", "name", "line_number", "column_number").alias("default_id"))


_NL = {
    0: ("contains(low, 'email') or contains(low, 'mail') or contains(low, 'smtp') or contains(low, 'send')", "type in ('class', 'method', 'function')", "case when contains(low, 'send') then 0 else 1 end, case when contains(low, 'email') then 0 else 1 end", "mail sending"),
    1: ("contains(low, 'auth') or contains(low, 'login') or contains(low, 'authenticate') or contains(low, 'session')", "type in ('class', 'method', 'function')", "case when type = 'class' then 0 else 1 end, case when contains(low, 'auth') then 0 else 1 end", "authentication"),
    2: ("contains(low, 'validat') or contains(low, 'sanitiz') or contains(low, 'filter') or contains(low, 'check')", "type in ('class', 'method', 'function')", "case when contains(low, 'validat') then 0 else 1 end", "input validation"),
    3: ("contains(low, 'query') or contains(low, 'repository') or contains(low, 'database') or contains(low, 'entity') or contains(low, 'orm')", "type in ('class', 'method')", "case when type = 'class' then 0 else 1 end, case when contains(low, 'repository') then 0 else 1 end", "data access"),
    4: ("contains(low, 'controller') or contains(low, 'action') or contains(low, 'api') or contains(low, 'endpoint')", "type in ('class', 'method')", "case when type = 'class' and contains(low, 'controller') then 0 else 1 end", "interfaces"),
    5: ("contains(low, 'error') or contains(low, 'exception') or contains(low, 'catch') or contains(low, 'throw')", "true", "case when contains(low, 'exception') then 0 else 1 end", "error handling"),
}


@query(f"with {N}, w as (select *, lower(name) as low from n) " + " union all ".join(
    f"select * from (select {i} as question, id, name, type, file_path, '{text}' as detail from w where ({words}) and {types} order by {rank}, name, file_path, id limit 20)" for i, (words, types, rank, text) in _NL.items()))
def q50_questions(spark, d):
    g = graph(spark, d)
    return S.union_all([ask(g, QUESTIONS[i]).select(F.lit(i).alias("question"), "id", "name", "type", "file_path", "detail") for i in _NL])


@query(f"""with {N}, {E}, x as (select distinct s.id, s.name, s.type, s.file_path, e.type || ' ' || t.name as detail from e join n s on s.id = e.src join n t on t.id = e.dst where e.type in ('EXTENDS', 'IMPLEMENTS') and contains(lower(t.name), 'basemodel') order by s.name, s.id, detail limit 20) select * from x""")
def q50_hierarchy(spark, d):
    return ask(graph(spark, d), "Which classes extend BaseModel?")


@query(f"""with {N}, {E}, x as (select distinct s.id, s.name, s.type, s.file_path, e.type || ' ' || t.name as detail from e join n s on s.id = e.src join n t on t.id = e.dst where e.type = 'CALLS' and contains(lower(t.name), 'resolve') order by s.name, s.id, detail limit 20) select * from x""")
def q50_callers(spark, d):
    return ask(graph(spark, d), "Who call resolve?")


@query(f"""with {N}, w as (select *, lower(name) as low from n where contains(lower(name), 'loader')) select id, name, type, file_path, 'definition' as detail from w order by case when low = 'loader' then 0 else 1 end, name, id limit 10""")
def q50_definition(spark, d):
    return ask(graph(spark, d), "Where is class Loader")


@query("""with k as (select event_id, props, unnest(json_keys(props)) as path from events where props is not null) select event_id, path, json_extract_string(props, '$.' || path) as value from k""")
def x30_json_leaves(spark, d):
    return metadata.leaves(load(spark, d, "events").select("event_id", F.col("props").alias("json")), "event_id", strings_only=False)


@query(f"""with {N}, m as (select id, json_extract_string(metadata, '$.node_type') as node_type, json_extract_string(metadata, '$.path') as path, json_extract_string(metadata, '$.extension') as extension from n where metadata is not null) select id, key, value from (select id, 'node_type' as key, node_type as value from m union all select id, 'path', path from m union all select id, 'extension', extension from m) where value is not null""")
def x30_metadata_leaves(spark, d):
    docs = graph(spark, d).nodes.where("metadata is not null").select("id", F.col("metadata").alias("json"))
    return metadata.leaves(docs, "id").where("path in ('node_type', 'path', 'extension')").select("id", F.col("path").alias("key"), "value")



def _extracted(spark, d, *extensions: str) -> DataFrame:
    return extract.extract(_current(spark, d), *extensions)


@query()
def x01_php_symbols(spark, d):
    return extract.symbols_of(_extracted(spark, d, "php"))


@query()
def x04_php_references(spark, d):
    return extract.references_of(_extracted(spark, d, "php"))


@query()
def x17_js_rows(spark, d):
    return _extracted(spark, d, "js", "jsx", "mjs", "cjs")


@query()
def x19_python_rows(spark, d):
    return _extracted(spark, d, "py")


@query()
def x20_typescript_rows(spark, d):
    return _extracted(spark, d, "ts", "tsx")


@query()
def x28_extraction_counts(spark, d):
    return _count(_extracted(spark, d), "kind", "type")


@query()
def x99_stored_against_extracted(spark, d):
    """Declared names per file as stored and as read again: files where they differ in number."""
    kinds = ["class", "interface", "trait", "method", "function", "TSClass", "TSInterface", "TSType"]
    read = extract.symbols_of(_extracted(spark, d)).where(F.col("type").isin(kinds)).groupBy("file_path").agg(F.count("*").alias("read"))
    stored = graph(spark, d).nodes.where(F.col("type").isin(kinds)).groupBy("file_path").agg(F.count("*").alias("stored"))
    return stored.join(read, "file_path").where("read <> stored")


_REG = f"""cr as (select config_file, config_key, class_name, min(id) as cid, arg_min(reference_type, id) as reference_type from config_references group by 1, 2, 3),
reg as (select n.id, n.name, cr.config_file, cr.config_key, cr.reference_type from cr join n on n.name = cr.class_name where n.type = 'class')"""


@query(f"with {N}, {_REG} select distinct (select min(id) from n where type = 'class' and name = 'Orvane' || {_BS} || 'Core' || {_BS} || 'Container') as src, id as dst from reg")
def j09_loads_via_config(spark, d):
    n = graph(spark, d).nodes
    return R.loads_via_config(R.registrations(load(spark, d, "config_references"), n), n, "Orvane\\Core\\Container")


@query(f"""with {N}, {_REG} select distinct 'MATCH (s {{id: ''' || replace(id, {_BS}, {_BS} || {_BS}) || '''}}), (t {{id: ''config_' || md5(config_file) || '''}}) CREATE (s)-[:REGISTERED_IN]->(t);' as line from reg""")
def k22_registration_script(spark, d):
    r = R.registrations(load(spark, d, "config_references"), graph(spark, d).nodes)
    edges = r.select(F.col("id").alias("src"), F.concat(F.lit("config_"), F.md5("config_file")).alias("dst"), F.lit("REGISTERED_IN").alias("type"))
    return sinks.script_edges(edges.distinct())


@query(f"""with s as (select id, name, extends, return_type, row_number() over (partition by id order by updated_at desc) as rn from symbols where type in ('class', 'method'))
select id, case when lower(return_type) in ('self', 'static') then name when lower(return_type) = 'parent' then extends else return_type end as meant from s where rn = 1 and return_type is not null""")
def r08_class_words(spark, d):
    s = load(spark, d, "symbols").where("type in ('class', 'method')").select("id", "name", "extends", "return_type", "updated_at")
    return S.upsert_last(s, ["id"], ["updated_at"]).where("return_type is not null").select("id", R.class_word("return_type", "name", "extends").alias("meant"))


@query()
def x27_synthetic_types(spark, d):
    """Return types that a file names but does not declare or import: one placeholder each."""
    rows = _extracted(spark, d, "ts", "tsx")
    named = extract.references_of(rows).where("reference_type = 'RETURNS'").select("file_path", F.col("target").alias("name")).distinct()
    return named.join(extract.symbols_of(rows).select("file_path", "name"), ["file_path", "name"], "left_anti")


@query(f"""with {N}, w as (select *, lower(name) as low from n) select id, name, type, file_path, 'keyword search' as detail from w
where contains(low, 'basket') or contains(low, 'gate') or contains(low, 'ledger') or contains(low, 'the') order by type, name, id limit 30""")
def q50_keyword_search(spark, d):
    return ask(graph(spark, d), "Ledger gate of the basket")


_SPACES = [f"Orvane{chr(92)}{part}" for part in R.FALLBACK_PARTS]
_FALLBACK = _RESOLVED.replace("),\nknown as", " " + " ".join(f"union all select ref_id, {5 + i}, '{space}' || {_BS} || name from refs where not starts_with(name, {_BS})" for i, space in enumerate(_SPACES)) + "),\nknown as").replace("r.ref_id, 5, k.id", f"r.ref_id, {5 + len(_SPACES)}, k.id")


@query(f"with {_WRITTEN}, {_FALLBACK} select ref_id, id as target_id, cast(prio as integer) as prio from best where rn = 1")
def r04_fallback(spark, d):
    return R.resolve(*_written(spark, d), fallback=R.fallback_namespaces("Orvane"))


@query(f"""with {_CLASSREFS}, {_FALLBACK}, lost as (select distinct ltrim(name, {_BS}) as name from refs where ref_id not in (select ref_id from best))
select 'external_' || md5(name) as id, name, case when contains(name, 'Interface') then 'interface' when contains(name, 'Trait') then 'trait' else 'class' end as type, case when starts_with(name, 'Orvane') then '<unresolved>' else '<external>' end as file_path from lost""")
def r05_unresolved(spark, d):
    refs, now = _class_refs(spark, d)
    return R.externals(refs, R.resolve(refs, now, fallback=R.fallback_namespaces("Orvane")), own_root="Orvane")


@query(f"with {N} select n.id, n.name, n.type, n.file_path from n where id in (select symbol_id from symbol_deletions)")
def s13_by_id(spark, d):
    """Lookups by id: the ids asked for are those of the removal log."""
    asked = load(spark, d, "symbol_deletions").select(F.col("symbol_id").alias("id"))
    return graph(spark, d).nodes.select("id", "name", "type", "file_path").join(asked, "id", "left_semi")


@query(f"with {N} select file_path, cast(row_number() over (partition by file_path order by line_number nulls first, id) as integer) as place, id, name from n where file_path in (select file_path from file_hashes) and type not in ('file', 'directory')")
def s13_of_file(spark, d):
    """Symbols of the files that were parsed, in the order of their lines."""
    asked = load(spark, d, "file_hashes").select("file_path")
    n = graph(spark, d).nodes.where("type not in ('file', 'directory')").join(asked, "file_path", "left_semi")
    return n.select("file_path", F.row_number().over(W.partitionBy("file_path").orderBy("line_number", "id")).alias("place"), "id", "name")


@query(f"with {E} select src, dst, type from e where src is not null and dst is not null")
def s16_script_reader(spark, d):
    """Relationship statements as written, read again."""
    lines = sinks.script_edges(graph(spark, d).edges.where("src is not null and dst is not null"))
    return sinks.relationships(lines.select(F.col("line").alias("value")))


_HOOKS = "case id % 6 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(metadata.HOOK_KEYS)) + " end"


@query(f"""select distinct config_file, {_HOOKS} as config_key, class_name from config_references where reference_type in ('hook', 'service') and config_file is not null and regexp_full_match(class_name, '[A-Z][A-Za-z0-9_\\\\]+') and contains(class_name, {_BS})""")
def x29_hooks(spark, d):
    """Hook lists of metadata documents, which are put together from the registered hooks and services."""
    rows = load(spark, d, "config_references").where("reference_type in ('hook', 'service') and config_file is not null").select("config_file", F.expr(_HOOKS).alias("k"), "class_name")
    lists = rows.groupBy("config_file", "k").agg(F.collect_set("class_name").alias("names"))
    docs = lists.groupBy("config_file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "names")))).alias("json"))
    return metadata.hooks(docs)


@query(f"with {_CLASSREFS}, {_RESOLVED} select b.id as base_id, c.id, c.name from best b join cs c on c.id = b.ref_id where b.rn = 1")
def j10_subclasses(spark, d):
    """Classes by the class they extend, its written name resolved."""
    refs, now = _class_refs(spark, d)
    return R.resolve(refs, now).join(now.select(F.col("id").alias("ref_id"), "name"), "ref_id").select(F.col("target_id").alias("base_id"), F.col("ref_id").alias("id"), "name")


@query("""with r as (select *, row_number() over (partition by source_id, target_id, line_number, column_number, reference_type order by id) as rn from symbol_references)
select upper(replace(reference_type, '-', '_')) as type, cast(count(*) as bigint) as delivered, cast(count(distinct id) as bigint) as kept from r group by 1""")
def k11_bag_insert(spark, d):
    """Appended as delivered, repeats and all, against what an insert by id keeps."""
    r = load(spark, d, "symbol_references").select("id", edge_type().alias("type"))
    bag = S.union_all([r.where("id % 2 = 0"), r.where("id % 2 <> 0")])
    kept = _count(bag.distinct(), "type", name="kept")
    return _count(bag, "type", name="delivered").join(kept, "type").select("type", "delivered", "kept")


@query()
def k05_file_errors(spark, d):
    """Files that give an error row in place of their symbols."""
    return extract.errors_of(_extracted(spark, d))


def _older(label: str) -> str:
    return f"""with {N}, esc as (select *, {', '.join(f"replace(replace({c}, {_BS}, {_BS} || {_BS}), '''', {_BS} || '''') as q_{c}" for c in ('id', 'name', 'type', 'file_path', 'namespace', 'visibility'))} from n where type not in ('file', 'directory') and type <> '')
select 'CREATE (:' || {label} || ' {{' || concat_ws(', ', {', '.join(f"'{c}: ''' || q_{c} || ''''" for c in ('id', 'name', 'type', 'file_path', 'namespace', 'visibility'))}, 'line_number: ' || line_number) || '}});' as line from esc"""


@query(_older(f"coalesce({_GROUP}, case when starts_with(id, 'js_') then 'JSSymbol' end, 'PHPSymbol')"))
def k07_script_single(spark, d):
    """The older form with one label a node and without files and directories."""
    return sinks.script_nodes(graph(spark, d).nodes.where("type not in ('file', 'directory') and type <> ''"), "single")


@query(_older("case when starts_with(id, 'dir_') then 'Directory' when starts_with(id, 'file_') then 'File' when starts_with(id, 'js_') then 'JSSymbol' else 'PHP' || upper(type[1]) || substr(type, 2) end"))
def k07_script_prefix(spark, d):
    """The older form with labels by the prefix of the id, without files and directories."""
    return sinks.script_nodes(graph(spark, d).nodes.where("type not in ('file', 'directory') and type <> ''"), "prefix")
