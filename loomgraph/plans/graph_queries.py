"""The catalogue of graph queries over the code tables, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.operators import pattern as P
from loomgraph.operators.graph import PropertyGraph, code_graph, structure_graph
from loomgraph.session import Cuts, load, maybe_broadcast

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Node types of the catalogue's roles.
COMPONENTS = ["ReactComponent", "TSFunction", "TSClass"]
CLASSES = "('class', 'interface', 'trait', 'TSClass', 'TSInterface')"

N = """n as (select id, name, type, case when type = 'file' then 'File' when type = 'directory' then 'Directory' when coalesce(type, '') = '' then 'Symbol' else type end as label,
  file_path, line_number, namespace, parent_id, visibility, return_type, metadata
  from (select *, row_number() over (partition by id order by updated_at desc nulls last) as rn from symbols where id is not null) where rn = 1)"""
E = """e as (select min(id) as eid, source_id as src, target_id as dst, upper(replace(reference_type, '-', '_')) as type, line_number, column_number from symbol_references group by 2, 3, 4, 5, 6)"""
PE = f"""pe as (select u.id as src, k.id as dst, case when (u.type = 'file' and (k.type in {CLASSES} or k.type = 'function')) or u.type in {CLASSES} then 'DEFINES' else 'CONTAINS' end as type
  from n k join n u on k.parent_id = u.id)"""


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Folders of graphs that were stored for a data folder; their queries then read these.
STORED: dict[str, str] = {}


def store(spark: SparkSession, d: str, path: str) -> None:
    """Write the code graph of ``d`` once; all later queries over ``d`` read it, typed ones only their partitions."""
    code_graph(load(spark, d, "symbols"), load(spark, d, "symbol_references")).write(path)
    STORED[d] = path


def graph(spark: SparkSession, d: str) -> PropertyGraph:
    if d in STORED:
        return PropertyGraph.read(spark, STORED[d])
    return code_graph(load(spark, d, "symbols"), load(spark, d, "symbol_references"))


def tree(spark: SparkSession, d: str) -> PropertyGraph:
    return structure_graph(load(spark, d, "symbols"))


def _count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def _edges_sql(types: str) -> str:
    return f"x as (select * from e where type in ({types}))"


def _walks_sql(types: str, direction: str, start: str, k: int) -> str:
    """Edge-unique paths from ``start`` (a query giving id) as t(start_id, end_id, length, path)."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return f"""{_edges_sql(types)},
t(start_id, end_id, length, path) as (
  select s.id, x.{b}, 1, [x.eid] from ({start}) s join x on x.{a} = s.id
  union all select t.start_id, x.{b}, t.length + 1, list_append(t.path, x.eid) from t join x on x.{a} = t.end_id where t.length < {k} and not list_contains(t.path, x.eid))"""


def _levels_sql(types: str, direction: str, start: str, k: int) -> str:
    """Nodes within k steps as r(start_id, end_id, distance)."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    ls = [f"{_edges_sql(types)}, l0 as (select id as s, id as z from ({start}))"]
    for i in range(1, k + 1):
        ls.append(f"l{i} as (select distinct l.s, x.{b} as z from l{i - 1} l join x on x.{a} = l.z)")
    union = " union all ".join(f"select s, z, {i} as dist from l{i}" for i in range(1, k + 1))
    return ",\n".join(ls) + f",\nr as (select s as start_id, z as end_id, min(dist) as distance from ({union}) group by 1, 2)"


@query(f"""with {N}, {E} select s.id as component_id, s.name as component, t.name as element, e.eid from e join n s on s.id = e.src join n t on t.id = e.dst
where e.type = 'RENDERS' and t.name = 'Stack' order by s.id, e.eid limit 50""")
def q01_renders_element(spark, d):
    r = P.expand1(graph(spark, d), "RENDERS", dst=F.col("t_name") == "Stack")
    return r.select(F.col("s_id").alias("component_id"), F.col("s_name").alias("component"), F.col("t_name").alias("element"), "eid").orderBy("component_id", "eid").limit(50)


@query(f"with {N}, {E} select id, name from n where type in ('ReactComponent', 'TSFunction', 'TSClass') and not exists (select 1 from e where e.dst = n.id and e.type = 'IMPORTS')")
def q02_unused_component(spark, d):
    g = graph(spark, d)
    return P.lacking_edge(g.node(*COMPONENTS), g.edge("IMPORTS"), "dst").select("id", "name")


@query(f"""with recursive {N}, {E}, {_levels_sql("'CALLS', 'USES'", "in", "select id from n where type = 'TSInterface'", 3)}
select r.start_id as id, n.name as consumer, count(*) as n_nodes, min(r.distance) as distance from r join n on n.id = r.end_id group by 1, 2""")
def q03_api_consumers(spark, d):
    g = graph(spark, d)
    r = P.reach(g.edge("CALLS", "USES"), g.node("TSInterface").select("id"), 3, "in")
    j = r.join(g.nodes.select(F.col("id").alias("end"), F.col("name").alias("consumer")), "end")
    # one row per consumer: a hub's consumers are never gathered into one value
    return j.groupBy(F.col("start").alias("id"), "consumer").agg(F.count("*").alias("n_nodes"), F.min("distance").alias("distance"))


@query(f"""with {N}, {E} select n.id, n.name, count(*) as dependencies from n join e on e.src = n.id where e.type in ('RENDERS', 'USES', 'CALLS') group by 1, 2 having count(*) > 15""")
def q04_high_coupling(spark, d):
    g = graph(spark, d)
    return P.degrees(g, "RENDERS", "USES", "CALLS").where("out_degree > 15").join(g.nodes.select("id", "name"), "id").select("id", "name", F.col("out_degree").alias("dependencies"))


@query(f"""with recursive {N}, {E}, {_walks_sql("'USES', 'IMPORTS', 'EXTENDS'", "in", "select id from n where name = 'Orvane' || chr(92) || 'Core' || chr(92) || 'Tree'", 3)}
select distinct n.name, t.length as distance from t join n on n.id = t.end_id""")
def q05_impact(spark, d):
    g = graph(spark, d)
    paths = P.path_counts(g.edge("USES", "IMPORTS", "EXTENDS"), g.nodes.where(F.col("name") == "Orvane\\Core\\Tree"), 3, direction="in")
    return paths.join(g.nodes.select(F.col("id").alias("end"), "name"), "end").select("name", F.col("length").alias("distance")).distinct()


@query(f"""with {N}, {E} select s.name as consumer, s.type as consumer_type, e.type as via, t.name as target, count(*) as n
from e join n s on s.id = e.src join n t on t.id = e.dst where e.type in ('CALLS', 'USES', 'IMPORTS') group by 1, 2, 3, 4""")
def q06_direct_consumers(spark, d):
    r = P.expand1(graph(spark, d), "CALLS", "USES", "IMPORTS")
    return _count(r.select(F.col("s_name").alias("consumer"), F.col("s_type").alias("consumer_type"), F.col("r_type").alias("via"), F.col("t_name").alias("target")), "consumer", "consumer_type", "via", "target")


@query(f"""with {N}, {E}, o as (select src as id, count(*) as c from e group by 1), i as (select dst as id, count(*) as c from e group by 1)
select n.id, n.name, coalesce(i.c, 0) as fan_in, coalesce(o.c, 0) as fan_out from n left join o using (id) left join i using (id) where coalesce(i.c, 0) + coalesce(o.c, 0) > 20""")
def q07_fan_in_out(spark, d):
    g = graph(spark, d)
    return P.degrees(g).where("in_degree + out_degree > 20").join(g.nodes.select("id", "name"), "id").select("id", "name", F.col("in_degree").alias("fan_in"), F.col("out_degree").alias("fan_out"))


@query(f"""with {N}, {E} select id, name, type from n where type not in ('file', 'directory') and not exists (select 1 from e where e.dst = n.id)
and not exists (select 1 from e where e.src = n.id and e.type in ('EXPORTS', 'RENDERS'))""")
def q08_dead_code(spark, d):
    g = graph(spark, d)
    lone = P.lacking_edge(g.nodes.where("type not in ('file', 'directory')"), g.edges, "dst")
    return P.lacking_edge(lone, g.edge("EXPORTS", "RENDERS"), "src").select("id", "name", "type")


@query(f"""with {N}, {E}, o as (select src as id, count(*) as c from e group by 1)
select file_path, count(*) as symbols, cast(sum(coalesce(o.c, 0)) as bigint) as dependencies from n left join o using (id) where type not in ('file', 'directory') group by 1
having count(*) > 20 or sum(coalesce(o.c, 0)) > 60""")
def q09_hotspot_files(spark, d):
    g = graph(spark, d)
    out = _count(g.edges.select(F.col("src").alias("id")), "id", name="c")
    j = g.nodes.where("type not in ('file', 'directory')").join(out, "id", "left").groupBy("file_path").agg(F.count("*").alias("symbols"), F.sum(F.coalesce("c", F.lit(0))).alias("dependencies"))
    return j.where("symbols > 20 or dependencies > 60")


@query(f"""with recursive {N}, {E}, {_levels_sql("'CALLS', 'USES', 'INSTANTIATES', 'PARAMETER_TYPE', 'EXTENDS'", "out", "select id from n where contains(name, 'Presenter')", 3)}
select s.name as from_name, t.name as to_name, r.distance from r join n s on s.id = r.start_id join n t on t.id = r.end_id where contains(t.name, 'Repository') or contains(t.name, 'Store')""")
def q10_layering_violation(spark, d):
    g = graph(spark, d)
    below = g.nodes.where(F.col("name").contains("Repository") | F.col("name").contains("Store")).select("id")
    r = P.reach(g.edge("CALLS", "USES", "INSTANTIATES", "PARAMETER_TYPE", "EXTENDS"), g.nodes.where(F.col("name").contains("Presenter")).select("id"), 3, ends=below)
    s, t = (g.nodes.select(F.col("id").alias(i), F.col("name").alias(n)) for i, n in (("start", "from_name"), ("end", "to_name")))
    return r.join(t, "end").join(s, "start").select("from_name", "to_name", "distance")


@query(f"""with recursive {N}, {E}, {_walks_sql("'CALLS', 'USES'", "out", "select id from n where type = 'ReactComponent'", 5)}
select t.start_id as route_id, n.id as sink_id, n.name as sink, t.length as depth, count(*) as n_paths from t join n on n.id = t.end_id where contains(n.name, 'fetch') or contains(n.name, 'apply') group by 1, 2, 3, 4""")
def q11_audit_trail(spark, d):
    g = graph(spark, d)
    sinks = g.nodes.where(F.col("name").contains("fetch") | F.col("name").contains("apply")).select("id", F.col("name").alias("sink"))
    p = P.path_counts(g.edge("CALLS", "USES"), g.node("ReactComponent").select("id"), 5, ends=sinks.select("id"))
    return p.join(sinks, p["end"] == sinks["id"]).select(F.col("start").alias("route_id"), F.col("end").alias("sink_id"), "sink", F.col("length").alias("depth"), "n_paths")


@query(f"""with recursive {N}, {E}, {_walks_sql("'USES', 'IMPORTS', 'CALLS'", "out", "select id from n where type = 'TSClass'", 2)}
select t.start_id, t.end_id, t.length from t join n on n.id = t.end_id where n.type in ('class', 'interface', 'TSClass') order by t.length, t.start_id, t.end_id, t.path limit 100""")
def q12_template(spark, d):
    g = graph(spark, d)
    ends = g.nodes.where("type in ('class', 'interface', 'TSClass')").select(F.col("id").alias("end"))
    p = P.expand(g.edge("USES", "IMPORTS", "CALLS"), g.node("TSClass"), 2).join(ends, "end")
    return p.orderBy("length", "start", "end", "path").limit(100).select(F.col("start").alias("start_id"), F.col("end").alias("end_id"), "length")


@query(f"""with recursive {N}, {E}, {_walks_sql("'RENDERS'", "in", "select id from n where name = 'Card' and type = 'JSXElement'", 3)}
select distinct n.id, n.name, t.length as distance from t join n on n.id = t.end_id""")
def q13_renders_within(spark, d):
    g = graph(spark, d)
    p = P.path_counts(g.edge("RENDERS"), g.nodes.where("name = 'Card' and type = 'JSXElement'"), 3, direction="in")
    return p.join(g.nodes.select("id", "name"), p["end"] == F.col("id")).select("id", "name", F.col("length").alias("distance")).distinct()


@query(f"""with recursive {N}, {E}, {_walks_sql("'RENDERS', 'USES', 'CALLS'", "out", "select id from n where type in ('ReactComponent', 'TSFunction', 'TSClass')", 6)}
select t.start_id, t.end_id, t.length, count(*) as n_paths from t where t.length > 3 group by 1, 2, 3""")
def q14_prop_drilling(spark, d):
    g = graph(spark, d)
    return P.path_counts(g.edge("RENDERS", "USES", "CALLS"), g.node(*COMPONENTS).select("id"), 6, 4).select(F.col("start").alias("start_id"), F.col("end").alias("end_id"), "length", "n_paths")


@query(f"""with recursive {N}, {E}, {_walks_sql("'RENDERS', 'EXTENDS'", "out", "select id from n where type not in ('file', 'directory')", 1_000_000)}
select t.start_id, t.end_id, t.length, count(*) as n_paths from t where t.length > 1 group by 1, 2, 3""")
def q14_unbounded(spark, d):
    """Paths of more than one step without an upper bound."""
    g = graph(spark, d)
    return P.path_counts(g.edge("RENDERS", "EXTENDS"), g.nodes.where("type not in ('file', 'directory')").select("id"), None, 2).select(F.col("start").alias("start_id"), F.col("end").alias("end_id"), "length", "n_paths")


@query(f"""with recursive {N}, {E}, {_walks_sql("'IMPORTS', 'USES', 'CALLS_STATIC', 'CALLS'", "out", "select distinct src as id from e where type in ('IMPORTS', 'USES', 'CALLS_STATIC', 'CALLS')", 5)}
select start_id as id, length, count(*) as n_cycles from t where start_id = end_id and length >= 2 group by 1, 2""")
def q15_import_cycles(spark, d):
    return P.cycle_counts(graph(spark, d).edge("IMPORTS", "USES", "CALLS_STATIC", "CALLS"), 5, 2)


@query(f"""with recursive {N}, {E}, c(id) as (select src from e where type = 'EXTENDS' and dst in (select id from n where name = 'Orvane' || chr(92) || 'Core' || chr(92) || 'BaseModel')
union select e.src from c join e on e.dst = c.id where e.type = 'EXTENDS') select n.id, n.name from c join n using (id)""")
def q16_descendants_of_base(spark, d):
    g = graph(spark, d)
    found = P.closure(g.edge("EXTENDS"), g.nodes.where(F.col("name") == "Orvane\\Core\\BaseModel"), "in")
    return found.join(g.nodes.select("id", "name"), "id").select("id", "name")


@query(f"""with {N}, {PE} select c.id, c.name, count(*) as methods from pe join n c on c.id = pe.src join n m on m.id = pe.dst where c.type in ('class', 'TSClass') and m.type = 'method' and pe.type = 'DEFINES' group by 1, 2 having count(*) > 5""")
def q17_god_classes(spark, d):
    r = P.expand1(tree(spark, d), "DEFINES", src=F.col("s_type").isin("class", "TSClass"), dst=F.col("t_type") == "method")
    return _count(r.select(F.col("s_id").alias("id"), F.col("s_name").alias("name")), "id", "name", name="methods").where("methods > 5")


@query(f"""with {N} select type, json_extract_string(metadata, '$.async') as is_async, json_extract_string(metadata, '$.extension') as extension, count(*) as n from n where metadata is not null group by 1, 2, 3""")
def q18_by_property(spark, d):
    n = graph(spark, d).nodes.where("metadata is not null")
    return _count(n.select("type", F.get_json_object("metadata", "$.async").alias("is_async"), F.get_json_object("metadata", "$.extension").alias("extension")), "type", "is_async", "extension")


@query(f"""with {N}, {E}, x as (select e.src as id, 'out' as direction, t.name as other from e join n t on t.id = e.dst union select e.dst, 'in', s.name from e join n s on s.id = e.src)
select n.id, n.name, x.direction, x.other from n left join x using (id) where n.type = 'trait'""")
def q19_context(spark, d):
    g = graph(spark, d)
    return P.neighbours(g, g.node("trait").select("id", "name"))


@query(f"""with recursive {N}, {E}, {_levels_sql("'CALLS', 'USES', 'IMPORTS', 'EXTENDS'", "in", "select id from n where type in ('trait', 'TSType', 'interface')", 2)},
c as (select start_id as id, count(distinct end_id) as affected from r group by 1)
select n.id, n.name, coalesce(c.affected, 0) as affected, case when coalesce(c.affected, 0) < 5 then 'LOW' when c.affected < 20 then 'MEDIUM' else 'HIGH' end as risk from n left join c using (id) where n.type in ('trait', 'TSType', 'interface')""")
def q20_impact_radius(spark, d):
    g = graph(spark, d)
    seeds = g.node("trait", "TSType", "interface")
    c = _count(P.reach(g.edge("CALLS", "USES", "IMPORTS", "EXTENDS"), seeds.select("id"), 2, "in").select(F.col("start").alias("id")), "id", name="affected")
    a = F.coalesce("affected", F.lit(0))
    return seeds.select("id", "name").join(c, "id", "left").select("id", "name", a.alias("affected"), F.when(a < 5, "LOW").when(a < 20, "MEDIUM").otherwise("HIGH").alias("risk"))


@query(f"with {N} select label, count(*) as n from n group by 1")
def q21_nodes_by_label(spark, d):
    return _count(graph(spark, d).nodes, "label")


@query(f"with {N} select id, name, label from n order by id limit 25")
def q22_sample_nodes(spark, d):
    return graph(spark, d).nodes.select("id", "name", "label").orderBy("id").limit(25)


@query(f"""with recursive {N}, {E}, {_levels_sql("'CALLS', 'USES', 'RENDERS'", "out", "select id from n where type = 'ReactComponent'", 3)} select count(distinct end_id) as reachable from r""")
def q23_count_reachable(spark, d):
    g = graph(spark, d)
    return P.reach(g.edge("CALLS", "USES", "RENDERS"), g.node("ReactComponent").select("id"), 3, per_start=False).agg(F.count("*").alias("reachable"))


@query(f"with {E} select type, count(*) as n from e group by 1")
def q24_edges_by_type(spark, d):
    return _count(graph(spark, d).edges, "type")


@query(f"""with {N}, {PE} select c.id, c.name, string_agg(m.name || ':' || m.type, ',' order by m.name || ':' || m.type) as members from pe join n c on c.id = pe.src join n m on m.id = pe.dst where c.type = 'interface' or c.type = 'TSInterface' group by 1, 2""")
def q25_export_members(spark, d):
    r = P.expand1(tree(spark, d), src=F.col("s_type").isin("interface", "TSInterface"))
    return r.groupBy(F.col("s_id").alias("id"), F.col("s_name").alias("name")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "t_name", "t_type"))), ",").alias("members"))


@query(f"""with {N}, {E} select distinct s.name as source, t.name as target, e.type from e join n s on s.id = e.src join n t on t.id = e.dst where e.type in ('EXTENDS', 'IMPLEMENTS', 'USES_TRAIT')""")
def q25_export_pairs(spark, d):
    r = P.expand1(graph(spark, d), "EXTENDS", "IMPLEMENTS", "USES_TRAIT")
    return r.select(F.col("s_name").alias("source"), F.col("t_name").alias("target"), F.col("r_type").alias("type")).distinct()


@query(f"""with {N}, {E} select id, name from n where type in ('ReactComponent', 'TSFunction', 'TSClass', 'method') and exists (select 1 from e where e.src = n.id and e.type in ('EXPORTS', 'RENDERS')) and not exists (select 1 from e where e.dst = n.id and e.type in ('IMPORTS', 'CALLS'))""")
def q26_unused_exported(spark, d):
    g = graph(spark, d)
    some = P.having_edge(g.node(*COMPONENTS, "method"), g.edge("EXPORTS", "RENDERS"), "src")
    return P.lacking_edge(some, g.edge("IMPORTS", "CALLS"), "dst").select("id", "name")


@query(f"with {N} select count(*) as n from n where type like 'TS%'")
def q27_label_contamination(spark, d):
    return graph(spark, d).nodes.where(F.col("type").startswith("TS")).agg(F.count("*").alias("n"))


@query(f"""with {N}, {E} select s.id, s.name, t.name as element from e join n s on s.id = e.src join n t on t.id = e.dst where e.type = 'RENDERS' and t.type = 'JSXElement' order by s.id, t.name, e.eid limit 20""")
def q28_component_elements(spark, d):
    r = P.expand1(graph(spark, d), "RENDERS", dst=F.col("t_type") == "JSXElement")
    return r.orderBy("s_id", "t_name", "eid").limit(20).select(F.col("s_id").alias("id"), F.col("s_name").alias("name"), F.col("t_name").alias("element"))


@query(f"with {N}, {E} select (select count(*) from n) as nodes, (select count(*) from e) as relationships")
def q29_totals(spark, d):
    g = graph(spark, d)
    return g.nodes.agg(F.count("*").alias("nodes")).withColumn("relationships", g.edges.agg(F.count("*")).scalar())


@query(f"""with {N}, {E} select 'node' as what, type as name, count(*) as n, count(distinct file_path) as files from n group by 2 union all select 'relationship', type, count(*), null from e group by 2""")
def q30_statistics(spark, d):
    g = graph(spark, d)
    a = g.nodes.groupBy(F.lit("node").alias("what"), F.col("type").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))
    return a.unionByName(g.edges.groupBy(F.lit("relationship").alias("what"), F.col("type").alias("name")).agg(F.count("*").alias("n"), F.lit(None).cast("long").alias("files")))


@query(f"""with {N}, l as (select unnest(case when type in ('file', 'directory') then [label] else ['Symbol', label] end) as label from n) select label, count(*) as n from l group by 1""")
def q31_label_histogram(spark, d):
    from loomgraph.functions.labels import labels

    return _count(graph(spark, d).nodes.select(F.explode(labels("typed")).alias("label")), "label")


@query(f"""with {N}, {E}, {PE} select c.name, count(e.eid) as calls from pe join n c on c.id = pe.src join n m on m.id = pe.dst join e on e.dst = m.id where contains(c.name, 'Service') and pe.type = 'DEFINES' and m.type = 'method' and e.type = 'CALLS' group by 1 order by 2 desc, 1 limit 5""")
def q32_service_calls(spark, d):
    r = P.expand1(tree(spark, d), "DEFINES", src=F.col("s_name").contains("Service"), dst=F.col("t_type") == "method").select("s_name", "t_id")
    calls = _count(graph(spark, d).edge("CALLS").select(F.col("dst").alias("t_id")), "t_id", name="c")
    return r.join(calls, "t_id").groupBy(F.col("s_name").alias("name")).agg(F.sum("c").alias("calls")).orderBy(F.desc("calls"), "name").limit(5)


@query(f"with {N}, {PE} select s.label as from_label, pe.type, t.label as to_label, count(*) as n from pe join n s on s.id = pe.src join n t on t.id = pe.dst group by 1, 2, 3")
def q33_structure_counts(spark, d):
    r = P.expand1(tree(spark, d))
    return _count(r.select(F.col("s_label").alias("from_label"), F.col("r_type").alias("type"), F.col("t_label").alias("to_label")), "from_label", "type", "to_label")


@query(f"""with {N}, {E} select distinct n.id, n.name from n join e on e.src = n.id join n t on t.id = e.dst where n.type = 'class' and e.type in ('EXTENDS', 'IMPLEMENTS') and t.name like 'Orvane%' and not exists (select 1 from config_references c where c.class_name = n.name)""")
def q34_orphan_hooks(spark, d):
    r = P.expand1(graph(spark, d), "EXTENDS", "IMPLEMENTS", src=F.col("s_type") == "class", dst=F.col("t_name").startswith("Orvane"))
    known = load(spark, d, "config_references").select(F.col("class_name").alias("name"))
    return r.select(F.col("s_id").alias("id"), F.col("s_name").alias("name")).distinct().join(known, "name", "left_anti").select("id", "name")


_CONFIG = "cr as (select config_file, config_key, class_name, min(id) as id, arg_min(reference_type, id) as reference_type from config_references group by 1, 2, 3)"


@query(f"with {N}, {_CONFIG} select n.id, n.name, cr.config_file, cr.config_key from cr join n on n.name = cr.class_name where n.type = 'class' and cr.reference_type = 'hook'")
def q35_registered_hooks(spark, d):
    from loomgraph.operators.resolve import registrations

    r = registrations(load(spark, d, "config_references"), graph(spark, d).nodes)
    return r.where("reference_type = 'hook'").select("id", "name", "config_file", "config_key")


@query(f"with {N} select id, name, file_path from n where type in ('class', 'TSClass') and (name like '%Service' or name in ('LazyBase', 'BulkBase', 'PlainBase'))")
def q36_class_filter(spark, d):
    n = F.col("name")
    return graph(spark, d).node("class", "TSClass").where(n.endswith("Service") | n.isin("LazyBase", "BulkBase", "PlainBase")).select("id", "name", "file_path")


@query(f"with {N}, {E} select s.name as from_name, e.type as via, t.name as to_name, count(*) as n from e join n s on s.id = e.src join n t on t.id = e.dst where s.type = 'class' and t.type = 'class' group by 1, 2, 3")
def q37_class_to_class(spark, d):
    r = P.expand1(graph(spark, d), src=F.col("s_type") == "class", dst=F.col("t_type") == "class")
    return _count(r.select(F.col("s_name").alias("from_name"), F.col("r_type").alias("via"), F.col("t_name").alias("to_name")), "from_name", "via", "to_name")


@query(f"with {N}, {E} select e.type, count(*) as n from e join n s on s.id = e.src join n t on t.id = e.dst where s.type in ('class', 'method') and t.type = 'directory' group by 1")
def q38_wrong_edges(spark, d):
    r = P.expand1(graph(spark, d), src=F.col("s_type").isin("class", "method"), dst=F.col("t_type") == "directory")
    return _count(r.select(F.col("r_type").alias("type")), "type")


@query(f"""with {E}, k as (select *, row_number() over (partition by type order by eid) as rank from e) select type, eid, src, dst from k where rank <= 3""")
def q39_samples_per_type(spark, d):
    # the three least of a type are three partial aggregates over it: no task ever holds or sorts a type
    cuts = Cuts(spark, "samples")
    e = cuts.write(graph(spark, d).edges.select("type", "eid", "src", "dst"))
    first, types = None, 0
    for _ in range(3):
        rest = e if first is None else e.join(maybe_broadcast(first.groupBy("type").agg(F.max("eid").alias("last")), types), "type").where("eid > last").drop("last")
        least, n = cuts.write_counted(rest.groupBy("type").agg(F.min(F.struct("eid", "src", "dst")).alias("m")).select("type", "m.eid", "m.src", "m.dst"))
        first, types = (least, n) if first is None else (first.unionByName(least), types)
    return cuts.finish(first)


@query(f"""with {N}, {PE} select a.name as directory, f.name as file, c.name as class from pe p join n a on a.id = p.src join n f on f.id = p.dst join pe q on q.src = f.id join n c on c.id = q.dst where a.type = 'directory' and f.type = 'file' and c.type = 'class' order by c.id limit 10""")
def q40_directory_file_class(spark, d):
    g = tree(spark, d)
    a = P.expand1(g, src=F.col("s_type") == "directory", dst=F.col("t_type") == "file").select(F.col("s_name").alias("directory"), F.col("t_id").alias("f"), F.col("t_name").alias("file"))
    b = P.expand1(g, src=F.col("s_type") == "file", dst=F.col("t_type") == "class").select(F.col("s_id").alias("f"), F.col("t_id").alias("c"), F.col("t_name").alias("class"))
    return a.join(b, "f").orderBy("c").limit(10).select("directory", "file", "class")


@query(f"""with recursive {N}, r as (select * from n where type = 'directory'),
t(id, depth, path) as (select id, 0, name from r where parent_id is null or parent_id not in (select id from r) union all select r.id, t.depth + 1, t.path || '/' || r.name from t join r on r.parent_id = t.id)
select id, depth, path from t""")
def q41_directory_depths(spark, d):
    from loomgraph.operators.hierarchy import hierarchy

    return hierarchy(load(spark, d, "symbols").where("type = 'directory'")).where("depth >= 0").select("id", "depth", "path")


@query(f"""with {N} select u.id as parent_id, k.id, k.name, k.type from n k join n u on u.id = k.parent_id where u.type = 'directory' and k.type = 'file'""")
def q42_children(spark, d):
    r = P.expand1(tree(spark, d), "CONTAINS", src=F.col("s_type") == "directory", dst=F.col("t_type") == "file")
    return r.select(F.col("s_id").alias("parent_id"), F.col("t_id").alias("id"), F.col("t_name").alias("name"), F.col("t_type").alias("type"))


@query(f"""with {N}, {PE}, a as (select c.id, c.name, count(*) as n from pe join n c on c.id = pe.src join n m on m.id = pe.dst where c.type = 'class' and m.type = 'method' group by 1, 2 order by 3 desc, 1 limit 5),
b as (select f.id, f.name, count(*) as n from pe join n f on f.id = pe.src join n c on c.id = pe.dst where f.type = 'file' and c.type in {CLASSES} group by 1, 2 order by 3 desc, 1 limit 5)
select 'class' as what, id, name, n from a union all select 'file', id, name, n from b""")
def q43_largest(spark, d):
    g = tree(spark, d)

    def top(what: str, s, t) -> DataFrame:
        r = _count(P.expand1(g, src=s, dst=t).select(F.lit(what).alias("what"), F.col("s_id").alias("id"), F.col("s_name").alias("name")), "what", "id", "name")
        return r.orderBy(F.desc("n"), "id").limit(5)

    classes = F.col("t_type").isin("class", "interface", "trait", "TSClass", "TSInterface")
    return top("class", F.col("s_type") == "class", F.col("t_type") == "method").unionByName(top("file", F.col("s_type") == "file", classes))


@query(f"with {N}, {PE} select c.id, c.name, string_agg(p.name, ',' order by p.name) as properties from pe join n c on c.id = pe.src join n p on p.id = pe.dst where c.type = 'class' and p.type = 'property' group by 1, 2")
def q44_class_properties(spark, d):
    r = P.expand1(tree(spark, d), "DEFINES", src=F.col("s_type") == "class", dst=F.col("t_type") == "property")
    return r.groupBy(F.col("s_id").alias("id"), F.col("s_name").alias("name")).agg(F.array_join(F.sort_array(F.collect_list("t_name")), ",").alias("properties"))


@query(f"with {N} select id, name, visibility from n where type in ('property', 'method') and (visibility = 'private' or name like '\\_%' escape '\\')")
def q45_private_properties(spark, d):
    return graph(spark, d).node("property", "method").where((F.col("visibility") == "private") | F.col("name").startswith("_")).select("id", "name", "visibility")


@query(f"""with recursive {N}, {E}, seed as (select id from n where type = 'trait' order by id limit 1),
x as (select * from e), w as (select x.dst as o, 'out' as dir, 1 as len, x.eid as a, null as b from x join seed on x.src = seed.id union all select y.dst, 'out', 2, x.eid, y.eid from x join seed on x.src = seed.id join x y on y.src = x.dst and y.eid <> x.eid
union all select x.src, 'in', 1, x.eid, null from x join seed on x.dst = seed.id union all select y.src, 'in', 2, x.eid, y.eid from x join seed on x.dst = seed.id join x y on y.dst = x.src and y.eid <> x.eid)
select distinct w.dir as direction, n.id, n.name from w join n on n.id = w.o order by 1, 2 limit 10""")
def q46_impact_both(spark, d):
    g = graph(spark, d)
    seed = g.node("trait").select("id").orderBy("id").limit(1)
    both = [P.expand(g.edges, seed, 2, direction=x).select(F.lit(x).alias("direction"), F.col("end").alias("id")) for x in ("out", "in")]
    return both[0].unionByName(both[1]).join(g.nodes.select("id", "name"), "id").distinct().orderBy("direction", "id").limit(10).select("direction", "id", "name")


@query(f"""with {N}, {E}, s as (select e.src, e.dst from e join n on n.id = e.src where e.type = 'CALLS' and n.type in ('ReactComponent', 'TSFunction')), h as (select e.src, e.dst from e join n on n.id = e.src where e.type = 'CALLS_STATIC' and n.type in ('class', 'function'))
select m.id, m.name as endpoint, a.n as calls, b.n as handlers, a.n * b.n as chains from (select dst, count(*) as n from s group by 1) a join (select dst, count(*) as n from h group by 1) b using (dst) join n m on m.id = dst""")
def q47_cross_language(spark, d):
    g = graph(spark, d)
    a = P.expand1(g, "CALLS", src=F.col("s_type").isin("ReactComponent", "TSFunction")).select(F.col("t_id").alias("id"), F.col("t_name").alias("endpoint"))
    b = P.expand1(g, "CALLS_STATIC", src=F.col("s_type").isin("class", "function")).select(F.col("t_id").alias("id"))
    # both sides as one state per endpoint; the chains through a hot endpoint are counted, never made
    x, y = _count(a, "id", "endpoint", name="calls"), _count(b, "id", name="handlers")
    return x.join(y, "id").select("id", "endpoint", "calls", "handlers", (F.col("calls") * F.col("handlers")).alias("chains"))


@query(f"""with recursive {N}, {PE}, t(root, id, depth) as (select id, id, 0 from n where type = 'directory' and name = 'src' union all select t.root, pe.dst, t.depth + 1 from t join pe on pe.src = t.id where t.depth < 3 and pe.type = 'CONTAINS')
select t.root, count(distinct pe.dst) as symbols from t join pe on pe.src = t.id where pe.type = 'DEFINES' group by 1""")
def q48_mixed_path(spark, d):
    g = tree(spark, d)
    p = P.expand(g.edge("CONTAINS"), g.nodes.where("type = 'directory' and name = 'src'"), 3, 0).select("start", F.col("end").alias("src"))
    return p.join(g.edge("DEFINES").select("src", "dst"), "src").groupBy(F.col("start").alias("root")).agg(F.countDistinct("dst").alias("symbols"))


@query(f"with {N} select id, name from n where regexp_full_match(name, '(?i).*(cache|ledger).*')")
def q49_regex(spark, d):
    return graph(spark, d).nodes.where(F.col("name").rlike("^(?:(?i).*(cache|ledger).*)$")).select("id", "name")


@query(f"with {N} select type, count(*) as n from n where type in ('class', 'interface', 'trait', 'method', 'function') group by 1")
def q51_types_in(spark, d):
    return _count(graph(spark, d).nodes.where(F.col("type").isin("class", "interface", "trait", "method", "function")), "type")
