"""Queries of the general problems 1, 3 and 4, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import hierarchy, integrity, skew
from loomgraph.session import load


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return integrity.orphans(load(spark, d, "symbols"), load(spark, d, "symbol_references"), load(spark, d, "symbol_deletions"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = integrity.direct_orphans(load(spark, d, "symbols"), load(spark, d, "symbol_references"), load(spark, d, "symbol_deletions"))
    return found.select("table_name", "field_name", "row_id")


def p1_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "field_name", "row_id", "key_md5", "kind", "reason", F.col("level").cast("int").alias("level"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return integrity.orphan_report(_orphans(spark, d)).withColumn("period", F.date_format("period", "yyyy-MM"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.roots_and_depths(load(spark, d, "symbols"))


def p3_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(load(spark, d, "symbols")).select("id", "root_id", "depth", "path", "n_descendants")


def p3_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Preorder intervals; the numbering of siblings is free, so rows only are compared."""
    return hierarchy.hierarchy(load(spark, d, "symbols")).where("depth >= 0").select("id", "root_id", "pre", "last")


def p3_trees(spark: SparkSession, d: str) -> DataFrame:
    """Per tree what its intervals must satisfy: they number the nodes without a gap, and their lengths add up
    to the depths."""
    h = hierarchy.hierarchy(load(spark, d, "symbols")).where("depth >= 0")
    return h.groupBy("root_id").agg(
        F.count("*").alias("nodes"), F.min("pre").alias("first"), F.max("last").alias("last"), F.countDistinct("pre").alias("numbers"), F.sum(F.col("last") - F.col("pre")).alias("below"), F.max("depth").cast("int").alias("deepest")
    )


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(load(spark, d, "symbols"))


def _per_key(spark: SparkSession, d: str) -> DataFrame:
    return skew.per_key(load(spark, d, "symbol_references"), load(spark, d, "symbols"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy(load(spark, d, "symbol_references"), load(spark, d, "symbols")).select("target_id", "reference_type")


def p4_heavy(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy(load(spark, d, "symbol_references"), load(spark, d, "symbols"))


def p4_per_key(spark: SparkSession, d: str) -> DataFrame:
    return _per_key(spark, d)


def p4_per_target_type(spark: SparkSession, d: str) -> DataFrame:
    return skew.per_target_type(load(spark, d, "symbol_references"), load(spark, d, "symbols"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_cascade, p1_report, p3_found, p3_hierarchy, p3_intervals, p3_trees, p3_descendants, p4_found, p4_heavy, p4_per_key, p4_per_target_type)
}

_CURRENT = """
cur as (select * exclude (rn) from (select *, row_number() over (partition by id order by updated_at desc nulls last, parent_id desc nulls last) rn from symbols where id is not null) where rn = 1)
"""

_DIRECT = f"""{_CURRENT},
span as (select id, min(created_at) as first_created, max(created_at) as last_created from symbols where id is not null group by id),
gone as (select symbol_id as id, max(deleted_at) as deleted_at from symbol_deletions where symbol_id is not null group by symbol_id),
status as (select s.id, first_created, coalesce(deleted_at > last_created, false) as removed from span s left join gone g on g.id = s.id),
refs as (select distinct id, source_id, target_id, created_at from symbol_references where id is not null),
keyed as (
  select 'symbols' as table_name, 'parent_id' as field_name, id as row_id, parent_id as k, updated_at as "at" from cur where parent_id is not null
  union all select 'symbol_references', 'source_id', cast(id as varchar), source_id, created_at from refs where source_id is not null
  union all select 'symbol_references', 'target_id', cast(id as varchar), target_id, created_at from refs where target_id is not null),
judged as (
  select table_name, field_name, row_id, k, "at", case when s.id is null then 'missing' when removed then 'removed' when first_created > "at" then 'later' end as reason
  from keyed left join status s on s.id = keyed.k),
direct as (select * from judged where reason is not null)"""

_CASCADE = f"""{_DIRECT},
chain(id, level) as (
  select row_id, 0 from direct where table_name = 'symbols'
  union all select c.id, chain.level + 1 from chain join cur c on c.parent_id = chain.id
    where c.id not in (select row_id from direct where table_name = 'symbols') ),
marks as (select id, min(level) + 1 as level from chain group by id),
every as (
  select table_name, field_name, row_id, k, "at", 'direct' as kind, reason, 0 as level from direct
  union all select j.table_name, j.field_name, j.row_id, j.k, j."at", 'inherited', 'parent chain', m.level from judged j join marks m on m.id = j.k where j.reason is null)"""

_DEPTHS = f"""{_CURRENT},
up as (select c.id, c.name, case when p.id is not null then p.id end as parent from cur c left join (select distinct id from cur) p on p.id = c.parent_id),
tree(id, root_id, depth, path) as (
  select id, id, 0, coalesce(name, '') from up where parent is null
  union all select u.id, t.root_id, t.depth + 1, t.path || '/' || coalesce(u.name, '') from tree t join up u on u.parent = t.id),
lost as (select id, parent from up where id not in (select id from tree)),
walk(start, cur, path) as (
  select id, id, [id] from lost
  union all select w.start, l.parent, list_append(w.path, l.parent) from walk w join lost l on l.id = w.cur where not list_contains(w.path, l.parent)),
ring as (
  select w.start as id, list_min(w.path[list_position(w.path, l.parent):]) as root_id
  from walk w join lost l on l.id = w.cur where list_contains(w.path, l.parent))"""

_STATES = """
refs as (select target_id, upper(replace(reference_type, '-', '_')) as reference_type, source_id from symbol_references)"""

ORACLE: dict[str, str] = {
    "p1_found": f"with {_DIRECT} select table_name, field_name, row_id from direct",
    "p1_cascade": f"with recursive {_CASCADE} select table_name, field_name, row_id, md5(k) as key_md5, kind, reason, cast(level as integer) as level from every",
    "p1_report": f"""with recursive {_CASCADE} select table_name, field_name, strftime(date_trunc('month', "at"), '%Y-%m') as period, kind, reason, count(*) as orphans from every group by 1, 2, 3, 4, 5""",
    "p3_found": f"with recursive {_DEPTHS} select id, root_id, cast(depth as integer) as depth from tree union all select id, root_id, cast(-1 as integer) from ring",
    "p3_hierarchy": f"""with recursive {_DEPTHS},
anc(anc, id) as (select parent, id from up where parent is not null and id in (select id from tree) union all select u.parent, a.id from anc a join up u on u.id = a.anc where u.parent is not null),
n as (select anc, count(*) as n from anc group by anc)
select t.id, root_id, cast(depth as integer) as depth, path, coalesce(n.n, 0) as n_descendants from tree t left join n on n.anc = t.id
union all select id, root_id, cast(-1 as integer), null, null from ring""",
    "p3_trees": f"""with recursive {_DEPTHS} select root_id, count(*) as nodes, cast(0 as bigint) as first, count(*) - 1 as last, count(*) as numbers, cast(sum(depth) as bigint) as below, cast(max(depth) as integer) as deepest from tree group by 1""",
    "p3_descendants": f"""with recursive {_DEPTHS},
anc(anc, id, distance) as (select parent, id, 1 from up where parent is not null and id in (select id from tree) union all select u.parent, a.id, a.distance + 1 from anc a join up u on u.id = a.anc where u.parent is not null)
select anc as ancestor_id, id as descendant_id, cast(distance as integer) as distance from anc""",
    "p4_found": f"with {_STATES} select target_id, reference_type from refs group by 1, 2 having count(*) >= 0.01 * (select count(*) from refs)",
    "p4_heavy": f"""with {_STATES}, stored as (select id, count(*) as n from symbols group by id),
k as (select target_id, reference_type, count(*) as n_rows from refs group by 1, 2 having count(*) >= 0.01 * (select count(*) from refs))
select target_id, reference_type, n_rows, coalesce(n, 0) as stored_rows, n_rows * coalesce(n, 0) as joined_rows from k left join stored s on s.id = k.target_id""",
    "p4_per_key": f"""with {_STATES},
stored as (select id, count(*) as n from symbols group by id),
k as (select target_id, reference_type, count(*) as n_rows, count(distinct source_id) as n_sources from refs group by 1, 2)
select target_id, reference_type, n_rows, n_sources, coalesce(n, 0) as stored_rows, n_rows * coalesce(n, 0) as joined_rows, n_rows >= 0.01 * (select count(*) from refs) as is_heavy
from k left join stored s on s.id = k.target_id""",
    "p4_per_target_type": f"""with {_STATES}
select s.type as target_type, r.reference_type, count(*) as joined_rows, count(distinct r.target_id) as n_targets from refs r join symbols s on s.id = r.target_id group by 1, 2""",
}
