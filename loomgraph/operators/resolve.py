"""Name resolution as a priority join, external placeholders, endpoint and file links, registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.staging import insert_first

# Node types a class-like name can mean; builtin type names; keywords for the own class.
RESOLVABLE = ["class", "interface", "trait", "function", "namespace", "enum"]
BUILTIN_TYPES = ["int", "string", "bool", "float", "array", "object", "void", "mixed", "null", "resource", "callable"]
SELF_WORDS = ["self", "static"]
# Parts of the project's root namespace that unresolved short names are tried in, in order.
FALLBACK_PARTS = ["Core", "Entities", "Services", "Controllers", "Repositories", "Tools", "ORM", "Modules\\Crm", "Classes"]


def fallback_namespaces(root: str) -> list[str]:
    """The nine namespaces under ``root`` that a name is tried in before its last part alone is looked for."""
    return [f"{root}\\{part}" for part in FALLBACK_PARTS]


def clean_type(c: str | Column) -> Column:
    """A written type as a name: no leading ``?``, no trailing ``[]``, builtins as null."""
    t = F.regexp_replace(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^\?", ""), r"(\[\])+$", "")
    return F.when(~F.lower(t).isin(BUILTIN_TYPES) & (t != ""), t)


def _last(name: Column) -> Column:
    return F.substring_index(name, "\\", -1)


def candidates(refs: DataFrame, fallback: list[str] | None = None) -> DataFrame:
    """refs (ref_id, name, namespace, imports array<string>) -> (ref_id, prio, key, suffix).

    Priorities: 1 a leading backslash is absolute, 2 an import whose last part is the name's first
    part, 3 the own namespace, 4 the name as it is, 5 any name ending in it (names without backslash).
    Names that look like file paths have no candidates.
    """
    n, first = F.col("name"), F.substring_index("name", "\\", 1)
    rest = F.when(F.instr("name", "\\") > 0, F.concat(F.lit("\\"), F.expr("substring(name, instr(name, '\\\\') + 1)"))).otherwise("")
    listed = F.coalesce("imports", F.array().cast("array<string>"))
    imported = F.get(F.filter(listed, lambda i: F.lower(F.substring_index(i, "\\", -1)) == F.lower(first)), 0)
    absolute = n.startswith("\\")
    extra = fallback or []
    key = lambda prio, when, value: F.struct(F.lit(prio).alias("prio"), F.when(when, value).alias("key"), F.lit(False).alias("suffix"))
    keys = F.array(
        key(1, absolute, F.ltrim(n, F.lit("\\"))),
        key(2, ~absolute, F.concat(imported, rest)),
        key(3, ~absolute & (F.coalesce("namespace", F.lit("")) != ""), F.concat("namespace", F.lit("\\"), n)),
        key(4, ~absolute, n),
        *[key(5 + i, ~absolute, F.concat(F.lit(space + "\\"), n)) for i, space in enumerate(extra)],
        F.struct(F.lit(5 + len(extra)).alias("prio"), F.when(~absolute & (F.instr("name", "\\") == 0), F.lower(n)).alias("key"), F.lit(True).alias("suffix")),
    )
    ok = n.isNotNull() & ~n.rlike(r"(^/)|(/.*\.\w+$)")
    return refs.where(ok).select("ref_id", F.inline(keys)).where("key is not null")


def resolve(refs: DataFrame, nodes: DataFrame, fallback: list[str] | None = None) -> DataFrame:
    """(ref_id, target_id, prio): the best match of every reference that has one; among equals the least
    id. Resolution looks at the final set of symbols, so its result does not depend on any order."""
    known = nodes.where(F.col("type").isin(RESOLVABLE)).select(F.col("id").alias("target_id"), F.col("name").alias("full"))
    # one target per key, so that a frequent short name cannot multiply rows
    exact = known.groupBy(F.col("full").alias("key")).agg(F.min("target_id").alias("target_id"))
    short = known.where(F.instr("full", "\\") > 0).groupBy(F.lower(_last(F.col("full"))).alias("key")).agg(F.min("target_id").alias("target_id"))
    c = candidates(refs, fallback)
    hits = c.where("not suffix").join(exact, "key").unionByName(c.where("suffix").join(short, "key"))
    return hits.groupBy("ref_id").agg(F.min(F.struct("prio", "target_id")).alias("b")).select("ref_id", F.col("b.target_id").alias("target_id"), F.col("b.prio").alias("prio"))


def externals(refs: DataFrame, resolved: DataFrame, own_root: str | None = None) -> DataFrame:
    """Placeholder symbols (id, name, type, file_path) for names that resolve to nothing. Names under the
    project's ``own_root`` should have been found and are marked ``<unresolved>`` for review."""
    lost = refs.join(resolved.select("ref_id"), "ref_id", "left_anti").where("name is not null").select(F.ltrim("name", F.lit("\\")).alias("name")).distinct()
    kind = F.when(F.col("name").contains("Interface"), "interface").when(F.col("name").contains("Trait"), "trait").otherwise("class")
    return lost.select(F.concat(F.lit("external_"), F.md5("name")).alias("id"), "name", kind.alias("type"), (F.lit("<external>") if own_root is None else F.when(F.col("name").startswith(own_root), "<unresolved>").otherwise("<external>")).alias("file_path"))


def members(refs: DataFrame, resolved: DataFrame, nodes: DataFrame, member: str, kind: str) -> DataFrame:
    """(ref_id, member_id): the member ``refs.<member>`` of type ``kind`` of the resolved class."""
    kids = nodes.where(F.col("type") == kind).select(F.col("parent_id").alias("target_id"), F.col("name").alias(member), F.col("id").alias("member_id"))
    kids = kids.groupBy("target_id", member).agg(F.min("member_id").alias("member_id"))
    return refs.select("ref_id", member).join(resolved, "ref_id").join(kids, ["target_id", member]).select("ref_id", "member_id")


def unresolved_report(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Unresolved references by kind: how many and how many distinct names."""
    lost = refs.join(resolved.select("ref_id"), "ref_id", "left_anti")
    return lost.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def registrations(config: DataFrame, nodes: DataFrame) -> DataFrame:
    """Classes registered in configuration files; of repeated (file, key, class) rows the first counts."""
    first = insert_first(config, ["config_file", "config_key", "class_name"], ["id"])
    classes = nodes.where("type = 'class'").select(F.col("id").alias("class_id"), "name")
    return first.join(classes, F.col("class_name") == F.col("name")).select(F.col("class_id").alias("id"), "name", "config_file", "config_key", "reference_type")


def endpoints(nodes: DataFrame, suffix: str, action: str) -> DataFrame:
    """Endpoint keys of controllers: (class_id, method_id, key) with key ``base[/action/name]`` in lower
    case for methods that begin with ``action``."""
    c = nodes.where((F.col("type") == "class") & F.lower("name").endswith(suffix.lower())).select(F.col("id").alias("class_id"), F.lower(F.replace(_last(F.col("name")), F.lit(suffix), F.lit(""))).alias("base"))
    m = nodes.where((F.col("type") == "method") & F.lower("name").startswith(action.lower())).select(F.col("parent_id").alias("class_id"), F.col("id").alias("method_id"), F.expr(f"substring(name, {len(action) + 1})").alias("act"))
    return c.join(m, "class_id").select("class_id", "method_id", F.concat("base", F.lit("/action/"), F.lower("act")).alias("key"), F.concat("base", F.lit("/"), F.lower("act")).alias("short_key"))


def link_calls(calls: DataFrame, ends: DataFrame) -> DataFrame:
    """calls (call_id, key) to endpoints: the full key first, the key without ``/action/`` otherwise."""
    full = ends.groupBy("key").agg(F.max("method_id").alias("m1"))
    short = ends.groupBy(F.col("short_key").alias("key")).agg(F.max("method_id").alias("m2"))
    return calls.join(full, "key", "left").join(short, "key", "left").select("call_id", F.coalesce("m1", "m2").alias("method_id")).where("method_id is not null")


def file_links(nodes: DataFrame) -> DataFrame:
    """(file_id, symbol_id): every symbol with the row of its file, by path."""
    files = nodes.where("type = 'file'").groupBy("file_path").agg(F.min("id").alias("file_id"))
    rest = nodes.where(~F.col("id").startswith("file_") & ~F.col("id").startswith("dir_")).select(F.col("id").alias("symbol_id"), "file_path")
    return rest.join(files, "file_path").select("file_id", "symbol_id")


def defines_repair(nodes: DataFrame) -> DataFrame:
    """(class_id, method_id): classes and methods of the same file and the same namespace (null-safe)."""
    c = nodes.where("type = 'class'").select(F.col("id").alias("class_id"), "file_path", F.col("namespace").alias("cn"))
    m = nodes.where("type = 'method'").select(F.col("id").alias("method_id"), "file_path", F.col("namespace").alias("mn"))
    return c.join(m, (c["file_path"] == m["file_path"]) & c["cn"].eqNullSafe(m["mn"])).select("class_id", "method_id")


def class_word(name: str, own: str, parent: str) -> Column:
    """``self`` and ``static`` mean the own class, ``parent`` its base; other names stay."""
    low = F.lower(name)
    return F.when(low.isin(SELF_WORDS), F.col(own)).when(low == "parent", F.col(parent)).otherwise(F.col(name))


def loads_via_config(registered: DataFrame, nodes: DataFrame, manager: str) -> DataFrame:
    """(src, dst): the manager class to every registered class. The manager is one id, read as a scalar."""
    one = nodes.where((F.col("type") == "class") & (F.col("name") == manager)).agg(F.min("id")).scalar()
    return registered.select(one.alias("src"), F.col("id").alias("dst")).where("src is not null").distinct()
