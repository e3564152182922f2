"""Graph patterns: one-hop and variable-length expansion, reachability, cycles, degrees, optional parts.

Paths follow the usual pattern semantics: edges are unique within a path, nodes may repeat, and each
path is a row. ``expand`` enumerates such paths and therefore demands an upper bound. Where only their
number is asked, ``path_counts`` adds them up per end and level; where only the set of reached nodes is
asked, ``reach`` keeps a frontier of distinct nodes and never expands a node twice for a start. Both can
be told the ends that matter and then leave out whatever cannot come to one in the steps that remain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import PropertyGraph
from loomgraph.session import Cuts, maybe_broadcast


def _oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b, eid): walk from a to b."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "eid")
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "eid")
    return {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back.where("a <> b"))}[direction]()


def expand1(g: PropertyGraph, *types: str, src: Column | None = None, dst: Column | None = None) -> DataFrame:
    """``(s)-[r:T]->(t)``: columns s_*, r_type, eid, t_*; conditions on s_/t_ columns reach the scans."""
    s = g.nodes.select(F.col("id").alias("s_id"), F.col("name").alias("s_name"), F.col("type").alias("s_type"), F.col("label").alias("s_label"), F.col("file_path").alias("s_file"))
    t = g.nodes.select(F.col("id").alias("t_id"), F.col("name").alias("t_name"), F.col("type").alias("t_type"), F.col("label").alias("t_label"), F.col("file_path").alias("t_file"))
    s = s if src is None else s.where(src)
    t = t if dst is None else t.where(dst)
    e = g.edge(*types).select(F.col("src").alias("s_id"), F.col("dst").alias("t_id"), F.col("type").alias("r_type"), "eid")
    return e.join(s, "s_id").join(t, "t_id")


def expand(edges: DataFrame, start: DataFrame, max_len: int, min_len: int = 1, direction: str = "out") -> DataFrame:
    """Paths from the ids of ``start``: (start, end, length, path) with ``path`` the edge ids."""
    e = _oriented(edges, direction)
    level = start.select(F.col("id").alias("start"), F.col("id").alias("end"), F.lit(0).alias("length"), F.array().cast("array<bigint>").alias("path"))
    found = [level] if min_len == 0 else []
    for n in range(1, max_len + 1):
        step = level.join(e, level["end"] == e["a"]).where(~F.array_contains("path", F.col("eid")))
        level = step.select("start", F.col("b").alias("end"), F.lit(n).alias("length"), F.concat("path", F.array("eid")).alias("path"))
        if n >= min_len:
            found.append(level)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _to_go(cuts: Cuts, e: DataFrame, ends: DataFrame | None, max_len: int) -> DataFrame:
    """Steps (a, b, ..) with ``to_go``, the least number of further steps to one of ``ends``; others are left out.
    Without ``ends`` nothing is left out, and nothing written."""
    if ends is None:
        return e.withColumn("to_go", F.lit(0))
    e = cuts.write(e)
    near = ends.select(F.col("id").alias("b")).distinct().withColumn("to_go", F.lit(0))
    for _ in range(1, max_len):  # a step keeps what it reached from and adds what leads there: one chain of joins
        far = F.inline(F.array(F.struct("a", (F.col("to_go") + 1).alias("to_go")), F.struct(F.col("b").alias("a"), "to_go")))
        near = e.join(near, "b").select(far).groupBy(F.col("a").alias("b")).agg(F.min("to_go").alias("to_go"))
    return e.join(near, "b")


def reach(edges: DataFrame, start: DataFrame, max_len: int, direction: str = "out", per_start: bool = True, ends: DataFrame | None = None) -> DataFrame:
    """Nodes within ``max_len`` steps: (start, end, distance), distance the least; the start itself only
    when a cycle leads back to it. Without ``per_start`` the starts are one set (start is null). With
    ``ends`` only these are returned."""
    cuts = Cuts(edges.sparkSession, "reach")
    e = _oriented(edges, direction).select("a", "b").distinct()
    e = cuts.write(_to_go(cuts, e, ends, max_len))
    known = start.select(F.col("id").alias("start") if per_start else F.lit(None).cast("string").alias("start"), F.col("id").alias("end")).distinct()
    known = known.select("start", "end", F.lit(0).alias("distance"), F.lit(1).alias("to_go"))
    for n in range(1, max_len + 1):
        last = known.where(F.col("distance") == n - 1).select("start", "end")
        step = last.join(e.where(F.col("to_go") <= max_len - n), F.col("end") == F.col("a")).select("start", F.col("b").alias("end"), F.lit(n).alias("distance"), "to_go")
        # the starts themselves are no result; where a cycle leads back they get a distance of their own
        known = (known.where("distance > 0") if n > 1 else known.where("false")).unionByName(step).groupBy("start", "end").agg(F.min("distance").alias("distance"), F.min("to_go").alias("to_go"))
        if n % 2 == 0 and n < max_len:
            known = cuts.write(known)
    return cuts.finish((known if ends is None else known.where("to_go = 0")).select("start", "end", "distance"))


def _cyclic(cuts: Cuts, edges: DataFrame, before: int) -> DataFrame:
    """Edges (of which there are ``before``) among which all cycles lie: ends without a way in or out are peeled,
    three times a round, as long as a round takes out a third of the edges. What stays too many is harmless."""
    core = edges
    while True:
        core, left = cuts.write_counted(core_edges(core, 3))
        if 3 * left > 2 * before or not left:
            return core
        before = left


def path_counts(edges: DataFrame, start: DataFrame, max_len: int | None, min_len: int = 1, direction: str = "out", ends: DataFrame | None = None, all_cyclic: bool = False) -> DataFrame:
    """Number of edge-unique paths from the ids of ``start``: (start, end, length, n_paths).

    Paths that end in the same node after the same number of steps go on in the same ways, but for edges
    that they may not use again; and only an edge on a cycle can be met again. So a level holds one row per
    (start, end, set of cyclic edges used) with a count, and the paths themselves are never made; without
    cycles that is one row per (start, end). ``max_len`` None goes on until no path is left, which edge
    uniqueness ensures (with ``ends`` a bound is needed). ``all_cyclic`` tells that all edges lie on cycles."""
    cuts = Cuts(edges.sparkSession, "paths")
    e = _to_go(cuts, _oriented(edges, direction), ends, max_len or 1)
    if all_cyclic or direction == "both":  # both ways along an edge is a cycle
        e = e.withColumn("core", F.lit(True))
    elif max_len is not None and max_len <= 3:
        # within three steps an edge comes again only by a loop or by the way back
        back = e.select(F.col("a").alias("b"), F.col("b").alias("a")).distinct().withColumn("core", F.lit(True))
        e = cuts.write(e.join(back, ["a", "b"], "left").withColumn("core", F.coalesce("core", F.lit(False))))
    else:
        e, count = cuts.write_counted(e)
        core = _cyclic(cuts, e.select("eid", F.col("a").alias("src"), F.col("b").alias("dst")), count).select("eid", F.lit(True).alias("core"))
        e = e.join(core, "eid", "left").withColumn("core", F.coalesce("core", F.lit(False)))
        e = cuts.write(e)
    level = start.groupBy("id").agg(F.count("*").alias("n")).select(F.col("id").alias("start"), F.col("id").alias("end"), F.array().cast("array<bigint>").alias("used"), "n")
    size, n = 1, 0
    found: list[DataFrame] = []
    while size and (max_len is None or n < max_len):
        n += 1
        ways = e if ends is None else e.where(F.col("to_go") <= max_len - n)
        step = level.join(ways, level["end"] == e["a"]).where(~(F.col("core") & F.array_contains("used", F.col("eid"))))
        used = F.when(F.col("core"), F.array_sort(F.concat("used", F.array("eid")))).otherwise(F.col("used"))
        level = step.select("start", F.col("b").alias("end"), used.alias("used"), "n", "to_go").groupBy("start", "end", "used", "to_go").agg(F.sum("n").alias("n"))
        if max_len is None or (n % 2 == 0 and n < max_len):  # with a bound every second level is enough
            level, size = cuts.write_counted(level)
        if n >= min_len and size:
            found.append((level if ends is None else level.where("to_go = 0")).groupBy("start", "end").agg(F.sum("n").alias("n_paths")).select("start", "end", F.lit(n).alias("length"), "n_paths"))
        level = level.drop("to_go")
    out = reduce(DataFrame.unionByName, found) if found else level.select("start", "end", F.lit(0).alias("length"), F.col("n").alias("n_paths")).where("false")
    return cuts.finish(out)


def cycle_counts(edges: DataFrame, max_len: int, min_len: int = 2) -> DataFrame:
    """``(m)-[*min..max]->(m)`` counted: (id, length, n_cycles), every rotation at its own node."""
    cuts = Cuts(edges.sparkSession, "cycles")
    e, count = cuts.write_counted(edges.select("eid", "src", "dst"))
    core = _cyclic(cuts, e, count)
    n = path_counts(core, core.select(F.col("src").alias("id")).distinct(), max_len, min_len, all_cyclic=True).where("start = end")
    return n.select(F.col("start").alias("id"), "length", F.col("n_paths").alias("n_cycles"))


def closure(edges: DataFrame, start: DataFrame, direction: str = "out") -> DataFrame:
    """All nodes reachable from a set of starts: (id, distance); a fixpoint over a written frontier, which
    ends when a round reaches nothing new."""
    cuts = Cuts(start.sparkSession, "closure")
    e = cuts.write(_oriented(edges, direction).select("a", "b").distinct())
    frontier, size = cuts.write_counted(start.select("id").distinct().withColumn("distance", F.lit(0)))
    origin, found, n = frontier, None, 0
    while size:
        n += 1
        step = e.join(maybe_broadcast(frontier.select(F.col("id").alias("a")), size), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        step = step if found is None else step.join(found.select("id"), "id", "left_anti")
        frontier, size = cuts.write_counted(step.withColumn("distance", F.lit(n)))
        if size:
            found = frontier if found is None else found.unionByName(frontier)
    return cuts.finish(found if found is not None else origin.where("false"))


def core_edges(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges that can lie on a cycle: ends without a way in or out are peeled ``rounds`` times."""
    for _ in range(rounds):
        ends = edges.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))))
        inner = ends.groupBy("id").agg(F.max("o").alias("o"), F.max("i").alias("i")).where("o = 1 and i = 1")
        edges = edges.join(inner.select(F.col("id").alias("src")), "src", "left_semi").join(inner.select(F.col("id").alias("dst")), "dst", "left_semi")
    return edges


def cycles(edges: DataFrame, max_len: int, min_len: int = 2, peel: int = 1) -> DataFrame:
    """``(m)-[*min..max]->(m)``: (id, length, path), every rotation its own row."""
    core = core_edges(edges, peel)
    starts = core.select(F.col("src").alias("id")).distinct()
    return expand(core, starts, max_len, min_len).where("start = end").select(F.col("start").alias("id"), "length", "path")


def degrees(g: PropertyGraph, *types: str) -> DataFrame:
    """(id, out_degree, in_degree) of every node, 0 when there are none. Counts are partial aggregates."""
    e = g.edge(*types)
    one = lambda end, o: F.struct(F.col(end).alias("id"), F.lit(o).alias("o"), F.lit(1 - o).alias("i"))
    both = e.select(F.inline(F.array(one("src", 1), one("dst", 0))))
    d = both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return g.nodes.select("id").join(d, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))


def having_edge(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """``EXISTS``: nodes with an edge at ``end`` (src or dst)."""
    return nodes.join(edges.select(F.col(end).alias("id")), "id", "left_semi")


def lacking_edge(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """``NOT EXISTS``."""
    return nodes.join(edges.select(F.col(end).alias("id")), "id", "left_anti")


def neighbours(g: PropertyGraph, start: DataFrame, *types: str) -> DataFrame:
    """Two optional parts at once: (.., direction, other) with the distinct names of out- and in-neighbours, one
    row each, so that a hub's neighbours are never gathered; a start without any keeps one row of nulls."""
    names = g.nodes.select(F.col("id").alias("_o"), F.col("name").alias("other"))

    def side(a: str, b: str, direction: str) -> DataFrame:
        e = g.edge(*types).select(F.col(a).alias("id"), F.col(b).alias("_o")).join(start.select("id"), "id", "left_semi")
        return e.join(names, "_o").select("id", F.lit(direction).alias("direction"), "other").distinct()

    return start.join(side("src", "dst", "out").unionByName(side("dst", "src", "in")), "id", "left")
