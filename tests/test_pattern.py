import itertools
import random

import pytest

from loomgraph.operators import pattern as P
from loomgraph.operators.graph import PropertyGraph

EDGES = [(1, "a", "b"), (2, "b", "c"), (3, "c", "a"), (4, "a", "b"), (5, "c", "d"), (6, "d", "d"), (7, "e", "a")]


def graph(spark, edges=EDGES):
    nodes = spark.createDataFrame([(n, n.upper(), "class", "class", "f") for n in sorted({x for _, a, b in edges for x in (a, b)} | {"z"})], "id string, name string, type string, label string, file_path string")
    return PropertyGraph(nodes, spark.createDataFrame([(i, a, b, "CALLS") for i, a, b in edges], "eid long, src string, dst string, type string"))


def trails(edges, start, lo, hi):
    out = []

    def go(at, path):
        if len(path) >= lo:
            out.append((start, at, tuple(path)))
        if len(path) < hi:
            for i, a, b in edges:
                if a == at and i not in path:
                    go(b, [*path, i])

    go(start, [])
    return sorted(out)


@pytest.mark.parametrize("lo,hi", [(1, 3), (0, 2), (2, 4)])
def test_expand_is_edge_unique(spark, lo, hi):
    g = graph(spark)
    got = sorted((r["start"], r["end"], tuple(r["path"])) for r in P.expand(g.edges, g.nodes.where("id in ('a', 'd', 'z')"), hi, lo).collect())
    assert got == sorted(itertools.chain(*(trails(EDGES, s, lo, hi) for s in "adz")))


def test_reach_is_distinct_of_expand(spark):
    rnd = random.Random(2)
    edges = [(i, f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}") for i in range(18)]
    g = graph(spark, edges)
    for direction in ("out", "in"):
        r = {(x["start"], x["end"]): x["distance"] for x in P.reach(g.edges, g.nodes, 3, direction).collect()}
        want = {}
        for x in P.expand(g.edges, g.nodes, 3, 1, direction).collect():
            k = x["start"], x["end"]
            want[k] = min(want.get(k, 9), x["length"])
        assert r == want


@pytest.mark.parametrize("seed", [1, 2])
def test_path_counts_are_counts_of_trails(spark, rows, seed):
    """Random graphs with loops, repeated edges and long tails: counts equal the enumerated trails, also
    without a bound, from repeated starts, and when only some ends are asked."""
    rnd = random.Random(seed)
    edges = [(i, f"n{rnd.randrange(7)}", f"n{rnd.randrange(7)}") for i in range(8)] + [(50 + i, f"t{i}", f"t{i + 1}") for i in range(9)] + [(70, "n0", "t0"), (71, "t2", "n1"), (72, "t3", "t4")]
    g = graph(spark, edges)
    names = sorted({x for _, a, b in edges for x in (a, b)})

    def want(lo, hi, ends=names):
        out = {}
        for s in names:
            for _, z, p in trails(edges, s, lo, hi):
                if z in ends:
                    out[s, z, len(p)] = out.get((s, z, len(p)), 0) + 1
        return sorted((*k, n) for k, n in out.items())

    cols = ["start", "end", "length", "n_paths"]
    assert rows(P.path_counts(g.edges, g.nodes, 4), *cols) == sorted(want(1, 4), key=str)
    assert rows(P.path_counts(g.edges, g.nodes, 3), *cols) == sorted(want(1, 3), key=str)
    assert rows(P.path_counts(g.edges, g.nodes, None, 3), *cols) == sorted(want(3, 99), key=str)
    assert rows(P.path_counts(g.edges, g.nodes, 4, 2, ends=g.nodes.where("id in ('n1', 't5')")), *cols) == sorted(want(2, 4, ["n1", "t5"]), key=str)
    two = g.nodes.where("id = 't0'")
    assert rows(P.path_counts(g.edges, two.unionByName(two), 1), *cols) == [("t0", "t1", 1, 2)]
    assert rows(P.cycle_counts(g.edges, 5), "id", "length", "n_cycles") == sorted(((s, k, n) for s, z, k, n in want(2, 5) if s == z), key=str)
    r = {(x["start"], x["end"]): x["distance"] for x in P.reach(g.edges, g.nodes, 3, ends=g.nodes.where("id in ('n1', 't5')")).collect()}
    every = {(x["start"], x["end"]): x["distance"] for x in P.reach(g.edges, g.nodes, 3).collect()}
    assert r == {k: v for k, v in every.items() if k[1] in ("n1", "t5")}


def test_paths_of_nothing(spark):
    g = graph(spark)
    none = g.edges.where("false")
    assert P.path_counts(none, g.nodes, None).count() == 0 and P.cycle_counts(none, 4).count() == 0 and P.reach(none, g.nodes, 2).count() == 0
    assert P.path_counts(g.edges, g.nodes.where("false"), 3).count() == 0


def test_a_chain_deeper_than_any_old_bound(spark):
    edges = [(i, f"n{i}", f"n{i + 1}") for i in range(25)]
    g = graph(spark, edges)
    assert P.closure(g.edges, g.nodes.where("id = 'n0'")).count() == 25


def test_cycles_have_a_row_per_rotation(spark, rows):
    assert rows(P.cycles(graph(spark).edges, 4, 2), "id", "length") == sorted([(n, 3) for n in "abc" for _ in range(2)])


def test_closure(spark, rows):
    g = graph(spark)
    assert rows(P.closure(g.edges, g.nodes.where("id = 'e'")), "id", "distance") == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    assert P.closure(g.edges, g.nodes.where("id = 'z'")).count() == 0


def test_degrees_exists_optional(spark, rows):
    g = graph(spark)
    assert ("z", 0, 0) in rows(P.degrees(g)) and ("a", 2, 2) in rows(P.degrees(g))
    assert rows(P.lacking_edge(g.nodes, g.edges, "dst"), "id") == [("e",), ("z",)]
    n = rows(P.neighbours(g, g.nodes.select("id"), "CALLS"), "id", "direction", "other")
    assert [x for x in n if x[0] in "az"] == [("a", "in", "C"), ("a", "in", "E"), ("a", "out", "B"), ("z", None, None)]


def test_written_graph_reads_back(spark, tmp_path, rows):
    g = graph(spark)
    g.nodes.write.partitionBy("label").parquet(f"{tmp_path}/nodes")
    g.edges.write.partitionBy("type").parquet(f"{tmp_path}/edges")
    back = spark.read.parquet(f"{tmp_path}/edges").where("type = 'CALLS'")
    assert rows(back, "eid") == rows(g.edges, "eid")
    assert "PartitionFilters: [isnotnull(type" in back._jdf.queryExecution().toString()
