import random
from datetime import datetime

import pytest

from loomgraph.operators import hierarchy as H

SCHEMA = "id string, name string, parent_id string, updated_at timestamp_ntz, n long, p string, size long, head string"
T0, T1 = datetime(2025, 1, 1), datetime(2025, 2, 1)


def frame(spark, links):
    """links: (id, parent) or (id, parent, time); clashing extra columns are there on purpose."""
    return spark.createDataFrame([(x[0], f"n{x[0]}", x[1], x[2] if len(x) > 2 else T0, 1, "x", 9, "h") for x in links], SCHEMA)


def brute(links):
    now = {}
    for i, p, *t in links:
        if i is not None and (i not in now or (t[0] if t else T0) >= now[i][1]):
            now[i] = (p, t[0] if t else T0)
    out = {}
    for i in now:
        path, cur = [i], i
        while now[cur][0] in now and now[cur][0] not in path:
            cur = now[cur][0]
            path.append(cur)
        nxt = now[cur][0]
        out[i] = (min(path[path.index(nxt):]), -1) if nxt in now else (cur, len(path) - 1)
    return out


def check(spark, links):
    df = frame(spark, links)
    want = brute(links)
    got = {r.id: (r.root_id, r.depth) for r in H.roots_and_depths(df).collect()}
    assert got == want
    full = {r.id: r for r in H.hierarchy(df).collect()}
    assert {k: (r.root_id, r.depth) for k, r in full.items()} == want
    parents = {i: p for i, p, *_ in links}
    for i, r in full.items():
        if r.depth >= 0:
            below = [k for k, o in full.items() if o.root_id == r.root_id and o.depth >= 0 and r.pre < o.pre <= r.last]
            assert len(below) == r.n_descendants
            for k in below:
                while k != i:
                    k = parents[k]
            assert r.path.count("/") == r.depth
        else:
            assert r.path is None and r.pre is None
    pairs = {(r.ancestor_id, r.descendant_id, r.distance) for r in H.descendants(df).collect()}
    expect = set()
    for i, (_, d) in want.items():
        cur = i
        for k in range(1, d + 1):
            cur = parents[cur]
            expect.add((cur, i, k))
    assert pairs == expect


def test_random_forest_with_loops(spark):
    rnd = random.Random(3)
    links = [(f"a{i}", f"a{rnd.randrange(max(1, i))}" if i and rnd.random() < 0.9 else None) for i in range(60)]
    links += [("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("t1", "c2"), ("t2", "t1"), ("s", "s"), ("u", "s"), ("d1", "gone")]
    check(spark, links)


def test_deep_chain(spark):
    check(spark, [(f"k{i:03}", f"k{i - 1:03}" if i else None) for i in range(70)])


def test_wide_parent(spark):
    check(spark, [("r", None)] + [(f"w{i}", "r") for i in range(200)])


def test_current_row_repeats_and_nulls(spark):
    links = [("a", None), ("b", "x", T0), ("b", "a", T1), ("b", "a", T1), (None, "a"), ("c", "b")]
    got = {r.id: (r.root_id, r.depth) for r in H.roots_and_depths(frame(spark, links)).collect()}
    assert got == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2)}


@pytest.mark.parametrize("f", [H.roots_and_depths, H.hierarchy, H.descendants])
def test_empty(spark, f):
    assert f(frame(spark, [])).count() == 0
