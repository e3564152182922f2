"""Parent-child links to full hierarchies (problem 3): heavy-path decomposition.

Plan, every step a join or an aggregation over narrow rows of longs:

1. Each id gets a number; a parent that names no id is no parent, so its child is a root.
2. Leaves (nodes without children) are set aside; they hang off the skeleton of inner nodes.
3. *Cycle separation and subtree sizes* by pointer doubling on the skeleton. After round k a node
   knows its 2^k-th ancestor and the number of descendants nearer than 2^k; rounds end when no
   further node reaches a root. Whoever still has an ancestor then never reaches a root.
4. The *heavy child* of a node is the inner child with the largest subtree; heavy links form chains.
   Doubling along chains gives each node its chain head, its offset and the chain segment.
5. *Chains* form a tree of logarithmic depth: each round places the chains that hang off chains
   already placed, adding depth, root, path prefix and the start of the preorder interval.
6. Node values are chain value + offset: depth, root, path = prefix + segment, and the interval
   [pre, last] in which all descendants of the node (in the same root) have their pre.

No step is bound to the depth of the trees: rounds grow with its logarithm. A parent with very many
children never meets in one task: maxima and sums are partial aggregates, and the positions of
siblings are summed in two levels (buckets, then inside buckets).

Nodes on or below a cycle get depth -1 and, as root, the smallest id on the loop they enter; they
have no path and no interval. Null ids are ignored; a null or unknown parent makes a root; repeated
rows and earlier versions of an id are resolved to the current row (greatest updated_at; a tie is
broken by the greatest parent_id). Null names show as empty path steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.session import Cuts

#: Siblings of a parent are placed in buckets of about so many, as their counted number asks for.
SIBLINGS_A_BUCKET = 10_000


def _digest(c: str):
    return F.unhex(F.md5(F.col(c)))


def number_nodes(cuts: Cuts, symbols: DataFrame, with_names: bool) -> tuple[DataFrame, DataFrame]:
    """(n, id[, name]) and (n, p): p is the number of the parent or null for roots."""
    value = ["updated_at", "parent_id", "name"] if with_names else ["updated_at", "parent_id"]
    now = (
        symbols.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.struct(*value)).alias("v"))
        .select("id", _digest("id").alias("k"), _digest("v.parent_id").alias("pk"), *([F.coalesce("v.name", F.lit("")).alias("name")] if with_names else []))
    )
    nodes = cuts.write(now.withColumn("n", F.monotonically_increasing_id()))
    links = cuts.write(
        nodes.select("n", "pk").alias("c")
        .join(nodes.where("k is not null").select(F.col("n").alias("p"), "k").alias("q"), F.col("c.pk") == F.col("q.k"), "left")
        .select("n", "p")
    )
    return nodes, links


def separate(cuts: Cuts, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Skeleton sizes, cyclic skeleton and leaves.

    ``(n, p, size)`` of inner nodes that reach a root; ``(n, p)`` of inner nodes that do not; and
    ``(n, p)`` of leaves, rooted or not.
    """
    kids = links.where("p is not null").groupBy("p").agg(F.count("*").alias("kids")).withColumnRenamed("p", "n")
    marked = cuts.write(links.join(kids, "n", "left"))
    leaves = marked.where("kids is null").select("n", "p")
    inner = marked.where("kids is not null").select("n", "p", "kids")
    # inner children are nodes of the skeleton themselves; only leaf children are counted here
    inner_kids = inner.where("p is not null").groupBy("p").agg(F.count("*").alias("inner_kids")).withColumnRenamed("p", "n")
    # Every table of ``parts`` has rows (n, jump, acc): where jump is null they are shares of a finished node's
    # size, else the nodes that still move. Only these are written again; finished nodes are never touched,
    # what reaches them later is one more share.
    moves = F.count(F.when(F.col("jump").isNotNull(), 1))
    state, active = cuts.write_counted(
        inner.join(inner_kids, "n", "left").select("n", F.col("p").alias("jump"), (F.lit(1) + F.col("kids") - F.coalesce("inner_kids", F.lit(0))).alias("acc")), moves
    )
    parts = [state]
    while active:
        moving = state.where("jump is not null")
        add = moving.groupBy(F.col("jump").alias("n")).agg(F.sum("acc").alias("add"))
        target = moving.select(F.col("n").alias("jump"), F.col("jump").alias("next"))
        reached = moving.join(add, "n", "full").select("n", "jump", (F.coalesce("acc", F.lit(0)) + F.coalesce("add", F.lit(0))).alias("acc"))
        nxt, left = cuts.write_counted(reached.join(target, "jump", "left").select("n", F.col("next").alias("jump"), "acc"), moves)
        state = nxt
        parts.append(nxt)
        if left == active:
            break
        active = left
    done = reduce(DataFrame.unionByName, (x.where("jump is null") for x in parts)).groupBy("n").agg(F.sum("acc").alias("size"))
    moving = state.where("jump is not null").select("n")
    tree = inner.select("n", "p").join(done, "n")
    if active:  # shares of nodes that never finish are none of a tree
        tree, cyclic = tree.join(moving, "n", "left_anti"), inner.select("n", "p").join(moving, "n", "left_semi")
    else:
        cyclic = inner.select("n", "p").where("false")
    return cuts.write(tree), cyclic, leaves


def loops(cuts: Cuts, cyclic: DataFrame, nodes: DataFrame) -> DataFrame:
    """(n, root_id) of skeleton nodes that never reach a root: the smallest id on the loop they enter.

    Doubling with the smallest id seen. The set of nodes pointed at shrinks until only loops are
    left; a minimum that no longer changes anywhere has then gone all the way round its loop.
    """
    state = cuts.write(cyclic.join(nodes.select("n", "id"), "n").select("n", F.col("p").alias("jump"), F.col("id").alias("low")))
    reached = -1
    while True:
        t = state.select(F.col("n").alias("jump"), F.col("jump").alias("next"), F.col("low").alias("low2"))
        nxt = cuts.write(state.join(t, "jump").select("n", F.col("next").alias("jump"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("sank")))
        seen = nxt.agg(F.countDistinct("jump").alias("jumps"), F.count(F.when(F.col("sank"), 1)).alias("sank")).first()
        cuts.drop(state)
        state = nxt
        if seen["jumps"] == reached and not seen["sank"]:
            break
        reached = seen["jumps"]
    at = state.select(F.col("n").alias("jump"), F.col("low").alias("root_id"))
    return state.select("n", "jump").join(at, "jump").select("n", "root_id")


def chains(cuts: Cuts, tree: DataFrame, names: DataFrame | None) -> DataFrame:
    """Skeleton nodes with their heavy child's size and their place on a chain:
    (n, p, size, heavy_size, head, off[, seg]); ``seg`` joins the names from the head to the node."""
    heavy = (
        tree.where("p is not null").groupBy("p").agg(F.max(F.struct("size", "n")).alias("h"))
        .select(F.col("p").alias("hp"), F.col("h.n").alias("n"), F.col("h.size").alias("hsize"))
    )
    on = (
        tree.join(heavy.select("n", "hp"), "n", "left")
        .join(heavy.select(F.col("hp").alias("n"), F.col("hsize").alias("heavy_size")), "n", "left")
        .withColumn("heavy_size", F.coalesce("heavy_size", F.lit(0)))
    )
    start = on.select("n", "p", "size", "heavy_size", F.coalesce("hp", "n").alias("head"), F.when(F.col("hp").isNotNull(), 1).otherwise(0).cast("long").alias("off"), F.col("hp").isNull().alias("done"))
    if names is not None:
        start = start.join(names, "n").withColumnRenamed("name", "seg")
    waits = F.count(F.when(~F.col("done"), 1))
    state, moving = cuts.write_counted(start, waits)
    facts = state.select("n", "p", "size", "heavy_size")
    cols = ["n", "head", "off", "done"] + (["seg"] if names is not None else [])
    finished, state = state.where("done").select(*cols), state.where("not done").select(*cols)
    while moving:
        t = finished.unionByName(state).select(F.col("n").alias("head"), F.col("head").alias("head2"), F.col("off").alias("off2"), F.col("done").alias("done2"), *([F.col("seg").alias("seg2")] if names is not None else []))
        moved = state.join(t, "head").select(
            "n", F.col("head2").alias("head"), (F.col("off") + F.col("off2")).alias("off"), F.col("done2").alias("done"),
            *([F.concat_ws("/", "seg2", "seg").alias("seg")] if names is not None else []),
        )
        # rows that point at a finished node are finished after this step and are not written again
        moved, moving = cuts.write_counted(moved, waits)
        finished, state = finished.unionByName(moved.where("done")), moved.where("not done")
    return cuts.write(facts.join(finished.drop("done"), "n"))


def sibling_offsets(kids: DataFrame) -> DataFrame:
    """(n, p, size) -> (n, p, light_off): sizes of the siblings before each node, summed in two levels. A
    parent has as many buckets as its children fill, so that no window grows with them."""
    buckets = kids.groupBy("p").agg(F.ceil(F.count("*") / SIBLINGS_A_BUCKET).alias("buckets"))
    b = kids.join(buckets, "p").withColumn("b", F.pmod(F.xxhash64("n"), F.col("buckets"))).drop("buckets")
    sums = b.groupBy("p", "b").agg(F.sum("size").alias("s"))
    base = sums.select("p", "b", (F.sum("s").over(W.partitionBy("p").orderBy("b")) - F.col("s")).alias("base"))
    inside = F.sum("size").over(W.partitionBy("p", "b").orderBy("n")) - F.col("size")
    return b.withColumn("inside", inside).join(base, ["p", "b"]).select("n", "p", (F.col("base") + F.col("inside")).alias("light_off"))


def place_chains(cuts: Cuts, placed: DataFrame, nodes: DataFrame, light: DataFrame | None, with_path: bool) -> DataFrame:
    """(head, root, root_id, base_depth[, base_pre, prefix]) of every chain.

    ``light`` gives the preorder offset of light heads behind their parent; without it no intervals
    are computed.
    """
    heads = placed.where("head = n")
    # roots' ids travel with the chains; chains are the few rows that need them
    first = heads.where("p is null").join(nodes.select("n", "id"), "n").select(
        "head", F.col("id").alias("root_id"), F.lit(0).cast("long").alias("base_depth"), *([F.lit(0).cast("long").alias("base_pre")] if light is not None else []), *([F.lit("").alias("prefix")] if with_path else [])
    )
    attach = placed.select(F.col("n").alias("p"), F.col("head").alias("up"), F.col("off").alias("up_off"), F.col("heavy_size").alias("up_heavy"), *([F.col("seg").alias("up_seg")] if with_path else []))
    waiting = heads.where("p is not null").select("head", "p").join(attach, "p")
    if light is not None:
        waiting = waiting.join(light.select(F.col("n").alias("head"), "light_off"), "head")
    waiting = cuts.write(waiting)
    done = frontier = cuts.write(first)
    while True:
        f = frontier.withColumnRenamed("head", "up")
        step = waiting.join(f, "up").select(
            "head", "root_id", (F.col("base_depth") + F.col("up_off") + 1).alias("base_depth"),
            *([(F.col("base_pre") + F.col("up_off") + 1 + F.col("up_heavy") + F.col("light_off")).alias("base_pre")] if light is not None else []),
            *([F.concat("prefix", "up_seg", F.lit("/")).alias("prefix")] if with_path else []),
        )
        frontier, placed_now = cuts.write_counted(step)
        if not placed_now:
            return done
        done = done.unionByName(frontier)


def roots_and_depths(symbols: DataFrame) -> DataFrame:
    """One row (id, root_id, depth) per distinct id."""
    cuts = Cuts(symbols.sparkSession, "hierarchy")
    nodes, links = number_nodes(cuts, symbols, False)
    tree, cyclic, leaves = separate(cuts, links)
    placed = chains(cuts, tree, None)
    base = place_chains(cuts, placed, nodes, None, False)
    inner = placed.join(base, "head").select("n", "root_id", (F.col("base_depth") + F.col("off")).alias("depth"))
    inner = inner.unionByName(loops(cuts, cyclic, nodes).select("n", "root_id", F.lit(-1).cast("long").alias("depth")))
    inner = cuts.write(inner)
    hung = leaves.where("p is not null").join(inner.withColumnRenamed("n", "p"), "p").select("n", "root_id", F.when(F.col("depth") < 0, F.lit(-1).cast("long")).otherwise(F.col("depth") + 1).alias("depth"))
    below = inner.unionByName(hung)
    # a root that is a leaf is its own whole tree
    return cuts.finish(
        nodes.select("n", "id").join(below, "n", "left")
        .select("id", F.coalesce("root_id", "id").alias("root_id"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))
    )


def hierarchy(symbols: DataFrame) -> DataFrame:
    """(id, root_id, depth, path, n_descendants, pre, last) per distinct id.

    ``path`` joins the names from the root with ``/``. The descendants of a node are the rows of the
    same root with ``pre`` in (pre, last]. Ids that never reach a root have depth -1 and nulls.
    """
    cuts = Cuts(symbols.sparkSession, "hierarchy")
    nodes, links = number_nodes(cuts, symbols, True)
    tree, cyclic, leaves = separate(cuts, links)
    placed = chains(cuts, tree, nodes.select("n", "name"))
    light_inner = placed.where("head = n and p is not null").select("n", "p", "size")
    light_leaf = leaves.where("p is not null").select("n", "p", F.lit(1).cast("long").alias("size"))
    light = cuts.write(sibling_offsets(light_inner.unionByName(light_leaf)))
    base = place_chains(cuts, placed, nodes, light, True)
    inner = cuts.write(
        placed.join(base, "head").select(
            "n", "root_id", (F.col("base_depth") + F.col("off")).alias("depth"), F.concat("prefix", "seg").alias("path"),
            "size", (F.col("base_pre") + F.col("off")).alias("pre"), "heavy_size",
        )
    )
    up = inner.select(F.col("n").alias("p"), "root_id", "depth", F.col("path").alias("up_path"), F.col("pre").alias("up_pre"), "heavy_size")
    hung = (
        light.join(leaves.select("n"), "n", "left_semi").join(up, "p").join(nodes.select("n", "name"), "n")
        .select("n", "root_id", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "up_path", "name").alias("path"), F.lit(1).cast("long").alias("size"), (F.col("up_pre") + 1 + F.col("heavy_size") + F.col("light_off")).alias("pre"))
    )
    lone = leaves.where("p is null").join(nodes.select("n", "id", "name"), "n").select("n", F.col("id").alias("root_id"), F.lit(0).cast("long").alias("depth"), F.col("name").alias("path"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("pre"))
    none = [F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("pre")]
    ring = cuts.write(loops(cuts, cyclic, nodes))
    hung_ring = leaves.where("p is not null").join(ring.withColumnRenamed("n", "p"), "p").select("n", "root_id")
    every = inner.drop("heavy_size").unionByName(hung).unionByName(lone).unionByName(ring.unionByName(hung_ring).select("n", "root_id", *none))
    return cuts.finish(
        nodes.select("n", "id").join(every, "n").select(
            "id", "root_id", F.col("depth").cast("int").alias("depth"), "path", (F.col("size") - 1).alias("n_descendants"), "pre", (F.col("pre") + F.col("size") - 1).alias("last")
        )
    )


def descendants(symbols: DataFrame) -> DataFrame:
    """All (ancestor_id, descendant_id, distance) pairs of ids that reach a root.

    Chain segments of ids are concatenated like paths and unfolded, so the rows made are exactly the
    rows wanted (one per ancestor of each node): no join over a tree's members.
    """
    cuts = Cuts(symbols.sparkSession, "descendants")
    nodes, links = number_nodes(cuts, symbols, False)
    tree, _, leaves = separate(cuts, links)
    placed = chains(cuts, tree, nodes.select("n", F.conv(F.col("n").cast("string"), 10, 36).alias("name")))
    base = place_chains(cuts, placed, nodes, None, True)
    inner = cuts.write(placed.join(base, "head").select("n", F.concat("prefix", "seg").alias("path")))
    leaf = leaves.where("p is not null").join(inner.withColumnRenamed("n", "p"), "p").select("n", F.col("path").alias("path"))
    # a leaf's path ends at its parent; an inner node's ends at itself, which is no ancestor of it
    steps = inner.select("n", F.split("path", "/").alias("a")).select("n", F.expr("slice(a, 1, size(a) - 1)").alias("a")).unionByName(leaf.select("n", F.split("path", "/").alias("a")))
    pairs = steps.select("n", F.size("a").alias("len"), F.posexplode("a").alias("i", "m")).select(
        F.conv("m", 36, 10).cast("long").alias("m"), "n", (F.col("len") - F.col("i")).alias("distance")
    )
    ids = nodes.select("n", "id")
    return cuts.finish(
        pairs.join(ids.withColumnRenamed("id", "descendant_id"), "n")
        .join(ids.select(F.col("n").alias("m"), F.col("id").alias("ancestor_id")), "m")
        .select("ancestor_id", "descendant_id", "distance")
    )
