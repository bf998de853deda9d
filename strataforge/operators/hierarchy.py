"""Parent-child links of unknown depth: heavy-path decomposition.

1. **Cycle separation and subtree sizes** by doubling: every node knows its
   ancestor at distance 2^k and the number of descendants nearer than 2^k.
   A round in which no walk ends shows that the walks left never end.
2. **Chains**: the child with the largest subtree continues its parent's chain;
   every other node heads a new one. Any path meets at most log2(n) chains.
3. **Chain labels**: head and position in the chain by pointer jumping along
   heavy edges, on which no two nodes share a jump, so there is no hot key.
4. **Chain tree**: the few chains are joined upwards in log log n rounds; that
   concatenates the path segments and sums depth and pre-order offsets.

The rounds move numbers, not ids: nodes are numbered in the table that is written first.

A node's path is its chain segments (at most log2(n), whatever its depth); its
descendants are one interval of pre-order numbers of its tree. Both stay small
where listing ancestors per node would be quadratic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from strataforge.session import cut, drop

#: Children of a node are numbered in groups of about so many, so that no parent's
#: children have to be sorted in one task.
SIBLINGS = 10_000
#: Long chains and trees are joined in cells of so many positions, never by their head
#: or root alone.
CELL = 4096


def _round(step: Callable[[DataFrame], DataFrame], state: DataFrame, label: str, **seen: Column) -> tuple[DataFrame, dict]:
    """``step`` taken and written; what was ``seen`` of the result, without another job."""
    look = Observation(label)
    after = cut(step(state).observe(look, *[c.alias(k) for k, c in seen.items()]), label)
    drop(state)
    return after, look.get


def _resolved(links: DataFrame) -> DataFrame:
    """``id, parent`` as numbers, ``name``; parents that have no row (or are null) are null."""
    one = links.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("parent").alias("up"))
    # written before it is used, so a node keeps its number
    named = cut(one.select(F.monotonically_increasing_id().alias("id"), F.col("id").alias("name"), "up"), "names")
    number = named.select(F.col("name").alias("up"), F.col("id").alias("parent"))
    return named.join(number, "up", "left").select("id", "parent", "name")


def _sizes(tree: DataFrame) -> tuple[DataFrame, DataFrame | None, int]:
    """(``id, size`` of nodes that reach a root, ``id`` of those that do not, number of nodes)."""

    def step(state: DataFrame) -> DataFrame:
        walking = state.where(F.col("up").isNotNull())
        further = walking.join(walking.select(F.col("id").alias("up"), F.col("up").alias("next"), "size"), "up").select("id", F.col("next").alias("up"), F.lit(0).cast("bigint").alias("size"))
        given = walking.select(F.col("up").alias("id"), F.lit(None).cast("bigint").alias("up"), "size")
        kept = state.select("id", F.lit(None).cast("bigint").alias("up"), "size")
        # one grouping, combined on the map side: what a node had, is given, and where it walks on
        return kept.unionByName(given).unionByName(further).groupBy("id").agg(F.max("up").alias("up"), F.sum("size").alias("size"))

    look = Observation("tree")
    state = cut(tree.select("id", F.col("parent").alias("up"), F.lit(1).cast("bigint").alias("size")).observe(look, F.count("up").alias("walking"), F.count(F.lit(1)).alias("n")), "sizes")
    active, n = look.get["walking"], look.get["n"]
    while active:
        state, seen = _round(step, state, "sizes", walking=F.count("up"))
        left = seen["walking"]
        if left == active:  # nobody arrived: the rest walks in circles
            break
        active = left
    circling = state.where(F.col("up").isNotNull()).select("id") if active else None
    return state.where(F.col("up").isNull()).select("id", "size"), circling, n


def _circles(tree: DataFrame, circling: DataFrame) -> DataFrame:
    """``id, root_id`` (names): the smallest id on the circle that each node runs into."""
    # a walk of one step sees the node and its parent; only nodes of circles and the ways into them take part
    mine = cut(tree.join(circling, "id", "left_semi"), "circling")
    state = cut(mine.join(mine.select(F.col("id").alias("parent"), F.col("name").alias("next_name")), "parent").select("id", F.col("parent").alias("up"), F.least("name", "next_name").alias("low")), "circles")
    # low: the smallest id on the walk of 2^k steps. The ends of all such walks are
    # fewer each time until they are just the circles; once neither they nor any low
    # change, walks end on their circle and have seen all of it.
    def step(state: DataFrame) -> DataFrame:
        other = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("low").alias("low2"))
        return state.join(other, "up").select("id", F.col("next").alias("up"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("lower"))

    ends, changed = None, True
    while changed:
        state, seen = _round(step, state.select("id", "up", "low"), "circles", lower=F.max("lower"))
        changed = bool(seen["lower"])
        if not changed:  # else the ends need not be counted
            now = state.agg(F.countDistinct("up")).first()[0]
            changed, ends = now != ends, now
    found = state.select("id", "up").join(state.select(F.col("id").alias("up"), F.col("low").alias("root_id")), "up")
    return found.join(mine.select("id", "name"), "id").select(F.col("name").alias("id"), "root_id")


def _chains(tree: DataFrame, sizes: DataFrame, n: int) -> DataFrame:
    """``id, parent, name, size, head, pos, lead``.

    ``head`` is the first node of the chain, ``pos`` the place in it, ``lead``
    the pre-order distance from the parent (1 for the heavy child).
    """
    nodes = cut(tree.join(sizes, "id"), "nodes")
    children = nodes.where(F.col("parent").isNotNull())
    heavy = children.groupBy("parent").agg(F.max_by(F.struct("id", "size"), F.struct(F.col("size").alias("s"), F.col("id").alias("i"))).alias("h"))
    heavy = heavy.select(F.col("h.id").alias("id"), "parent", F.col("h.size").alias("heavy_size"))

    # pre-order: the heavy child first, then the light ones, group after group
    light = children.join(heavy.select("id"), "id", "left_anti").withColumn("group", F.pmod(F.xxhash64("id"), F.lit(n // SIBLINGS + 64)).cast("int"))
    before = Window.partitionBy("parent").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = light.groupBy("parent", "group").agg(F.sum("size").alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("parent", "group").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    leads = (
        light.withColumn("earlier", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(groups, ["parent", "group"])
        .join(heavy.select("parent", "heavy_size"), "parent")
        .select("id", (F.lit(1) + F.col("heavy_size") + F.col("skip") + F.col("earlier")).alias("lead"))
    )

    # jump along heavy edges until the head; heads point to themselves
    state = cut(
        nodes.select("id").join(heavy.select("id", "parent"), "id", "left").select("id", F.coalesce("parent", "id").alias("head"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("pos"), F.col("parent").isNull().alias("done")),
        "chains",
    )

    def step(state: DataFrame) -> DataFrame:
        other = state.select(F.col("id").alias("head"), F.col("head").alias("head2"), F.col("pos").alias("pos2"), F.col("done").alias("done2"))
        moved = state.where(~F.col("done")).join(other, "head").select("id", F.col("head2").alias("head"), (F.col("pos") + F.col("pos2")).alias("pos"), F.col("done2").alias("done"))
        return state.where(F.col("done")).unionByName(moved)

    left = 1
    while left:
        state, seen = _round(step, state, "chains", left=F.count_if(~F.col("done")))
        left = seen["left"]
    return nodes.join(state.drop("done"), "id").join(leads, "id", "left").select("id", "parent", "name", "size", "head", "pos", F.coalesce("lead", F.lit(1)).alias("lead"))


def _chain_tree(chains: DataFrame) -> DataFrame:
    """``head, head_id, root_id, depth, first, segments`` of every chain; all but ``head`` by name."""
    heads = chains.where(F.col("pos") == 0).select("head", F.col("name").alias("head_id"), "parent", "lead")
    at = chains.select(F.col("id").alias("parent"), F.col("head").alias("up"), F.col("pos").alias("at"))
    start = heads.join(at, "parent", "left").join(heads.select(F.col("head").alias("up"), F.col("head_id").alias("up_id")), "up", "left")
    hop = F.struct(F.col("up_id").alias("head"), F.col("at").alias("upto"))
    state = cut(
        start.select(
            "head",
            "head_id",
            "up",
            F.when(F.col("up").isNull(), F.col("head_id")).alias("root_id"),
            F.when(F.col("up").isNull(), 0).otherwise(F.col("at") + 1).cast("bigint").alias("depth"),
            F.when(F.col("up").isNull(), 0).otherwise(F.col("at") + F.col("lead")).cast("bigint").alias("first"),
            F.when(F.col("up").isNull(), F.array().cast("array<struct<head:string,upto:bigint>>")).otherwise(F.array(hop)).alias("segments"),
        ),
        "chain-tree",
    )
    def step(state: DataFrame) -> DataFrame:
        other = state.select(*[F.col(c).alias(f"o_{c}") for c in state.columns])
        moved = state.where(F.col("up").isNotNull()).join(other, F.col("up") == F.col("o_head")).select(
            "head",
            "head_id",
            F.col("o_up").alias("up"),
            F.col("o_root_id").alias("root_id"),
            (F.col("depth") + F.col("o_depth")).alias("depth"),
            (F.col("first") + F.col("o_first")).alias("first"),
            F.concat("o_segments", "segments").alias("segments"),
        )
        return state.where(F.col("up").isNull()).unionByName(moved)

    left = 1
    while left:
        state, seen = _round(step, state, "chain-tree", left=F.count("up"))
        left = seen["left"]
    return state.drop("up")


def hierarchy(links: DataFrame) -> DataFrame:
    """Root, depth, path and descendants of every node of ``links`` (``id, parent``).

    Returns per ``id``: ``root_id``; ``depth`` (0 at a root, -1 on a circle or on
    the way into one, whose ``root_id`` is the smallest id of the circle);
    ``segments``, the path from the root as chain pieces ``(head, upto)`` ending
    with the node's own; ``first``, ``last``: pre-order numbers, the descendants
    of a node being the ids with the same root and ``first`` in between;
    ``n_descendants``. The last four are null for nodes of circles.

    Null ids are left out; of several rows of one id the smallest parent counts;
    a parent without a row of its own makes its child a root; a node that is its
    own parent is a circle. No rows give no rows.
    """
    tree = cut(_resolved(links), "tree")
    sizes, circling, n = _sizes(tree)
    chains = cut(_chains(tree, sizes, n).withColumn("cell", F.floor(F.col("pos") / CELL)), "labels")
    # a chain of many nodes is joined cell after cell
    lengths = chains.where(F.pmod("pos", F.lit(CELL)) == 0).select("head", "cell")
    per_chain = lengths.join(_chain_tree(chains), "head")
    own = F.struct(F.col("head_id").alias("head"), F.col("pos").alias("upto"))
    out = chains.join(per_chain, ["head", "cell"]).select(
        F.col("name").alias("id"),
        "root_id",
        (F.col("depth") + F.col("pos")).alias("depth"),
        F.concat("segments", F.array(own)).alias("segments"),
        (F.col("first") + F.col("pos")).alias("first"),
        (F.col("first") + F.col("pos") + F.col("size") - 1).alias("last"),
        (F.col("size") - 1).alias("n_descendants"),
    )
    if circling is None:
        return out
    none = {c: F.lit(None).cast(t) for c, t in out.dtypes if c not in ("id", "root_id", "depth")}
    rounds = _circles(tree, circling).select("id", "root_id", F.lit(-1).cast("bigint").alias("depth"), *[v.alias(c) for c, v in none.items()])
    return out.unionByName(rounds)


def chain_members(links_hierarchy: DataFrame) -> DataFrame:
    """``head, upto, id``: resolves the segments of a path to ids."""
    last = F.element_at("segments", -1)
    return links_hierarchy.where(F.col("segments").isNotNull()).select(last["head"].alias("head"), last["upto"].alias("upto"), "id")


def paths(tree: DataFrame, of: DataFrame) -> DataFrame:
    """Full paths, root first, of the ids in ``of`` (column ``id``): ``id, step, node``.

    One row per node on the path; an output of all paths is quadratic by nature,
    therefore the ids wanted are an argument. Steps follow from the lengths of the
    pieces, so no path is sorted; chains are joined in cells.
    """
    wanted = tree.join(of.select("id").distinct(), "id", "left_semi").where(F.col("segments").isNotNull())
    skip = lambda i: F.aggregate(F.slice("segments", 1, i), F.lit(0).cast("bigint"), lambda n, s: n + s["upto"] + 1)
    placed = F.transform("segments", lambda s, i: F.struct(s["head"].alias("head"), s["upto"].alias("end"), skip(i).alias("skip")))
    pieces = wanted.select("id", F.explode(placed).alias("s")).select("id", "s.*").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("end") / CELL))))
    members = chain_members(tree).select("head", F.floor(F.col("upto") / CELL).alias("cell"), F.col("upto").alias("at"), F.col("id").alias("node"))
    return pieces.join(members, ["head", "cell"]).where(F.col("at") <= F.col("end")).select("id", (F.col("skip") + F.col("at")).alias("step"), "node")


def descendants(tree: DataFrame, of: DataFrame) -> DataFrame:
    """All descendants of the ids in ``of``: ``id, descendant``, by pre-order interval.

    Intervals and nodes meet in cells of pre-order numbers, so the work follows the
    descendants found, not the size of the tree.
    """
    wanted = tree.join(of.select("id").distinct(), "id", "left_semi").where(F.col("last") > F.col("first")).select("id", "root_id", "first", "last")
    cells = wanted.withColumn("cell", F.explode(F.sequence(F.floor((F.col("first") + 1) / CELL), F.floor(F.col("last") / CELL))))
    inner = tree.where(F.col("first").isNotNull()).select(F.col("id").alias("descendant"), "root_id", F.col("first").alias("at"), F.floor(F.col("first") / CELL).alias("cell"))
    return cells.join(inner, ["root_id", "cell"]).where((F.col("at") > F.col("first")) & (F.col("at") <= F.col("last"))).select("id", "descendant")
