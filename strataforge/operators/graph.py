"""Traversal of the commit graph: first-parent chains, ancestors, merge bases.

The first parents form a forest; its heavy-path chains (see ``hierarchy``)
compress the graph. What is reachable from a commit is, per chain, everything up
to some position, so a search moves from chain to chain over the few edges
between them and needs about as many rounds as a path changes chains, not as
many as it has commits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataforge.operators.hierarchy import chain_members, hierarchy, paths
from strataforge.session import cut, drop

ROUTE = "array<struct<back:bigint,choice:int>>"


def first_parents(commits: DataFrame) -> DataFrame:
    """``id, parent``: the first entry of ``parents``, null if there is none."""
    return commits.select("id", F.get("parents", 0).alias("parent"))


def first_parent_chain(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """Commits from each of ``tips`` (``id``) along first parents: ``tip, step, id``.

    ``step`` 0 is the tip. A chain ends at a commit without a first parent, at a
    parent that has no row, or before a commit it has shown already (a circle).
    """
    tree = cut(hierarchy(first_parents(commits)), "first-parents")
    found = paths(tree, tips).select(F.col("id").alias("tip"), "step", F.col("node").alias("id"))
    last = F.max("step").over(Window.partitionBy("tip"))
    straight = found.select("tip", (last - F.col("step")).cast("bigint").alias("step"), "id")
    wanted, met = _circling(commits, tree, tips)
    return straight if met is None else straight.unionByName(met.join(wanted, "tip", "left_semi"))


def _circling(commits: DataFrame, tree: DataFrame, tips: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Chains from tips that run into a circle (``tip, step, id``), by doubled jumps.

    Only commits of circles or on the way into one take part.
    """
    circling = tree.where(F.col("depth") < 0).select("id")
    wanted = tips.select("id").join(circling, "id", "left_semi").select(F.col("id").alias("tip")).distinct()
    if wanted.isEmpty():
        return wanted, None
    link = first_parents(commits).join(circling, "id", "left_semi")
    n = link.count()
    met, jump, far = link.select(F.col("id").alias("tip"), F.lit(0).cast("bigint").alias("step"), "id"), link, 1
    while far < n:
        further = jump.select(F.col("id").alias("tip"), "parent").join(met.select(F.col("tip").alias("parent"), "step", "id"), "parent").select("tip", (F.col("step") + far).alias("step"), "id")
        met = cut(met.unionByName(further).groupBy("tip", "id").agg(F.min("step").alias("step")).select("tip", "step", "id"), "circle-steps")
        jump = cut(jump.join(jump.select(F.col("id").alias("parent"), F.col("parent").alias("next")), "parent").select("id", F.col("next").alias("parent")), "circle-jumps")
        far *= 2
    return wanted, met


def history(commits: DataFrame, tips: DataFrame) -> DataFrame:
    """All commits on the first-parent chains of ``tips`` (``id``), each once: ``id``.

    Chain pieces are merged before they are resolved, so that histories shared by
    many tips are not listed per tip.
    """
    tree = cut(hierarchy(first_parents(commits)), "first-parents")
    pieces = tree.join(tips.select("id").distinct(), "id", "left_semi").where(F.col("segments").isNotNull()).select(F.explode("segments").alias("s"))
    upto = pieces.groupBy(F.col("s.head").alias("head")).agg(F.max("s.upto").alias("end"))
    found = chain_members(tree).join(upto, "head").where(F.col("upto") <= F.col("end")).select("id")
    wanted, met = _circling(commits, tree, tips)
    return found if met is None else found.unionByName(met.join(wanted, "tip", "left_semi").select("id").distinct())


class Compressed:
    """A commit graph as chains of first parents and the edges between them."""

    def __init__(self, commits: DataFrame) -> None:
        listed = commits.select("id", F.posexplode("parents").alias("at", "parent")).where(F.col("parent").isNotNull())
        known = listed.join(commits.select(F.col("id").alias("parent")), "parent", "left_semi")
        once = known.groupBy("id", "parent").agg(F.min("at").alias("at"))
        ranked = once.withColumn("choice", F.row_number().over(Window.partitionBy("id").orderBy("at")) - 1)
        edges = cut(ranked.select("id", "parent", "choice"), "edges")
        first = edges.where(F.col("choice") == 0).select("id", "parent")
        tree = hierarchy(commits.select("id").join(first, "id", "left"))
        own = F.element_at("segments", -1)
        # commits of circles are chains of their own, all their edges lead out
        self.nodes = cut(tree.select("id", F.coalesce(own["head"], F.col("id")).alias("head"), F.coalesce(own["upto"], F.lit(0)).alias("pos")), "nodes")
        end = self.nodes.select(F.col("id").alias("parent"), F.col("head").alias("head2"), F.col("pos").alias("pos2"))
        between = edges.join(self.nodes, "id").join(end, "parent")
        inner = (F.col("choice") == 0) & (F.col("head") == F.col("head2")) & (F.col("pos2") == F.col("pos") - 1)
        self.edges = cut(between.where(~inner).select("head", F.col("pos").alias("from"), "choice", "head2", "pos2"), "chain-edges")

    def reach(self, seeds: DataFrame) -> DataFrame:
        """``query, head, pos, dist, route`` from ``seeds`` (``query, id``).

        Everything on a chain up to ``pos`` is reached, a commit ``d`` below it in
        ``dist + d`` steps. ``route`` lists the steps that did not take the first
        parent; it decides between equally long ways as a queue would.
        """
        start = seeds.join(self.nodes, "id").select("query", "head", "pos", F.lit(0).cast("bigint").alias("dist"), F.array().cast(ROUTE).alias("route"), F.lit(0).alias("round"))
        state, round_ = cut(start.distinct(), "reach"), 0
        above = Window.partitionBy("query", "head").orderBy(F.desc("pos"), "dist", "route").rowsBetween(Window.unboundedPreceding, -1)
        here = F.struct((F.col("dist") + F.col("pos")).alias("d"), F.col("route").alias("r"))
        while not state.where(F.col("round") == round_).isEmpty():
            step = F.col("dist") + F.col("pos") - F.col("from")
            turned = F.when(F.col("choice") > 0, F.concat("route", F.array(F.struct((-step).alias("back"), F.col("choice").alias("choice"))))).otherwise(F.col("route"))
            fresh = (
                state.where(F.col("round") == round_)
                .join(self.edges, "head")
                .where(F.col("from") <= F.col("pos"))
                .select("query", F.col("head2").alias("head"), F.col("pos2").alias("pos"), (step + 1).alias("dist"), turned.cast(ROUTE).alias("route"), F.lit(round_ + 1).alias("round"))
            )
            both = state.unionByName(fresh).groupBy("query", "head", "pos").agg(F.min(F.struct("dist", "route", "round")).alias("b")).select("query", "head", "pos", "b.*")
            best = F.min(here).over(above)
            after = cut(both.withColumn("best", best).where(F.col("best").isNull() | (here < F.col("best"))).drop("best"), "reach")
            drop(state)
            state, round_ = after, round_ + 1
        return state.drop("round")

    def ancestors(self, seeds: DataFrame) -> DataFrame:
        """All commits reachable over any parents, the seed included: ``query, id``."""
        upto = self.reach(seeds).groupBy("query", "head").agg(F.max("pos").alias("upto"))
        return upto.join(self.nodes, "head").where(F.col("pos") <= F.col("upto")).select("query", "id")

    def merge_bases(self, pairs: DataFrame) -> DataFrame:
        """``query, base`` for ``pairs`` (``query, a, b``).

        The base is the ancestor of ``a`` (or ``a`` itself) that a breadth-first
        search from ``b`` meets first; null if there is none.
        """
        of_a = self.reach(pairs.select("query", F.col("a").alias("id"))).groupBy("query", "head").agg(F.max("pos").alias("upto"))
        of_b = self.reach(pairs.select("query", F.col("b").alias("id"))).join(of_a, ["query", "head"])
        at = F.least("pos", "upto")
        best = of_b.groupBy("query").agg(F.min(F.struct((F.col("dist") + F.col("pos") - at).alias("d"), F.col("route").alias("r"), F.col("head").alias("head"), at.alias("pos"))).alias("m"))
        named = best.select("query", F.col("m.head").alias("head"), F.col("m.pos").alias("pos")).join(self.nodes, ["head", "pos"]).select("query", F.col("id").alias("base"))
        return pairs.select("query").join(named, "query", "left")
