"""Connected components of an edge table, by hooking parents and jumping pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_groups, stored

ROUNDS = 64


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of edges (a, b); component: the least id reachable.

    Every id has a parent, never larger than itself, and a grandparent.  In a
    round the least grandparent among an id's neighbours is offered to the id
    and to its parent, and each id takes the least of its offers and its own
    grandparent.  As whole trees are hooked and not only single ids, rounds grow
    with the logarithm of the longest chain.  All steps are joins and
    pre-aggregated minima; nothing is gathered, and each round is stored.  An id
    with a large share of the edges, or of the children, is met by broadcast, so
    no star lands in one task.
    """
    both = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")).distinct(), "edges")
    total = both.count()
    first = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("least"), F.count(F.lit(1)).alias("degree"))
    labels = _raised(first.select("id", F.least("id", "least").alias("parent"), "degree"))
    for _ in range(ROUNDS):
        ends = labels.select(F.col("id").alias("v"), "top", "degree")
        offered = join_groups(both, ends, "v", "degree", total, hint=None).groupBy(F.col("u").alias("id")).agg(F.min("top").alias("offer"))
        seen = labels.join(offered, "id")
        own = F.struct("id", F.least("offer", "top").alias("value"), "degree")
        above = F.struct(F.col("parent").alias("id"), F.col("offer").alias("value"), F.lit(None).cast("long").alias("degree"))
        now = _raised(seen.select(F.inline(F.array(own, above))).groupBy("id").agg(F.min("value").alias("parent"), F.max("degree").alias("degree")))
        settled = now.select("id", "top").join(labels.select("id", F.col("top").alias("before")), "id").filter("top <> before").isEmpty()
        discard(labels)
        if settled:
            discard(both)
            return now.select("id", F.col("top").alias("component"))
        labels = now
    raise RuntimeError("components did not settle")


def _raised(parents: DataFrame) -> DataFrame:
    """parents (id, parent, degree) with top, the parent's parent."""
    parents = stored(parents, "parents")
    children = parents.groupBy("parent").agg(F.count(F.lit(1)).alias("children"))
    above = children.join(parents.select(F.col("id").alias("parent"), F.col("parent").alias("top")), "parent")
    raised = stored(join_groups(parents, above, "parent", "children", parents.count(), hint=None).select("id", "parent", "top", "degree"), "labels")
    discard(parents)
    return raised
