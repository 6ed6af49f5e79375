"""Labels of forests and of chains, so that "below" and "leads to" are tests on a row's own columns.

A tree's Euler tour goes down into and up out of each node; it is a path, and pointer doubling numbers it. What is below a
node has its numbers between the node's two. A chain of single pointers gets its end and the steps to it by doubling
too. Both take as many rounds as the logarithm of the longest way, and a row a node, never a row a pair of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.ordered import ranked, running_sum
from lodestar.operators.paths import distances
from lodestar.operators.tables import cut, cut_counted


def intervals(parents: DataFrame) -> DataFrame:
    """id, root, enter, leave for every node of a tree; y is at or below x if both have one root and x.enter <= y.enter <= x.leave.

    parents: id (once each), parent; an unknown parent counts as none. Nodes on a circle of parents, or below one, have no row.
    """
    known = parents.select("id")
    own = parents.join(known.select(F.col("id").alias("parent"), F.lit(True).alias("has")), "parent", "left").select("id", F.when(F.col("has"), F.col("parent")).alias("parent"))
    own = cut(own)
    children = cut(ranked(own.filter("parent is not null"), ["parent"], [F.col("id")], "rank").select("id", "parent", "rank"))
    first = children.filter("rank = 1").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    after = children.select("parent", (F.col("rank") - 1).alias("rank"), F.col("id").alias("next"))
    spot = lambda c, up: F.struct(F.col(c).alias("id"), F.lit(up).alias("up"))
    down = own.select("id").join(first, "id", "left").select(spot("id", False).alias("src"), F.when(F.col("child").isNotNull(), spot("child", False)).otherwise(spot("id", True)).alias("dst"))
    up = children.join(after, ["parent", "rank"], "left").select(spot("id", True).alias("src"), F.when(F.col("next").isNotNull(), spot("next", False)).otherwise(spot("parent", True)).alias("dst"))
    tour = cut(down.unionByName(up).withColumn("w", F.lit(1)))
    begins = own.filter("parent is null").select(spot("id", False).alias("node"))
    at = distances(tour, begins)
    each = at.groupBy(F.col("node.id").alias("id")).agg(F.min("head.id").alias("root"), F.max(F.when(~F.col("node.up"), F.col("off"))).alias("enter"), F.max(F.when(F.col("node.up"), F.col("off"))).alias("leave"))
    return cut(each)


def subtree_counts(tree: DataFrame, marks: DataFrame, scopes: DataFrame) -> DataFrame:
    """scope, mark, n: how many nodes at or below each scope have a mark. tree: intervals(); marks: id, mark (few different ones); scopes: id.

    Running counts of each mark along the tour, looked up at a scope's two ends. Every scope of the tree has a row for every mark.
    """
    nodes = tree.join(marks, "id").select("root", "mark", F.col("enter").alias("at"), F.lit(1).alias("kind"), F.lit(1).cast("long").alias("v"), "id")
    kinds = marks.select("mark").distinct()
    asked = tree.join(scopes.select("id").distinct(), "id", "left_semi").join(F.broadcast(kinds), how="cross")  # scopes x few marks
    ends = asked.select("root", "mark", F.explode(F.array(F.struct(F.col("enter").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("leave").alias("at"), F.lit(2).alias("kind")))).alias("e"), "id")
    ends = ends.select("root", "mark", "e.at", "e.kind", F.lit(0).cast("long").alias("v"), "id")
    total = running_sum(nodes.unionByName(ends), ["root", "mark"], [F.col("at"), F.col("kind"), F.col("id")], "v", "total")
    sign = F.when(F.col("kind") == 2, F.col("total")).otherwise(-F.col("total"))
    return total.filter("kind != 1").groupBy(F.col("id").alias("scope"), "mark").agg(F.sum(sign).alias("n"))


def chains(pointers: DataFrame) -> DataFrame:
    """id, last, steps, circle: where each node's chain of single pointers ends, and how far that is; circle: it never ends, last and steps are null.

    pointers: id (once each), to (null: the end). A pointer to an unknown node ends there, one step on.
    """
    ahead = pointers.filter("to is not null").select(F.col("id").alias("to"), F.lit(True).alias("goes"))
    at, left = cut_counted(pointers.join(ahead, "to", "left").select("id", F.coalesce("to", "id").alias("last"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.coalesce("goes", F.lit(False)).alias("open")), "open")
    done, still, before = at.filter("not open"), at.filter("open"), None
    while left and left != before:
        before = left
        over = done.unionByName(still).select(F.col("id").alias("last"), F.col("last").alias("far"), F.col("steps").alias("more"), F.col("open").alias("goes"))
        step, left = cut_counted(still.join(over, "last").select("id", F.col("far").alias("last"), (F.col("steps") + F.col("more")).alias("steps"), F.col("goes").alias("open")), "open")
        done, still = done.unionByName(step.filter("not open")), step.filter("open")
    out = done.select("id", "last", "steps", F.lit(False).alias("circle"))
    none = still.select("id", F.when(F.lit(False), F.col("last")).alias("last"), F.when(F.lit(False), F.col("steps")).alias("steps"), F.lit(True).alias("circle"))
    return out.unionByName(none) if left else out
