"""Weighted edge lists made smaller before rounds walk over them: paths become single edges, dead ends go.

A node with one way in and one way out lies inside a path. Pointer doubling gives each such node the path's head and the
way from there, in as many steps as the logarithm of the longest path; the path itself becomes one edge. Nodes without a
way out lead nowhere and are taken off too. Both together shorten chains and trees by a share of their size a turn. What
is taken off is kept in layers, from which results are restored in the opposite order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.tables import cut, cut_counted

#: A turn that leaves more than this share of the edges is the last one.
SHARE = 0.75


@dataclass
class Layer:
    """What one turn took off: edges to dead ends (src, dst, w); nodes inside paths (node, head, off, first); paths (first, tail); rings (node, head)."""

    ends: DataFrame | None = None
    inside: DataFrame | None = None
    tails: DataFrame | None = None
    rings: DataFrame | None = None


def _degrees(edges: DataFrame) -> DataFrame:
    """node, ways_in, ways_out."""
    end = lambda c, i, o: F.struct(F.col(c).alias("node"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    ends = edges.select(F.explode(F.array(end("src", 0, 1), end("dst", 1, 0))).alias("x"))
    return ends.groupBy(F.col("x.node").alias("node")).agg(F.sum("x.i").alias("ways_in"), F.sum("x.o").alias("ways_out"))


def _insides(edges: DataFrame, inner: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Nodes inside paths (node, head, off, first: the path's first node inside), and those of rings (node, head: the one before it), where doubling never ends."""
    mark = inner.select(F.col("node").alias("head"), F.lit(True).alias("open"))
    into = edges.join(inner.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("head"), F.col("w").alias("off"))
    at, left = cut_counted(into.join(mark, "head", "left").select("node", "head", "off", F.col("node").alias("first"), F.coalesce("open", F.lit(False)).alias("open")), "open")
    done, still, before = at.filter("not open"), at.filter("open"), None
    while left and left != before:
        over = done.unionByName(still).select(F.col("node").alias("head"), F.col("head").alias("far"), F.col("off").alias("more"), F.col("first").alias("begin"), F.col("open").alias("goes"))
        before = left
        step, left = cut_counted(still.join(over, "head").select("node", F.col("far").alias("head"), (F.col("off") + F.col("more")).alias("off"), F.col("begin").alias("first"), F.col("goes").alias("open")), "open")
        done, still = done.unionByName(step.filter("not open")), step.filter("open")
    return done.drop("open"), into.select("node", "head").join(still.select("node"), "node", "left_semi") if left else None


def distances(edges: DataFrame, begins: DataFrame) -> DataFrame:
    """node, head, off: the way from the beginning of its path for every node of edges (src, dst, w) that are paths side by side. begins: node, the paths' first ones.

    Nodes of rings have no row.
    """
    inner = edges.select(F.col("dst").alias("node"))
    inside, _ = _insides(edges, inner)
    return begins.select("node", F.col("node").alias("head"), F.lit(0).alias("off")).unionByName(inside.select("node", "head", "off"))


def shrink(edges: DataFrame, fixed: DataFrame, both_ends: bool = False) -> tuple[DataFrame, list[Layer]]:
    """The edges that are left after turns over edges (src, dst, w), and the layers taken off. fixed: nodes that stay.

    Nodes without a way in that are not fixed go for good: nothing reaches them. So do edges from a node to itself, and with both_ends dead
    ends that are not kept in a layer, either. Of parallel edges the shortest stays.
    """
    layers: list[Layer] = []
    edges, size = cut_counted(edges.filter("src != dst").groupBy("src", "dst").agg(F.min("w").alias("w")))
    while size:
        of = cut(_degrees(edges).join(fixed.select("node").distinct().withColumn("stays", F.lit(True)), "node", "left"))
        free = of.filter("stays is null")
        sources, ends = free.filter("ways_in = 0").select(F.col("node").alias("src")), free.filter("ways_out = 0").select(F.col("node").alias("dst"))
        rest = edges.join(sources, "src", "left_anti")
        layer = Layer() if both_ends else Layer(ends=cut(rest.join(ends, "dst", "left_semi").select("src", "dst", "w")))
        rest = rest.join(ends, "dst", "left_anti").select("src", "dst", "w")
        inner = free.filter("ways_in = 1 and ways_out = 1").select("node")
        inner, n = cut_counted(inner.join(rest.select(F.col("dst").alias("node")), "node", "left_semi").join(rest.select(F.col("src").alias("node")), "node", "left_semi"))
        if n:
            rest = cut(rest)
            layer.inside, layer.rings = _insides(rest, inner)
            out = rest.join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
            short = cut(out.join(layer.inside.select(F.col("node").alias("src"), "head", "off", "first"), "src").select(F.col("head").alias("src"), "dst", (F.col("off") + F.col("w")).alias("w"), "first"))
            layer.tails = short.select("first", F.col("dst").alias("tail"))
            plain = out.join(inner.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst", "w")
            rest = plain.unionByName(short.select("src", "dst", "w")).filter("src != dst").groupBy("src", "dst").agg(F.min("w").alias("w"))
        layers.append(layer)
        before = size
        edges, size = cut_counted(rest)
        if size > SHARE * before:
            break
    return edges, layers


def ring_labels(rings: DataFrame) -> DataFrame:
    """node, label (the ring's least node), for rings (node, head: the one before it)."""
    at = cut(rings.select("node", "head", F.least("node", "head").alias("label")))
    while True:
        over = at.select(F.col("node").alias("head"), F.col("head").alias("far"), F.col("label").alias("other"))
        step = at.join(over, "head").select("node", F.col("far").alias("head"), F.least("label", "other").alias("label"), (F.col("other") < F.col("label")).alias("new"))
        at, changed = cut_counted(step, "new")
        at = at.drop("new")
        if not changed:
            return at.select("node", "label")
