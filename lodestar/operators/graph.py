"""Closures over edge lists by rounds, of which each joins what changed last with the edges; components of cycles.

Graphs that are still open after a few rounds are contracted (paths.py), so that rounds follow the branchings on the
way, not its length. Rounds end when nothing changes, so cycles are no matter. Lineage is cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.paths import ring_labels, shrink
from lodestar.operators.tables import cut, cut_counted, pairs_by

#: Rounds over the edges as they are before they are contracted.
PLAIN = 12


def _nearest(found: DataFrame, roots: int) -> DataFrame:
    """node, root, depth, new (1: only among new rows): for each node its `roots` nearest roots, of rows (node, root, depth, new); ties to the least root."""
    if roots == 1:
        return found.groupBy("node").agg(F.min(F.struct("depth", "root", "new")).alias("m")).select("node", "m.root", "m.depth", "m.new")
    each = found.groupBy("node", "root").agg(F.min(F.struct("depth", "new")).alias("m")).select("node", "root", "m.depth", "m.new")
    return each.withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("depth", "root"))).filter(F.col("rn") <= roots).drop("rn")


def _relaxed(edges: DataFrame, state: DataFrame, roots: int, max_depth: int | None, rounds: int | None) -> tuple[DataFrame, bool]:
    """state (node, root, depth, new) after rounds over edges (src, dst, w), and whether nothing changes any more."""
    done = 0
    while rounds is None or done < rounds:
        step = state.filter("new = 1").select(F.col("node").alias("src"), "root", "depth").join(edges, "src")
        step = step.select(F.col("dst").alias("node"), "root", (F.col("depth") + F.col("w")).alias("depth"), F.lit(1).alias("new"))
        if max_depth is not None:
            step = step.filter(F.col("depth") <= max_depth)
        state, changed = cut_counted(_nearest(state.withColumn("new", F.lit(0)).unionByName(step), roots), "new = 1")
        if not changed:
            return state, True
        done += 1
    return state, False


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None, roots: int = 1) -> DataFrame:
    """node, root, depth (fewest steps), via (the least neighbour on that way; null for seeds): the nearest seeds that reach each node, `roots` at most.

    edges: src, dst; seeds: node. All seeds at once: a node has a row for each root that it keeps, so the work is that of
    the edges whatever the number of seeds. Ties go to the least root. Following via gives a shortest path.
    """
    one = cut(edges.select("src", "dst").filter("src != dst").distinct().withColumn("w", F.lit(1)))
    state = cut(seeds.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.lit(1).alias("new")).distinct())
    state, closed = _relaxed(one, state, roots, max_depth, PLAIN)
    if not closed:
        small, layers = shrink(one, seeds)
        for layer in layers:  # what is taken off gets its roots from the rest
            state = state.join(layer.ends.select(F.col("dst").alias("node")), "node", "left_anti")
            if layer.inside is not None:
                state = state.join(layer.inside.select("node"), "node", "left_anti")
        state, _ = _relaxed(small, cut(state.withColumn("new", F.lit(1))), roots, max_depth, None)
        for layer in reversed(layers):
            if layer.inside is not None:
                held = layer.inside.join(state.select(F.col("node").alias("head"), "root", "depth"), "head").select("node", "root", (F.col("depth") + F.col("off")).alias("depth"), F.lit(0).alias("new"))
                state = cut(state.unionByName(held))
            ends = layer.ends.join(state.select(F.col("node").alias("src"), "root", "depth"), "src").select(F.col("dst").alias("node"), "root", (F.col("depth") + F.col("w")).alias("depth"), F.lit(0).alias("new"))
            state = cut(state.unionByName(_nearest(ends, roots)))
        if max_depth is not None:
            state = state.filter(F.col("depth") <= max_depth)
    label = state.select("node", "root", "depth")
    came = label.select(F.col("node").alias("via"), "root", (F.col("depth") + 1).alias("depth")).join(one.select(F.col("src").alias("via"), F.col("dst").alias("node")), "via")
    came = came.groupBy("node", "root", "depth").agg(F.min("via").alias("via"))
    return cut(label.join(came.filter("depth > 0"), ["node", "root", "depth"], "left").select("node", "root", "depth", F.when(F.col("depth") > 0, F.col("via")).alias("via")))


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: the seeds and what edges (src, dst) lead to from them. seeds: node. A round writes only what it finds; what is still open after PLAIN rounds goes through reach."""
    edges = cut(edges.select("src", "dst").filter("src != dst").distinct())
    found = last = cut(seeds.select("node").distinct())
    for _ in range(PLAIN):
        step = edges.join(last.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        last, more = cut_counted(step.join(found, "node", "left_anti"))
        if not more:
            return found
        found = found.unionByName(last)
    return reach(edges, found).select("node")


def closure(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """root, node, depth (fewest steps; the root itself at 0). edges: src, dst; roots: root."""
    edges = edges.select("src", "dst").distinct()
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    last, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = last.join(edges, last["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        last = cut(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if last.isEmpty():
            break
        seen = seen.unionByName(last)
        if depth % 8 == 0:
            seen = cut(seen)
    return seen


def cycles(edges: DataFrame) -> DataFrame:
    """node, label (least node of its component), size: strongly connected components of more than one node, and self loops.

    Paths are contracted and loose ends trimmed first. Then every node takes the first node, in an order by hash, that reaches it: many
    pivots at once, each with the region that it colours. What reaches a region's pivot from within it is a component.
    Edges between colours and found components are taken away, and the next turn begins. At last the insides of paths are
    restored: they belong to a component if both ends of their path do. Each round holds a row a node and an edge.
    """
    e = edges.select("src", "dst").distinct()
    loops = e.filter("src = dst").select(F.col("src").alias("node")).distinct()
    e, parts, layers = e.withColumn("w", F.lit(1)), [], []
    nobody = e.select(F.col("src").alias("node")).limit(0)
    while True:
        e, taken = shrink(e, nobody, both_ends=True)
        layers += taken
        parts += [ring_labels(layer.rings) for layer in taken if layer.rings is not None]
        if e.isEmpty():
            break
        found, e = _pivoted(e)
        parts.append(found)
    if not parts and all(layer.inside is None for layer in layers):
        return loops.select("node", F.col("node").alias("label"), F.lit(1).cast("long").alias("size"))
    part = nobody.select("node", F.col("node").alias("label"))
    for p in parts:
        part = part.unionByName(p)
    part = cut(part)
    for layer in reversed([x for x in layers if x.inside is not None]):
        path = layer.inside.join(layer.tails, "first").select("node", "head", "tail")
        path = path.join(part.select(F.col("node").alias("head"), F.col("label").alias("a")), "head", "left").join(part.select(F.col("node").alias("tail"), F.col("label").alias("b")), "tail", "left")
        within = cut(path.filter(F.coalesce("a", "head") == F.coalesce("b", "tail")).select("node", "head", F.coalesce("a", "head").alias("label"), F.col("a").isNull().alias("fresh")))
        part = cut(part.unionByName(within.select("node", "label")).unionByName(within.filter("fresh").select(F.col("head").alias("node"), "label").distinct()))
    size = part.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).filter("size > 1")
    part = part.join(size, "label").select("node", F.col("least").alias("label"), "size")
    return part.unionByName(loops.join(part, "node", "left_anti").select("node", F.col("node").alias("label"), F.lit(1).cast("long").alias("size")))


def _pivoted(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label of components found, edges left to look at) after one turn of colouring edges (src, dst, w)."""
    nodes = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    own = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("n"))
    colour = cut(nodes.select("node", own.alias("label"), F.lit(True).alias("new")))
    while True:  # colours spread along edges from the nodes whose colour changed last
        came = colour.filter("new").select(F.col("node").alias("src"), "label").join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("came"))
        colour = colour.select("node", "label").join(came, "node", "left").select("node", F.least("label", "came").alias("label"), F.coalesce(F.col("came") < F.col("label"), F.lit(False)).alias("new"))
        colour, changed = cut_counted(colour, "new")
        if not changed:
            break
    of = colour.select("node", F.col("label.n").alias("label"))
    inner = e.join(of.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").filter("a = b")
    inner = cut(inner.select("src", "dst", "w"))
    back = reach(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), of.filter("node = label").select("node")).select("node")
    found = cut(of.join(back, "node", "left_semi"))
    gone = found.select(F.col("node").alias("src"))
    rest = inner.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst", "w")
    alone = found.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.join(alone, "label", "left_semi").select("node", "label"), rest


def ancestors(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, ancestor, depth along a parent column. parents: id, parent; nodes: node."""
    up = parents.filter("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    return closure(up, nodes.select(F.col("node").alias("root"))).filter("depth > 0").select(F.col("root").alias("node"), F.col("node").alias("ancestor"), "depth")


def dependency_edges(relations: DataFrame) -> DataFrame:
    """source, target, relation by the kind's suffix: calls, implements, contains, and references for everything else."""
    k = F.col("kind")
    kind = F.when(k.endswith("calls"), "calls").when(k.endswith("references"), "references").when(k.endswith("implements"), "implements").when(k.endswith("contains"), "contains").otherwise("references")
    return relations.select("source", "target", kind.alias("relation"))


#: Kinds of impact in the order of analysis.
IMPACTS = ("direct", "forward", "backward", "design", "conservative", "containment")


def impact_reasons(
    relations: DataFrame, targets: DataFrame, changed: DataFrame, removed: DataFrame, linked: DataFrame | None = None, max_depth: int | None = None,
    baseline: DataFrame | None = None, contracts: DataFrame | None = None,
) -> DataFrame:
    """id, kind, depth, via, root: every kind of reason for which a target is affected; via is the neighbour that it comes from, root the nearest target that set it off.

    direct; forward (callers, referrers and implementers of what changed; of what was removed too, whose callers in the
    current and the baseline's relations stand at depth 1); backward (callees of what changed, one hop, as
    backward_contract where the caller's contract changed); design (targets linked to a changed document); conservative
    (siblings of affected targets whose inventory is failed or unsupported); containment (ancestors of all affected).
    changed, removed, linked, contracts: id.
    """
    edges = dependency_edges(relations).filter("relation != 'contains'")
    present = targets.select("id")
    none = F.lit(None).cast("string")
    direct = changed.select("id").distinct().join(present, "id", "left_semi").select("id", F.lit("direct").alias("kind"), F.lit(0).alias("depth"), none.alias("via"), F.col("id").alias("root"))
    ways = edges.select(F.col("target").alias("src"), F.col("source").alias("dst"))
    if baseline is not None:  # only the removed targets' callers come from the baseline
        old = dependency_edges(baseline).filter("relation != 'contains'").join(removed.select(F.col("id").alias("target")), "target", "left_semi")
        ways = ways.unionByName(old.select(F.col("target").alias("src"), F.col("source").alias("dst")))
    seeds = changed.unionByName(removed).select(F.col("id").alias("node")).distinct()
    # two roots a node: what changed itself may be reached from another change
    forward = reach(ways, seeds, max_depth, roots=2).filter("root != node").groupBy("node").agg(F.min(F.struct("depth", "root", "via")).alias("m"))
    forward = forward.select(F.col("node").alias("id"), F.lit("forward").alias("kind"), "m.depth", "m.via", "m.root").join(present, "id", "left_semi")
    back = edges.filter("relation = 'calls'").join(changed.select("id").distinct(), F.col("source") == F.col("id")).groupBy(F.col("target").alias("id")).agg(F.min("source").alias("via")).join(present, "id", "left_semi")
    kind = F.lit("backward")
    if contracts is not None:
        back = back.join(contracts.select(F.col("id").alias("via"), F.lit(True).alias("c")).distinct(), "via", "left")
        kind = F.when(F.col("c"), "backward_contract").otherwise("backward")
    found = direct.unionByName(forward).unionByName(back.select("id", kind.alias("kind"), F.lit(1).alias("depth"), "via", F.col("via").alias("root")))
    if linked is not None:
        found = found.unionByName(linked.select("id").distinct().join(present, "id", "left_semi").select("id", F.lit("design").alias("kind"), F.lit(1).alias("depth"), none.alias("via"), none.alias("root")))
    found = cut(found)
    weak = targets.filter("inventory in ('failed', 'unsupported') and parent is not null").join(found, "id", "left_semi").groupBy("parent").agg(F.min("id").alias("via"))
    siblings = targets.select("id", "parent").join(weak, "parent").join(found, "id", "left_anti").select("id", F.lit("conservative").alias("kind"), F.lit(1).alias("depth"), "via", F.col("via").alias("root"))
    found = cut(found.unionByName(siblings))
    up = targets.filter("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    above = reach(up, found.select(F.col("id").alias("node")).distinct()).filter("depth > 0").select(F.col("node").alias("id"), F.lit("containment").alias("kind"), "depth", "via", "root")
    return found.unionByName(above.join(present, "id", "left_semi").join(found, "id", "left_anti"))


def first_reason(reasons: DataFrame) -> DataFrame:
    """id, kind, depth: each target's first reason in the order of IMPACTS, least depth within it."""
    order = F.lit(len(IMPACTS))
    for k, name in enumerate(IMPACTS):
        order = F.when(F.col("kind").startswith(name), k).otherwise(order)
    return reasons.groupBy("id").agg(F.min(F.struct(order.alias("o"), F.col("depth"), F.col("kind"))).alias("m")).select("id", F.col("m.kind").alias("kind"), F.col("m.depth").alias("depth"))


def impact(relations: DataFrame, targets: DataFrame, changed: DataFrame, removed: DataFrame, linked: DataFrame | None = None, max_depth: int | None = None, baseline: DataFrame | None = None) -> DataFrame:
    """first_reason of impact_reasons."""
    return first_reason(impact_reasons(relations, targets, changed, removed, linked, max_depth, baseline))


def blast_radius(affected: DataFrame) -> DataFrame:
    """One row: targets affected, and how many by each kind of impact alone or with others."""
    return affected.agg(F.count_distinct("id").alias("targets"), *[F.count_distinct(F.when(F.col("kind").startswith(k), F.col("id"))).alias(k) for k in IMPACTS])


def caller_changes(before: DataFrame, now: DataFrame, contracts: DataFrame) -> DataFrame:
    """target, source, change of calls (source, target): added, removed, or contract, where both have the call and its caller's contract changed. contracts: id."""
    b, n = before.select("source", "target").distinct(), now.select("source", "target").distinct()
    same = b.join(n, ["source", "target"]).join(contracts.select(F.col("id").alias("source")).distinct(), "source", "left_semi")
    added, removed = n.join(b, ["source", "target"], "left_anti"), b.join(n, ["source", "target"], "left_anti")
    shape = lambda df, change: df.select("target", "source", F.lit(change).alias("change"))
    return shape(added, "added").unionByName(shape(removed, "removed")).unionByName(shape(same, "contract"))


def backward_invalidation(calls: DataFrame, targets: DataFrame, changed: DataFrame, contracts: DataFrame) -> DataFrame:
    """id, reason, via: callees of changed callers; call_tree_behavior_changed where the caller's contract changed, else upstream_call_structure_modified."""
    c = calls.join(changed.select(F.col("id").alias("source")).distinct(), "source", "left_semi").join(targets.select(F.col("id").alias("target")), "target", "left_semi").distinct()
    c = c.join(contracts.select(F.col("id").alias("source"), F.lit(True).alias("c")).distinct(), "source", "left")
    return c.select(F.col("target").alias("id"), F.when(F.col("c"), "call_tree_behavior_changed").otherwise("upstream_call_structure_modified").alias("reason"), F.col("source").alias("via"))


def invalidation(relations: DataFrame, targets: DataFrame, changed: DataFrame) -> DataFrame:
    """id, reason, via: every reason for which a target's result no longer holds; via is the immediate dependency.

    changed (via itself); calls, references or implements of an affected target; contains (parents of affected targets,
    via the child); last conservative (siblings of affected failed or unsupported targets, via that target).
    """
    edges = cut(dependency_edges(relations).filter("relation != 'contains'").distinct())
    present = targets.select("id")
    start = changed.join(present, "id", "left_semi")
    reached = reachable(edges.select(F.col("target").alias("src"), F.col("source").alias("dst")), start.select(F.col("id").alias("node"))).select(F.col("node").alias("id"))
    reached = cut(reached.join(present, "id", "left_semi"))
    direct = start.select("id", F.lit("changed").alias("reason"), F.col("id").alias("via"))
    along = edges.join(reached.select(F.col("id").alias("target")), "target", "left_semi").join(present.select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("id"), F.col("relation").alias("reason"), F.col("target").alias("via"))
    up = targets.filter("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    above = reachable(up, reached.select(F.col("id").alias("node"))).select(F.col("node").alias("id")).join(present, "id", "left_semi")
    every = cut(reached.unionByName(above).distinct())
    held = targets.join(every, "id", "left_semi").filter("parent is not null").select(F.col("parent").alias("id"), F.lit("contains").alias("reason"), F.col("id").alias("via")).join(present, "id", "left_semi")
    spared = cut(targets.filter("parent is not null").select("id", "parent").join(every, "id", "left_anti"))  # few have affected siblings that are weak
    weak = targets.filter("inventory in ('failed', 'unsupported') and parent is not null").select("id", "parent").join(every, "id", "left_semi")
    weak = cut(weak.join(spared, "parent", "left_semi").select("parent", F.col("id").alias("via")))
    siblings = pairs_by(spared, weak, "parent").select("id", F.lit("conservative").alias("reason"), "via")
    return direct.unionByName(along).unionByName(held).unionByName(siblings)
