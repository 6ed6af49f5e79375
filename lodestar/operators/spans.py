"""Which span of a file holds a place: containment of intervals by equi-joins and sorted order.

A span [s, e) holds a place [start, end) if s <= start and end <= e. Starts are put in aligned cells, each four of the
level below: a span lies in one cell of each level, and the starts up to a place's own are the union of at most three
cells a level (the digits of start + 1 to the base of four). Within a cell, sorted by falling end, the best span so far
is the one that a place there takes. So a place has a few candidates a level, no pair of place and span is made, and a
file of any size is spread. Equal spans count once, and so do places of many points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.tables import cut
from lodestar.operators.ordered import running_min

#: Spans of a file that each of its places is compared with one by one; larger files go through cells.
FEW = 32
#: How well a place was resolved.
EXACT, CONTAINING, FALLBACK, UNMAPPED = "exact", "containing_target", "file_fallback", "unmapped"


def resolve_places(points: DataFrame, spans: DataFrame, few: int = FEW) -> DataFrame:
    """point, id, quality: the smallest span of the same path that holds [start, end); whole files only if nothing else does.

    points: point, path, start, end; spans: id, path, s, e, is_file. Offsets count from 0; a place or span of no length
    counts like any other. Ties go to the least id. Spans without a path or with s > e hold nothing; a null path, start or
    end is unmapped. quality: exact if a span that is no file has the place's bounds, containing_target, file_fallback, unmapped.
    """
    spans = spans.filter("path is not null and 0 <= s and s <= e").groupBy("path", "s", "e", "is_file").agg(F.min("id").alias("id"))
    spans = cut(spans)  # of equal spans the one of the least id
    files = cut(spans.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("top")))
    large = files.filter(F.col("n") > few)
    best = lambda: F.struct("is_file", (F.col("e") - F.col("s")).alias("len"), "id", "s")
    points = points.select("point", "path", "start", "end")
    places = cut(points.filter("path is not null and start is not null and end is not null").select("path", "start", "end").distinct())
    if large.isEmpty():
        found = _compared(places, spans, best())
    else:
        of = places.join(files, "path")
        small = spans.join(large, "path", "left_anti")
        found = _compared(of.filter(F.col("n") <= few).select(*places.columns), small, best())
        found = found.unionByName(_celled(of.filter(F.col("n") > few), spans.join(large, "path"), best()))
    found = points.join(found, ["path", "start", "end"], "left").groupBy("point", "start", "end").agg(F.min("b").alias("b"))
    b = F.col("b")
    exact = (b["s"] == F.col("start")) & (b["len"] == F.col("end") - F.col("start"))
    quality = F.when(b.isNull(), UNMAPPED).when(b["is_file"], FALLBACK).when(exact, EXACT).otherwise(CONTAINING)
    return found.select("point", b["id"].alias("id"), quality.alias("quality"))


def _compared(places: DataFrame, spans: DataFrame, best) -> DataFrame:
    """path, start, end, b over files of few spans: each span of the file is looked at."""
    spans = spans.select("path", "s", "e", best.alias("b"))
    j = places.join(spans, "path").filter((F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")))
    return j.groupBy("path", "start", "end").agg(F.min("b").alias("b"))


def _celled(places: DataFrame, spans: DataFrame, best) -> DataFrame:
    """path, start, end, b over large files. top: the largest start of the file, whose bits are its levels. Of a cell's spans with one end only the best is kept."""
    levels = F.expr("sequence(0, length(bin(top)) + 1, 2)")
    spans = spans.select("path", "s", "e", best.alias("b"), F.explode(levels).alias("level"))
    cells = spans.groupBy("path", "level", F.expr("shiftright(s, level)").alias("cell"), F.col("e").alias("edge")).agg(F.min("b").alias("b"), F.lit(0).alias("kind"))
    upto = places.withColumn("upto", F.least("start", "top") + 1)
    digits = "transform(sequence(0, length(bin(top)) + 1, 2), k -> struct(k as level, shiftright(upto, k) as upper))"
    cut_off = f"flatten(transform({digits}, d -> transform(filter(array(0, 1, 2), j -> j < d.upper % 4), j -> struct(d.level as level, d.upper - d.upper % 4 + j as cell))))"
    upto = upto.withColumn("in", F.explode(F.expr(cut_off)))
    at = upto.select("path", F.col("in.level").alias("level"), F.col("in.cell").alias("cell"), F.col("end").alias("edge"), F.lit(1).alias("kind"), "start")
    rows = cut(cells).unionByName(at, allowMissingColumns=True)
    order = [F.col("edge").desc(), F.col("kind"), F.col("start")]  # of equal ends spans come first
    rows = running_min(rows, ["path", "level", "cell"], order, "b", "least").filter("kind = 1 and least is not null")
    return rows.groupBy("path", "start", F.col("edge").alias("end")).agg(F.min("least").alias("b"))
