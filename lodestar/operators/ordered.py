"""Order over a whole table without a task that holds it: numbers, ranks within groups, running minima.

Rows are dealt by ranges of the order and written, so that a range is a stretch of the whole order. What a range needs
from those before it (how many rows, the count or least value of a group that began there) is one row a range. A
group of any size is spread over ranges, as long as the order tells its rows apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.tables import cut

_AT, _PART, _GROUP, _LOCAL, _CARRY, _OF = (f"__lodestar_{x}" for x in ("at", "part", "group", "local", "carry", "of"))


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in ranges of the order, each sorted, with the number of the range and the place within all."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_AT, F.monotonically_increasing_id()))
    return rows.withColumn(_PART, F.shiftright(_AT, 33))


def numbered(df: DataFrame, order: list[Column], name: str, after: int = 0) -> DataFrame:
    """df with a number: after + 1, after + 2 and so on in the order, without a gap. Rows that the order doesn't tell apart follow each other in any way."""
    rows = _ranged(df, order)
    sizes = rows.groupBy(_PART).agg(F.count(F.lit(1)).alias(_LOCAL))
    begins = sizes.select(_PART, (F.sum(_LOCAL).over(Window.orderBy(_PART)) - F.col(_LOCAL)).alias(_CARRY))  # a row a range
    placed = rows.join(F.broadcast(begins), _PART)
    return placed.withColumn(name, F.lit(after) + F.col(_CARRY) + F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop(_AT, _PART, _CARRY)


def _carried(rows: DataFrame, gathered: Column, add) -> DataFrame:
    """_PART, _OF, _CARRY for ranges that begin within a group: its value over all ranges before."""
    groups = rows.groupBy(_PART, _GROUP).agg(F.min(_AT).alias("_first"), F.max(_AT).alias("_last"), gathered.alias("_v"))
    ends = groups.groupBy(_PART).agg(F.min_by(_GROUP, "_first").alias("_begins"), F.max_by(F.struct(_GROUP, "_v"), "_last").alias("_ends"))
    asks = ends.select(F.col("_begins").alias(_OF), _PART, F.col("_ends._v").alias("_v"), F.lit(0).alias("_kind")).withColumn("_v", F.when(F.lit(False), F.col("_v")))
    gives = ends.select(F.col(f"_ends.{_GROUP}").alias(_OF), _PART, F.col("_ends._v").alias("_v"), F.lit(1).alias("_kind"))
    before = Window.partitionBy(_OF).orderBy(_PART, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return asks.unionByName(gives).withColumn(_CARRY, add("_v").over(before)).filter(f"_kind = 0 and {_CARRY} is not null").select(_PART, _OF, _CARRY)


def _running(df: DataFrame, group: list[str], order: list[Column], gathered: Column, add, both) -> DataFrame:
    rows = _ranged(df, [*map(F.col, group), *order]).withColumn(_GROUP, F.struct(*group))
    carry = _carried(rows, gathered, add)
    local = Window.partitionBy(_PART, _GROUP).orderBy(_AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a range's rows at most
    rows = rows.withColumn(_LOCAL, gathered.over(local)).join(F.broadcast(carry), _PART, "left")  # a row a range at most
    value = F.when(F.col(_OF).eqNullSafe(F.col(_GROUP)), both(F.col(_LOCAL), F.col(_CARRY))).otherwise(F.col(_LOCAL))
    return rows.withColumn(_LOCAL, value).drop(_AT, _PART, _GROUP, _OF, _CARRY)


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """df with each row's rank in its group, from 1. The order should tell the rows of a group apart."""
    return _running(df, group, order, F.count(F.lit(1)), F.sum, lambda a, b: a + b).withColumnRenamed(_LOCAL, name)


def running_min(df: DataFrame, group: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """df with the least value (nulls aside) of its group's rows up to and with this one in the order."""
    return _running(df, group, order, F.min(value), F.min, F.least).withColumnRenamed(_LOCAL, name)


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of a column over its group's rows up to and with this one in the order."""
    return _running(df, group, order, F.sum(value), F.sum, lambda a, b: a + b).withColumnRenamed(_LOCAL, name)
