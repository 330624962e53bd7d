"""Positions in an order, counted by all tasks at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgermatch.session import materialise


def same(left: str, right: str, columns: list[str]):
    """Null-safe equality of ``columns`` of two aliased frames."""
    pairs = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]
    return reduce(lambda a, b: a & b, pairs)


def numbered(rows: DataFrame, group: list[str], order: list[str], position: str = "position", total: str = "total") -> DataFrame:
    """``rows`` with their place from 0 among the rows of their ``group`` by ``order``, and the group's size.

    The rows are dealt to tasks by ranges of (group, order); a task numbers its own, and what comes before a
    task follows from a count per task and group. No task holds a group, however large: rows that agree
    in all order columns are spread by their place in the input. Nulls come first.
    """
    spread = rows.withColumn("__spread", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange(*group, *order, "__spread").sortWithinPartitions(*group, *order, "__spread")
    placed = materialise(ranged.drop("__spread").withColumn("__at", F.monotonically_increasing_id())
                         .withColumn("__task", F.shiftrightunsigned("__at", 33)))
    counts = placed.groupBy("__task", *group).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = F.sum("__n").over(whole.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialise(counts.select("__task", *group, "__first", F.coalesce(before, F.lit(0)).alias("__before"),
                                        F.sum("__n").over(whole).alias("__total")))
    joined = placed.alias("p").join(offsets.alias("o"), same("p", "o", ["__task", *group]))
    return joined.select(*(F.col(f"p.{c}") for c in rows.columns),
                         (F.col("p.__at") - F.col("o.__first") + F.col("o.__before")).alias(position),
                         F.col("o.__total").alias(total))
