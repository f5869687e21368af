"""Rows in a global order, and their places in their groups, without a window over a group."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugelake.settle import settle


def in_order(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """A written table of the rows with ``at``, a number that ascends in the given order.

    Rows are dealt out by ranges of the order, equal ones by their place in the input, so a group
    or rows alike of any size spread over tasks. Numbers have gaps.
    """
    names = [f"_o{n}" for n in range(len(order))]
    keyed = rows.select("*", *(c.alias(n) for c, n in zip(order, names, strict=True)))
    keyed = keyed.withColumn("_tie", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(*names, "_tie").sortWithinPartitions(*names, "_tie")
    return settle(dealt.drop(*names, "_tie").withColumn("at", F.monotonically_increasing_id()), label)


def ranked(rows: DataFrame, group: str, order: list[Column], label: str) -> DataFrame:
    """Rows with ``idx``, the place in the group from 0 on, and ``n``, the size of the group.

    The group column must not be null. Places come from one sort by ranges and from a table with
    one row for each group and range.
    """
    placed = in_order(rows, [F.col(group), *order], label)
    placed = placed.withColumn("_part", F.shiftright("at", 33))
    parts = placed.groupBy(group, "_part").agg(F.min("at").alias("_first"), F.count("*").alias("_size"))
    whole = Window.partitionBy(group)
    before = F.sum("_size").over(whole.orderBy("_part")) - F.col("_size")
    parts = parts.select(
        group,
        "_part",
        (before - F.col("_first")).alias("_shift"),
        F.sum("_size").over(whole).alias("n"),
    )
    found = placed.join(settle(parts, f"{label}-ranges"), [group, "_part"])
    return found.withColumn("idx", F.col("at") + F.col("_shift")).drop("_part", "_shift", "at")
