"""Running sums per group that never gather a group in one task.

A window over a group that holds a third of all rows would run in a single task.
Here the rows are range-sorted over (group, order), each range partition sums its
own rows, and the totals of the earlier partitions are added as offsets: one row
per (partition, group) is all that is summed across partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeflow.session import shuffle_parts, stored

PART = "__part"


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column], parts: int | None = None, kind: str = "long", keep_part: bool = False) -> DataFrame:
    """df with, for each entry of sums, `<name>_run` (inclusive running sum within
    the group along `order`) and `<name>_all` (the group's total).

    The rows are fixed in a stored table after the range sort, because both the
    running sums and the offsets must see the same partition boundaries. `order`
    should make rows distinct within a group, so that a range boundary can fall
    anywhere. Null sort keys come first; an empty df gives an empty result. kind is
    the type the values are summed in; keep_part leaves the number of the range
    partition in the result, for suffix_min.
    """
    spark = df.sparkSession
    parts = parts or shuffle_parts(spark)
    names = list(sums)
    ranged = df.select("*", *(sums[n].cast(kind).alias(f"{n}__v") for n in names))
    ranged = ranged.repartitionByRange(parts, *group, *order).sortWithinPartitions(*group, *order)
    ranged = stored(ranged.withColumn(PART, F.spark_partition_id()))
    here = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.select("*", *(F.sum(f"{n}__v").over(here).alias(f"{n}__l") for n in names))
    sub = ranged.groupBy(PART, *group).agg(*(F.sum(f"{n}__v").alias(f"{n}__s") for n in names))
    # one row per range partition that holds part of the group
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = sub.select(
        F.col(PART).alias("__p"),
        *(F.col(g).alias(f"__g{k}") for k, g in enumerate(group)),
        *(F.coalesce(F.sum(f"{n}__s").over(before), F.lit(0).cast(kind)).alias(f"{n}__o") for n in names),
        *(F.sum(f"{n}__s").over(whole).alias(f"{n}__t") for n in names),
    )
    on = F.col(PART) == F.col("__p")
    for k, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    return local.join(offsets, on).select(
        *df.columns,
        *([PART] if keep_part else []),
        *((F.col(f"{n}__l") + F.col(f"{n}__o")).alias(f"{n}_run") for n in names),
        *(F.col(f"{n}__t").alias(f"{n}_all") for n in names),
    )


def suffix_min(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df plus `out`: the least `value` of a row and all rows after it in its group. df
    comes from running_sums(keep_part=True) over the same group and order."""
    # backwards with a growing frame: a frame that shrinks is evaluated anew for every row
    back = [F.col(c).desc_nulls_last() for c in order]
    after = Window.partitionBy(PART, *group).orderBy(*back).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sub = df.groupBy(PART, *group).agg(F.min(value).alias("__m"))
    later = Window.partitionBy(*group).orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    sub = sub.select(F.col(PART).alias("__p"), *(F.col(g).alias(f"__g{k}") for k, g in enumerate(group)), F.min("__m").over(later).alias("__later"))
    on = F.col(PART) == F.col("__p")
    for k, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    here = df.withColumn("__here", F.min(value).over(after)).join(sub, on)
    return here.select(*df.columns, F.least("__here", "__later").alias(out))


def known_around(df: DataFrame, group: list[str], order: list[str], value: str, before: str, after: str, parts: int | None = None) -> DataFrame:
    """df plus the last non-null `value` of the rows before and the first of those after a row in
    its group along `order` (null if there is none). No group is gathered in a task: range
    partitions look inside themselves, and one row per (partition, group) is looked up across."""
    ranged = df.repartitionByRange(parts or shuffle_parts(df.sparkSession), *group, *order).sortWithinPartitions(*group, *order)
    ranged = stored(ranged.withColumn(PART, F.spark_partition_id()))
    here = Window.partitionBy(PART, *group).orderBy(*order)
    down, up = here.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(PART, *group).orderBy(*(F.col(c).desc_nulls_last() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({before: F.last(value, ignorenulls=True).over(down), after: F.last(value, ignorenulls=True).over(up)})
    known = ranged.where(F.col(value).isNotNull())
    place = F.struct(*order, F.col(value).alias("__v"))
    ends = known.groupBy(PART, *group).agg(F.min(place).alias("__lo"), F.max(place).alias("__hi"))
    whole = ranged.select(PART, *group).distinct()
    on = F.col(PART) == F.col("__p")
    for k, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    ends = ends.select(F.col(PART).alias("__p"), *(F.col(g).alias(f"__g{k}") for k, g in enumerate(group)), "__lo", "__hi")
    across = Window.partitionBy(*group).orderBy(PART)
    sub = whole.join(ends, on, "left").select(PART, *group, F.last("__hi.__v", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("__known_b"), F.first("__lo.__v", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("__known_a"))
    sub = sub.select(F.col(PART).alias("__p"), *(F.col(g).alias(f"__g{k}") for k, g in enumerate(group)), "__known_b", "__known_a")
    return local.join(sub, on).select(*df.columns, F.coalesce(before, "__known_b").alias(before), F.coalesce(after, "__known_a").alias(after))
