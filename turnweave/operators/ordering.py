"""Running sums and dense numbers in a global order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.shared import materialize


def running_sums(df: DataFrame, order: list[Column | str], sums: dict[str, Column], by: tuple[str, ...] = (), with_groups: DataFrame | None = None) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum over the rows up to this one in ``order`` within its group ``by``, and as name_total that of the whole group.

    Rows are range-partitioned by (by, order) and written once; sums of each partition's part of
    a group give the offsets of the next ones, so a group that holds most rows is spread over
    many tasks.  What is held for it is a row for each partition and group that meet, as many as
    partitions and groups together.  ``with_groups`` has further columns of the groups, one row
    a group; they come along with the offsets, so that no row is joined by its group alone.
    Null is a group of its own.  Rows that are equal in all of ``order`` share a partition, in
    any order.  Columns of ``df`` don't begin with two underscores.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*by, *order]
    ranged = materialize(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("__part", F.shiftright("__at", 33))  # the id holds the partition above 33 bits
    parts = ranged.groupBy("__part", *by).agg(*(F.sum(v).alias(f"__sum_{name}") for name, v in sums.items()))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    named = {name: f"__by_{k}" for k, name in enumerate(by)}
    offsets = parts.select(
        F.col("__part").alias("__of"), *(F.col(name).alias(new) for name, new in named.items()),
        *(F.coalesce(F.sum(f"__sum_{name}").over(earlier), F.lit(0)).alias(f"__before_{name}") for name in sums),
        *(F.sum(f"__sum_{name}").over(group).alias(f"{name}_total") for name in sums),
    )
    if with_groups is not None:
        more = with_groups.select(*(F.col(name).alias(f"{new}_too") for name, new in named.items()), *(c for c in with_groups.columns if c not in by))
        offsets = offsets.join(more, [F.col(new).eqNullSafe(F.col(f"{new}_too")) for new in named.values()]).drop(*(f"{new}_too" for new in named.values()))
    inside = Window.partitionBy("__part", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumns({f"__inside_{name}": F.sum(v).over(inside) for name, v in sums.items()})
    joined = rows.join(offsets, [F.col("__part") == F.col("__of"), *(F.col(name).eqNullSafe(F.col(new)) for name, new in named.items())])
    extra = [c for c in with_groups.columns if c not in by] if with_groups is not None else []
    return joined.select(*df.columns, *((F.col(f"__before_{name}") + F.col(f"__inside_{name}")).alias(name) for name in sums), *(f"{name}_total" for name in sums), *extra)


def dense_numbers(df: DataFrame, order: list[Column | str], name: str = "number") -> DataFrame:
    """``df`` with the place of each row in the order, from 0 on, and as name_total how many rows there are."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)
