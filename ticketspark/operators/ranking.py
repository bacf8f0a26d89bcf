"""Order-based building blocks (W1, W2, W3, W5, W6, T3) that survive hot keys.

Every order used here is total, so results do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketspark.session import partitions, written


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """W1. First row per key under ``order``.

    The rank filter becomes ``WindowGroupLimit``: each task sends at most one row per key to the
    shuffle, so a key that holds a third of all rows costs no more than any other.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def first_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key, numbered in ``position``; cut before the shuffle like W1."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(window)).where(F.col("position") <= n)


def last_value(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """W6. The value at the highest position wins; combined on the map side."""
    return df.groupBy(key).agg(F.max_by(value, position).alias(value))


def in_ranges(df: DataFrame, order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Rows with ``_part``, their range of a total order.

    Spark samples the order key, so ranges hold about the same number of rows whatever the key's values are: a
    burst at one instant is cut by the columns behind it, an outlier moves no other row. The ranges are
    written, because a second run could draw other bounds.
    """
    dealt = df.repartitionByRange(parts or partitions(df.sparkSession), *order)
    return written(dealt.withColumn("_part", F.spark_partition_id()), "ranges")


def numbered_in_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], into: str = "n", parts: int | None = None
) -> DataFrame:
    """W3. Running number from 1 inside each group, for groups of any size.

    Groups lie one after the other in ranges. Inside a range a group is numbered alone; only the first group of a
    range can have rows in ranges before it, so the shifts are at most one row per range.
    """
    keys = list(keys)
    rows = in_ranges(df, [*keys, *order], parts)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_shift", F.sum("_rows").over(before)).where("_shift > 0")
        .select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of_part"), "_shift")
    )
    same = F.col("_part") == F.col("_of_part")
    for key in keys:
        same &= F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    # At most one row per range.
    return (
        rows.withColumn("_inside", F.row_number().over(inside)).join(F.broadcast(shifts), same, "left")
        .withColumn(into, F.col("_inside") + F.coalesce("_shift", F.lit(0)))
        .select(*df.columns, into)
    )


def _before(rows: DataFrame) -> DataFrame:
    """Rows before each range; one row per range."""
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    return counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))


def dense_index(df: DataFrame, key: str, into: str = "index", parts: int | None = None) -> DataFrame:
    """Gap-free index from 0 in the order of a unique key, without one global sort task."""
    rows = in_ranges(df, [F.col(key)], parts)
    inside = Window.partitionBy("_part").orderBy(key)
    return (
        rows.join(F.broadcast(_before(rows)), "_part")
        .withColumn(into, F.col("_before") + F.row_number().over(inside) - 1)
        .select(*df.columns, into)
    )


#: Tasks whose first rows meet in one task of the second level.
TASKS_A_GROUP = 256


def _few(df: DataFrame) -> int:
    """Up to this rank Spark cuts groups before it shuffles them."""
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))


def first_rows(df: DataFrame, key: str | Sequence[str], n: int, parts: int | None = None) -> DataFrame:
    """T3. Exactly the first min(n, rows) rows in the order of ``key``.

    NULL keys come last, and repeated keys count row by row (which of them stays is open unless further key columns
    tell them apart). For a few rows each task sends its own first ``n`` only, to one of several tasks that do the same, and
    their first ``n`` meet in one; nothing is written. For many rows the table is cut into ranges, and only those before
    row ``n`` are ranked, each on its own.
    """
    order = [F.col(k).asc_nulls_last() for k in ([key] if isinstance(key, str) else key)]
    if 0 < n <= _few(df):
        grouped = df.withColumn("_group", F.expr(f"spark_partition_id() div {TASKS_A_GROUP}"))
        rank = F.row_number().over(Window.partitionBy("_group").orderBy(*order))
        return grouped.withColumn("_rank", rank).where(F.col("_rank") <= n).orderBy(*order).limit(n).select(*df.columns)
    rows = in_ranges(df, order, parts)
    needed = _before(rows).where(F.col("_before") < n)
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        rows.join(F.broadcast(needed), "_part")
        .withColumn("_rank", F.col("_before") + F.row_number().over(inside))
        .where(F.col("_rank") <= n)
        .select(*df.columns)
    )


def _histogram(hashed: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with the range of their hash (its first four digits), and per group and range the rows
    in it, the rows before it and the rows in all. At most 65,536 rows per group reach a window."""
    ranged = hashed.select(*group, "_hash", F.substring("_hash", 1, 4).alias("_range"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    return ranged, counts.withColumns({
        "_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "_n": F.sum("_rows").over(whole)
    })


def _at_edge(rank: Column) -> Column:
    return (F.col("_before") < rank) & (F.col("_before") + F.col("_rows") >= rank)


def _hash_at(ranged: DataFrame, edges: DataFrame, group: list[str]) -> DataFrame:
    """Only the ranges named in ``edges``, one row per wanted rank, are ranked."""
    inside = Window.partitionBy(*group, "name", "_range").orderBy("_hash")
    return (
        ranged.join(F.broadcast(edges), [*group, "_range"])
        .withColumn("_rank", F.row_number().over(inside))
        .where(F.col("_rank") == F.col("_need"))
        .select(*group, "name", F.col("_hash").alias("cutoff"))
    )


def rank_cutoff(hashed: DataFrame, rank: Callable[[Column], Column]) -> DataFrame:
    """Hash at one rank over all rows, the rank being a function of their number.

    ``hashed`` has a hex column ``_hash`` that is unique per row. Exact, and nothing is sorted but
    one range of the hash. One row with ``cutoff``; none for no rows.
    """
    ranged, counts = _histogram(hashed, [])
    wanted = rank(F.col("_n"))
    edges = counts.where(_at_edge(wanted)).select("_range", F.lit("").alias("name"), (wanted - F.col("_before")).alias("_need"))
    return _hash_at(ranged, edges, []).select("cutoff")


def rank_cutoffs(hashed: DataFrame, ranks: DataFrame, group: str) -> DataFrame:
    """The same per class and for several ranks: ``group``, ``name``, ``cutoff``.

    ``ranks`` has ``group``, ``name`` and ``rank``, a handful of rows per class of a closed
    vocabulary.
    """
    ranged, counts = _histogram(hashed, [group])
    edges = (
        counts.join(F.broadcast(ranks), group)
        .where(_at_edge(F.col("rank")))
        .select(group, "_range", "name", (F.col("rank") - F.col("_before")).alias("_need"))
    )
    return _hash_at(ranged, edges, [group])
