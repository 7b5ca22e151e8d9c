"""Scans in a total order that no single task holds: parts in order, then what each part carries into the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.sources.stored import materialise

#: monotonically_increasing_id has the number of the partition above so many bits, and that of the row below.
_ROW_BITS = 33


def parts_in_order(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """df with __part and __row: rows of an earlier part come before those of a later one, rows of a part by __row.

    Parts are cut by sampled ranges of ``order``, so a hot leading column is many parts where the columns after it differ.
    The result is stored: what is joined to it later meets the same parts.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    at = F.col("__at")
    return materialise(placed.select(*df.columns, F.shiftright(at, _ROW_BITS).cast("int").alias("__part"), at.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("__row")), "in-order")


def _carried(placed: DataFrame, within: str | None, own: Column, total: Column, fold: Column, result: Column, name: str) -> DataFrame:
    """placed with ``name``: ``result`` of __own, a value within the part, and __before, the fold of the totals of the parts before.

    Only a total for each part (and each value of ``within`` in it) is gathered, of which a value that spans parts has one in each.
    """
    group = ["__part", *([within] if within else [])]
    totals = placed.groupBy(*group).agg(total.alias("__total"))
    before = Window.partitionBy(*group[1:]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(c).alias(f"__of{c}") for c in group], fold.over(before).alias("__before"))
    same = F.col("__part") == F.col("__of__part")
    if within:
        same = same & F.col(within).eqNullSafe(F.col(f"__of{within}"))
    else:  # one row for each part
        carried = F.broadcast(carried)
    columns = [c for c in placed.columns if c not in ("__part", "__row")]
    return placed.withColumn("__own", own).join(carried, same).select(*columns, result.alias(name))


def _earlier(within: str | None):
    return Window.partitionBy("__part", *([within] if within else [])).orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, order: list[Column], name: str, within: str | None = None, parts: int | None = None) -> DataFrame:
    """df with ``name``: the number of a row in ``order``, from 0; with ``within``, a column, its number among rows of the same value."""
    placed = parts_in_order(df, [*([F.col(within)] if within else []), *order], parts)
    # rows of a value follow one another in a part
    own = F.col("__row") - F.min("__row").over(Window.partitionBy("__part", within)) if within else F.col("__row")
    return _carried(placed, within, own, F.count("*"), F.sum("__total"), F.coalesce("__before", F.lit(0)) + F.col("__own"), name)


def running_sum(df: DataFrame, order: list[Column], value: str, name: str, within: str | None = None, parts: int | None = None) -> DataFrame:
    """df with ``name``: the sum of ``value`` over all earlier rows (with ``within``, those of the same value of it)."""
    placed = parts_in_order(df, [*([F.col(within)] if within else []), *order], parts)
    return _carried(placed, within, F.sum(value).over(_earlier(within)), F.sum(value), F.sum("__total"), F.coalesce("__before", F.lit(0)) + F.coalesce("__own", F.lit(0)), name)


def last_before(df: DataFrame, order: list[Column], value: str, name: str, within: str | None = None, parts: int | None = None) -> DataFrame:
    """df with ``name``: the last ``value`` that isn't null of the earlier rows (with ``within``, those of the same value of it), or null."""
    placed = parts_in_order(df, [*([F.col(within)] if within else []), *order], parts)
    total = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("__row")))
    return _carried(placed, within, F.last(value, ignorenulls=True).over(_earlier(within)), total, F.last("__total", ignorenulls=True), F.coalesce("__own", "__before"), name)
