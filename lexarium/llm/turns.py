"""Turns of conversations in order: places inside their conversation without a window over a whole one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def digest(role: Column, text: Column) -> list[Column]:
    """Two longs of 60 bits of SHA-256 over role and text."""
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return [F.conv(F.substring(whole, 1 + 15 * k, 15), 16, 10).cast("bigint").alias(f"d{k + 1}") for k in range(2)]


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows plus pos: their place in their group, from 0, by order (nulls first).

    Rows are dealt out by ranges of (group, order) and numbered inside a range. Only the first group of a range can
    have begun in an earlier one, so what comes before is a table of one row a range at most, and that is broadcast. A
    group may hold any share of the rows. Equal rows stay in one range.
    """
    dealt = materialize(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "turns")
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)) - 1
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    earlier = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), before.alias("_before")).where("_before > 0")
    out = dealt.withColumn("_in", inside).join(F.broadcast(earlier), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")), "left")
    return out.withColumn("pos", F.col("_in") + F.coalesce("_before", F.lit(0))).drop("_range", "_in", "_g", "_r", "_before")
