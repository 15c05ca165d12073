"""Joins and splits by position, made explicit by an order column (J05, K27), and running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.sources.tables import written


def numbered(df: DataFrame, key: str, name: str = "i") -> DataFrame:
    """Places from 0 in the order of a unique key: ranges of the key are counted, then places are given within ranges, so
    no task holds the whole table. The dealt table is written once, so that both passes see the same ranges; one count a
    range reaches the driver."""
    ranged = written(df.repartitionByRange(key).withColumn("part_", F.spark_partition_id()), "ranged")
    counts = {r["part_"]: r["n"] for r in ranged.groupBy("part_").agg(F.count("*").alias("n")).collect()}
    base, starts = 0, []
    for p in sorted(counts):
        starts += [F.lit(p), F.lit(base).cast("long")]
        base += counts[p]
    if not starts:
        return df.withColumn(name, F.lit(None).cast("long"))
    within = F.row_number().over(Window.partitionBy("part_").orderBy(key)) - 1
    return ranged.withColumn(name, F.element_at(F.create_map(*starts), F.col("part_")) + within).drop("part_")


def zip_by_order(a: DataFrame, b: DataFrame, by_a: str, by_b: str) -> DataFrame:
    """Rows of equal place; the shorter side decides."""
    return numbered(a, by_a).join(numbered(b, by_b), "i").drop("i")


def split_parts(df: DataFrame, key: str, parts: int) -> DataFrame:
    """N // parts rows each; the last part takes the remainder."""
    n = df.count()
    size = max(1, n // parts)
    return numbered(df, key).select(key, F.least(F.floor(F.col("i") / size), F.lit(parts - 1)).cast("long").alias("part"))


def running_sums(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum over a group's rows up to each row. The order is to be unique within a group (rows of
    equal places would be summed in any order). Rows are dealt by ranges of group and order, so a
    group with any share of the rows lies in several tasks: each sums its own range, and a table of one row a range and
    group carries the totals over."""
    ranged = written(df.withColumns(sums).repartitionByRange(*by, *order).withColumn("part_", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("part_", *by).agg(*(F.sum(k).alias(k) for k in sums))
    bases = totals.select("part_", *by, *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_base_") for k in sums))
    upto = Window.partitionBy("part_", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({k: F.sum(k).over(upto) for k in sums})
    joined = local.join(bases.select(*(F.col(k).alias(f"{k}_of_") for k in ("part_", *by)), *(f"{k}_base_" for k in sums)), [F.col(k).eqNullSafe(F.col(f"{k}_of_")) for k in ("part_", *by)])
    return joined.select(*df.columns, *((F.col(k) + F.col(f"{k}_base_")).alias(k) for k in sums))
