"""Group statistics: ranks, effect sizes, tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.operators.positional import running_sums


def average_rank(df: DataFrame, by: str, value: str) -> DataFrame:
    """Ranks with ties at their mean: from counts of distinct values, which are joined back."""
    ties = df.groupBy(by, value).agg(F.count("*").alias("t"))
    upto = running_sums(ties, [by], [value], {"upto": F.col("t")})
    ranks = upto.select(F.col(by).alias("by_"), F.col(value).alias("value_"), (F.col("upto") - (F.col("t") - 1) / 2).alias("avg_rank"))
    return df.join(ranks, F.col(by).eqNullSafe(F.col("by_")) & F.col(value).eqNullSafe(F.col("value_"))).drop("by_", "value_")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and, for each name, the quantile at its share (0 to 1), exact and with linear interpolation, nulls left out.

    Distinct values are counted with partial sums and placed by running counts over ranges of group and value, so that a
    group with any share of the rows is spread over tasks; no group's values are in one buffer."""
    if not by:
        return quantiles(df.withColumn("all_", F.lit(0)), ["all_"], value, shares).drop("all_")
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("t_"))
    upto = running_sums(counts, by, [value], {"upto_": F.col("t_")})
    totals = counts.groupBy(*by).agg(F.sum("t_").alias("n_"))
    same = [upto[c].eqNullSafe(totals[c]) for c in by]
    placed = upto.join(totals, same).select(*(upto[c] for c in by), value, "upto_", "t_", "n_")
    place = {k: (F.col("n_") - 1) * float(q) for k, q in shares.items()}
    # the value at a place (from 0) is that whose run of equal values covers it
    at = lambda p: F.max(F.when((F.col("upto_") > p) & (F.col("upto_") - F.col("t_") <= p), F.col(value)))
    aggs = [x for k, p in place.items() for x in (at(F.floor(p)).alias(f"{k}_low"), at(F.ceil(p)).alias(f"{k}_high"), F.max(p - F.floor(p)).alias(f"{k}_part"))]
    told = placed.groupBy(*by).agg(*aggs)
    return told.select(*by, *((F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * F.col(f"{k}_part")).cast("double").alias(k) for k in shares))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, population deviation, median, least, most, n."""
    if not by:
        return summary(df.withColumn("all_", F.lit(0)), ["all_"], value).drop("all_")
    told = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n"))
    medians = quantiles(df, by, value, {"median": 0.5}).select(*(F.col(c).alias(f"{c}_") for c in by), "median")
    joined = told.join(medians, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by], "left")
    return joined.select(*by, "mean", "std", "median", "min", "max", "n")


def cohens_d(m1: Column, m2: Column, v1: Column, v2: Column) -> Column:
    """Difference of means over the pooled population deviation; 0 if that is 0."""
    pooled = F.sqrt((v1 + v2) / 2)
    return F.when(pooled > 0, (m1 - m2) / pooled).otherwise(0.0)


def mann_whitney(df: DataFrame, group: str, value: str, one: str, two: str) -> DataFrame:
    """U of group `one` and its two-sided p-value: exact if a group has at most eight rows and there are no ties, else
    the normal tail with tie and continuity correction. One row. Values are summed by distinct value before they are
    ranked, and ranked by ranges of values."""
    pair = df.where(F.col(group).isin(one, two))
    by_value = pair.groupBy(value).agg(F.count("*").alias("t"), F.count_if(F.col(group) == one).alias("a"))
    ranked = running_sums(by_value, [], [value], {"upto": F.col("t")}).withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2)
    s = ranked.agg(F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum("a").alias("n1"), F.sum("t").alias("n"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))

    @F.pandas_udf("double")
    def p_value(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([u_p_value(*x) for x in zip(u, n1, n2, ties, strict=True)])

    u = (F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2).alias("u")
    out = s.select(u, F.col("n1"), (F.col("n") - F.col("n1")).alias("n2"), "ties")
    return out.withColumn("p", p_value(F.col("u"), F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("ties").cast("double"))).drop("ties")


def u_p_value(u: float, n1: float, n2: float, ties: float) -> float:
    n1, n2 = int(n1), int(n2)
    if not n1 or not n2:
        return float("nan")
    high = max(u, n1 * n2 - u)
    if min(n1, n2) <= 8 and ties == 0:
        # number of arrangements with each U, by the recurrence on the largest value's group
        counts = {(0, j): [1] for j in range(n2 + 1)} | {(i, 0): [1] for i in range(n1 + 1)}
        for i in range(1, n1 + 1):
            for j in range(1, n2 + 1):
                a, b = counts[i - 1, j], counts[i, j - 1]
                c = [0] * (i * j + 1)
                for k, x in enumerate(a):
                    c[k + j] += x
                for k, x in enumerate(b):
                    c[k] += x
                counts[i, j] = c
        c = counts[n1, n2]
        return min(1.0, 2 * sum(c[math.ceil(high) :]) / sum(c))
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) if n > 1 else 0.0
    if sd == 0:
        return 1.0
    return min(1.0, math.erfc((high - n1 * n2 / 2 - 0.5) / sd / math.sqrt(2)))
