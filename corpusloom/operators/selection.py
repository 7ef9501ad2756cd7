"""Exact order statistics of large groups: a mergeable sketch brackets a rank, and only what lies between is ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points of the sketch, and the share of a group by which their ranks may be wrong.
POINTS, ERROR = 200, 1 / 2000


def sketch(value: Column) -> Column:
    """Values at ``POINTS`` + 1 even ranks of a group, from the least to the greatest, each off by ``ERROR`` of the rows at most."""
    return F.percentile_approx(value, F.array(*[F.lit(k / POINTS) for k in range(POINTS + 1)]), F.lit(int(1 / ERROR)))


def bracket(points: Column, rows: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Values between which the ranks ``low`` to ``high`` (from 0, ascending) of ``rows`` values surely lie."""
    first = F.floor(((low - 1) / rows - ERROR) * POINTS) - 1
    last = F.ceil(((high + 2) / rows + ERROR) * POINTS) + 1
    clip = lambda k: F.least(F.greatest(k, F.lit(0)), F.lit(POINTS)).cast("int")
    return F.get(points, clip(first)), F.get(points, clip(last))


def percentiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and a column for each of ``shares``: exact percentiles between neighbouring values, of groups of any size.

    No group's values meet in one buffer: those inside a bracket, about two hundredths, are counted by
    value and ordered. Nulls do not count.
    """
    rows = df.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), sketch(F.col("v")).alias("points"))
    asked = F.array(*[F.struct(F.lit(k).alias("name"), (F.lit(p) * (F.col("n") - 1)).alias("at")) for k, p in shares.items()])
    listed = groups.select("g", "n", "points", F.explode(asked).alias("a")).select("g", "n", "points", "a.name", "a.at")
    low, high = bracket(F.col("points"), F.col("n"), F.floor("at"), F.ceil("at"))
    limits = listed.select(F.col("g").alias("_g"), "name", "at", low.alias("low"), high.alias("high"))
    met = rows.join(limits, F.col("g").eqNullSafe(F.col("_g"))).where("v <= high")
    counts = met.groupBy("g", "name", "at", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("g", "name").orderBy(F.asc_nulls_first("v"))
    upto = counts.withColumn("upto", F.sum("n").over(own)).where("v is not null")  # below the bracket is one row, without a value
    held = upto.groupBy("g", "name", "at").agg(
        F.min(F.when(F.col("upto") > F.floor("at"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v"))).alias("b")
    )
    told = held.withColumn("p", F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at")))
    return told.groupBy(F.col("g").alias(by)).agg(*[F.max(F.when(F.col("name") == k, F.col("p"))).alias(k) for k in shares])


def newest(df: DataFrame, by: str, order: str, key: str, most: Column) -> DataFrame:
    """The rows of each group with the greatest ``order``, of equal ones with the smallest ``key``, up to ``most`` of the group.

    What lies above a bracket of the last kept row stays and what lies below goes; only what is between is ordered.
    """
    number = F.unix_micros(F.col(order).cast("timestamp")) if df.schema[order].dataType.simpleString().startswith("timestamp") else F.col(order).cast("double")
    rows = df.withColumns({"_v": number, "_most": most})
    groups = rows.groupBy(F.col(by).alias("_g")).agg(F.count("_v").alias("_rows"), F.max("_most").alias("_limit"), sketch(F.col("_v")).alias("_points"))
    at = F.greatest(F.col("_rows") - F.col("_limit"), F.lit(0))
    low, high = bracket(F.col("_points"), F.col("_rows"), at, at)
    limits = groups.select("_g", "_limit", low.alias("_low"), high.alias("_high"))
    met = rows.join(limits, F.col(by).eqNullSafe(F.col("_g"))).where((F.col("_limit") > 0) & (F.col("_v") >= F.col("_low")))
    above = met.where("_v > _high").groupBy(F.col("_g").alias("_a")).agg(F.count("*").alias("_above"))
    between = met.where("_v <= _high").join(above, F.col("_g").eqNullSafe(F.col("_a")), "left")
    place = F.row_number().over(Window.partitionBy("_g").orderBy(F.desc("_v"), key))
    last = between.withColumn("_n", place).where(F.col("_n") + F.coalesce("_above", F.lit(0)) <= F.col("_limit"))
    return met.where("_v > _high").select(df.columns).unionByName(last.select(df.columns))
