"""Distribution of one column, for all rows and for the flagged rows: histogram and density curve."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from labelrank.functions.columns import nan_to_null

# Beyond this many bandwidths the kernel is 0 in double precision.
_REACH = 39.0
# Cells in bandwidths, and moments of a cell: (_CELL / 2) ** _ORDER / sqrt(_ORDER!) bounds what is left out.
_CELL, _ORDER = 0.125, 12


def _series(df: DataFrame, col: str, flag: str | None) -> DataFrame:
    """(series, x): every row in 'all', the flagged ones also in 'winners'."""
    names = F.array(F.lit("all"))
    if flag:
        names = F.when(F.col(flag).cast("boolean"), F.array(F.lit("all"), F.lit("winners"))).otherwise(names)
    x = nan_to_null(F.col(col).cast("double"))
    return df.select(x.alias("x"), names.alias("names")).where("x is not null").select(F.explode("names").alias("series"), "x")


def _summary(df: DataFrame, col: str, flag: str | None) -> dict[str, tuple]:
    rows = (
        _series(df, col, flag)
        .groupBy("series")
        .agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd"))
        .collect()
    )
    return {r["series"]: r for r in rows}


def _edges(lo: float, hi: float) -> tuple[float, float]:
    """Range of the bins; a constant column gets a range of width 1 around its value."""
    return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)


def histogram(df: DataFrame, col: str, flag: str | None = None, bins: int = 30) -> DataFrame:
    """(series, bin, lo, hi, n) with equal bins over each series' own range; empty bins are kept.

    The last bin includes the maximum.
    """
    spark = df.sparkSession
    seen = _summary(df, col, flag)
    if not seen:
        return spark.createDataFrame([], "series string, bin int, lo double, hi double, n bigint")
    ranges = spark.createDataFrame(
        [(s, *_edges(r["lo"], r["hi"])) for s, r in seen.items()], "series string, start double, stop double"
    )
    width = (F.col("stop") - F.col("start")) / bins
    placed = _series(df, col, flag).join(F.broadcast(ranges), "series").select(
        "series", F.least(F.width_bucket("x", "start", "stop", F.lit(bins)), F.lit(bins)).cast("int").alias("bin")
    )
    counts = placed.groupBy("series", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = ranges.select("*", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return grid.join(counts, ["series", "bin"], "left").select(
        "series", "bin",
        (F.col("start") + (F.col("bin") - 1) * width).alias("lo"),
        (F.col("start") + F.col("bin") * width).alias("hi"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def _polynomials(order: int) -> list[list[float]]:
    """Per power of t: what each moment sum(u**k), k < order, adds to its coefficient.

    exp(-(t - u)**2 / 2) = exp(-t**2 / 2) * sum over k of He_k(t) * u**k / k!, with He_(k+1) = t * He_k - k * He_(k-1).
    """
    hermite = [[1.0], [0.0, 1.0]]
    for k in range(1, order - 1):
        raised, lower = [0.0, *hermite[k]], hermite[k - 1]
        hermite.append([c - (k * lower[j] if j < len(lower) else 0.0) for j, c in enumerate(raised)])
    return [[hermite[k][j] / math.factorial(k) if j <= k else 0.0 for k in range(order)] for j in range(order)]


def density(df: DataFrame, col: str, flag: str | None = None, bins: int = 30, points: int = 200) -> DataFrame:
    """(series, point, x, density, scaled): Gaussian kernel density on a grid over the column's range.

    Bandwidth by Scott's rule; ``scaled`` is the density times rows times bin width, the height that fits
    the histogram. Values are added up once, as powers of their distance from the middle of a narrow cell; grid
    points then take the kernel sums of all cells within reach from these moments, by the kernel's Hermite series.
    So a value costs the same whatever the grid, and what leaves a task is a row per cell. The series is cut where
    a cell's values are within 1e-18 of the kernel's height.
    """
    spark = df.sparkSession
    seen = {s: r for s, r in _summary(df, col, flag).items() if r["n"] > 1 and r["lo"] < r["hi"]}
    out = "series string, point int, x double, density double, scaled double"
    if not seen:
        return spark.createDataFrame([], out)
    plan = F.broadcast(spark.createDataFrame(
        [
            (s, r["lo"], (r["hi"] - r["lo"]) / (points - 1), r["sd"] * r["n"] ** -0.2, float(r["n"]),
             (r["hi"] - r["lo"]) / bins)
            for s, r in seen.items()
        ],
        "series string, start double, step double, bw double, rows double, width double",
    ))
    size = F.col("bw") * _CELL
    middle = F.col("start") + (F.col("cell") + 0.5) * size
    cells = (
        _series(df, col, flag).join(plan, "series")
        .withColumn("cell", F.floor((F.col("x") - F.col("start")) / size))
        .select("series", "cell", ((F.col("x") - middle) / F.col("bw")).alias("u"))
        .groupBy("series", "cell")
        .agg(F.count(F.lit(1)).cast("double").alias("m0"), *[F.sum(F.pow("u", F.lit(float(k)))).alias(f"m{k}") for k in range(1, _ORDER)])
    )
    factors = [
        reduce(Column.__add__, [F.col(f"m{k}") * c for k, c in enumerate(row) if c]).alias(f"a{j}") for j, row in enumerate(_polynomials(_ORDER))]
    placed = cells.join(plan, "series").select("series", "start", "step", "bw", middle.alias("middle"), *factors)
    place, span = (F.col("middle") - F.col("start")) / F.col("step"), F.col("bw") * _REACH / F.col("step")
    first, last = F.greatest(F.ceil(place - span), F.lit(0)), F.least(F.floor(place + span), F.lit(points - 1))
    near = F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))
    t = (F.col("start") + F.col("point") * F.col("step") - F.col("middle")) / F.col("bw")
    series = reduce(lambda total, j: total * F.col("t") + F.col(f"a{j}"), range(_ORDER - 2, -1, -1), F.col(f"a{_ORDER - 1}"))
    sums = (
        placed.withColumn("point", F.explode(near)).withColumn("t", t)
        .groupBy("series", "point")
        .agg(F.sum(F.exp(-0.5 * F.col("t") * F.col("t")) * F.greatest(series, F.lit(0.0))).alias("total"))
    )
    grid = plan.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    height = F.coalesce(F.col("total"), F.lit(0.0)) / (F.col("rows") * F.col("bw") * math.sqrt(2 * math.pi))
    return grid.join(sums, ["series", "point"], "left").select(
        "series", "point", (F.col("start") + F.col("point") * F.col("step")).alias("x"),
        height.alias("density"), (height * F.col("rows") * F.col("width")).alias("scaled"),
    )
