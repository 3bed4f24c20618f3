"""Profiles and checks of cell tables."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..sources.tables import observed


def _long(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features]).unpivot(keys, features, "feature", "value")


def exact_percentiles(df: DataFrame, value: str, quantiles: dict[str, float], by: tuple[str, ...] = (), accuracy: int = 10_000) -> DataFrame:
    """(``by``, a column for each name in ``quantiles``): percentiles by linear interpolation; missing values are left out.

    No task holds the values of a group. Approximate percentiles, right to n / ``accuracy`` ranks, give a range of
    values around each quantile; the values in the range are counted by value, and running sums over these, from the
    number of values below on, find the two neighbours of the quantile. Groups up to ``accuracy`` values are one range.
    """
    keys = [F.col(c) for c in by]
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v_"))
    names, at = list(quantiles), list(quantiles.values())
    wide = [min(1.0, max(0.0, q + d)) for q in at for d in (-3 / accuracy, 3 / accuracy)]
    stats = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.percentile_approx("v_", wide, accuracy).alias("a_"))
    ranges = F.array(*[
        F.struct(F.lit(i).alias("i"), F.when(F.col("n_") > accuracy, F.get("a_", F.lit(2 * i))).alias("lo"), F.when(F.col("n_") > accuracy, F.get("a_", F.lit(2 * i + 1))).alias("hi"), (F.lit(float(q)) * (F.col("n_") - 1)).alias("at"))
        for i, q in enumerate(at)
    ])
    stats = stats.select(*keys, F.explode(ranges).alias("r_")).select(*keys, "r_.*")
    joined = known.join(F.broadcast(stats), list(by)) if by else known.join(F.broadcast(stats))  # a few rows for each group
    kept = joined.where(F.col("hi").isNull() | (F.col("v_") <= F.col("hi")))
    counts = kept.groupBy(*keys, "i", "at", F.when(F.col("lo").isNull() | (F.col("v_") >= F.col("lo")), F.col("v_")).alias("v_")).agg(F.count(F.lit(1)).alias("c_"))
    w = Window.partitionBy(*by, "i").orderBy(F.col("v_").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("end_", F.sum("c_").over(w))  # the value has ranks end - c to end - 1
    rank = lambda r: F.max(F.when((F.col("end_") - F.col("c_") <= r) & (r < F.col("end_")), F.col("v_")))
    down, up = rank(F.floor("at")), rank(F.ceil("at"))
    one = placed.groupBy(*keys, "i").agg(down.alias("d_"), up.alias("u_"), F.first("at").alias("at")).withColumn("x_", F.col("d_") + (F.col("u_") - F.col("d_")) * (F.col("at") - F.floor("at")))
    return one.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("x_"))).alias(name) for i, name in enumerate(names)])


def describe_features(df: DataFrame, features: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """By feature: count, mean, sample deviation, least, quartiles, largest, and the percentage missing."""
    v, long, keys = F.col("value"), _long(df, list(by), features), [*by, "feature"]
    sums = long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"),
        F.max("value").alias("largest"), (100 * F.count_if(v.isNull()) / F.count(F.lit(1))).alias("missing_pct"),
    )
    quartiles = exact_percentiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, tuple(keys))
    return sums.join(F.broadcast(quartiles), keys, "left").select(*keys, "n", "mean", "std", "least", "q25", "q50", "q75", "largest", "missing_pct")


def nan_pct_by_feature(df: DataFrame, features: list[str], seasons: list[str]) -> DataFrame:
    """Percentage missing by feature and season, and the largest over seasons, to three digits."""
    long = _long(df, ["season"], features).groupBy("feature").pivot("season", seasons).agg(F.round(100 * F.count_if(F.col("value").isNull()) / F.count(F.lit(1)), 3))
    return long.withColumn("largest", F.greatest(*seasons) if len(seasons) > 1 else F.col(seasons[0]))


def any_missing(features: list[str]):
    return F.greatest(*[F.col(c).isNull().cast("int") for c in features]) if len(features) > 1 else F.col(features[0]).isNull().cast("int")


def rows_with_missing(df: DataFrame, features: list[str]) -> DataFrame:
    n = F.count_if(any_missing(features) == 1)
    return df.agg(n.alias("n"), (100 * F.try_divide(n, F.count(F.lit(1)))).alias("pct"))


def nan_contributors(df: DataFrame, features: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Of rows with something missing, the percentage that lacks each feature, to one digit, largest first."""
    long = _long(df.where(any_missing(features) == 1), list(by), features).groupBy(*by, "feature").agg(F.round(100 * F.count_if(F.col("value").isNull()) / F.count(F.lit(1)), 1).alias("pct"))
    return long.orderBy(*by, F.desc("pct"), "feature")


def nan_coverage_grid(df: DataFrame, grid: Grid, features: list[str]) -> DataFrame:
    """Every grid cell with ``flag``: -1 outside the data, 0 complete, 1 something missing."""
    flags = df.select("row", "col", any_missing(features).alias("flag"))
    return grid.cells(df.sparkSession).join(flags, ["row", "col"], "left").withColumn("flag", F.coalesce("flag", F.lit(-1)))


def validate_raster(cells: DataFrame, value: str = "value") -> DataFrame:
    """One row: ``ok``, ``message``, ``valid_pct``."""
    n, known = F.count(F.lit(1)), F.count(value)
    message = F.when(n == 0, "no cells").when(known == 0, "all cells are missing").otherwise("ok")
    return cells.agg(message.alias("message"), (100 * F.try_divide(known, n)).alias("valid_pct")).select((F.col("message") == "ok").alias("ok"), "message", "valid_pct")


def validate_vector(features: DataFrame, crs: str = "crs") -> DataFrame:
    n = F.count(F.lit(1))
    known = F.count(crs) if crs in features.columns else F.lit(0)
    message = F.when(n == 0, "no features").when(known < n, "no coordinate system").otherwise("ok")
    return features.agg(message.alias("message")).select((F.col("message") == "ok").alias("ok"), "message")


def validate_table(df: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """One row: ``ok``, ``message``; missing columns come from the schema, and one row is read at most."""
    lost = sorted(set(expected or ()) - set(df.columns))
    message = f"missing columns: {', '.join(lost)}" if lost else None
    n = df.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.when(F.col("n") == 0, "empty").otherwise(F.coalesce(F.lit(message), F.lit("ok"))).alias("message")).select((F.col("message") == "ok").alias("ok"), "message")


def check_row_count(df: DataFrame, land: DataFrame) -> DataFrame:
    a, b = df.agg(F.count(F.lit(1)).alias("rows")), land.agg(F.count(F.lit(1)).alias("cells"))
    return a.join(b).select("rows", "cells", (F.col("rows") == F.col("cells")).alias("ok"))  # one row each


def require(df: DataFrame, least: int, what: str) -> DataFrame:
    """``df``, or an error if it has fewer than ``least`` rows; reads ``least`` rows at most."""
    if (n := df.limit(least).count()) < least:
        raise ValueError(f"{what}: {n} rows, {least} needed")
    return df


def require_each(df: DataFrame, by: str, wanted: list, least: int, what: str) -> DataFrame:
    """``df``, or an error if one of the ``wanted`` values of ``by`` has fewer than ``least`` rows."""
    counts = {r[0]: r[1] for r in df.where(F.col(by).isin(wanted)).groupBy(by).count().collect()}
    require_counts({k: counts.get(k, 0) for k in wanted}, least, what)
    return df


def require_counts(counts: dict, least: int, what: str) -> None:
    """An error that names what has fewer than ``least`` rows."""
    if short := {k: n for k, n in counts.items() if n < least}:
        raise ValueError(f"{what}: {least} needed, but there are {', '.join(f'{n} in {k}' for k, n in short.items())}")


def written_with_each(df: DataFrame, name: str, by: Column, wanted: list[str], least: int, what: str, where: Column | None = None) -> DataFrame:
    """``df`` as a table, or an error if one of the ``wanted`` values of ``by`` has fewer than ``least`` rows (that fulfil ``where``).

    The rows are counted by the job that writes them.
    """
    fits = F.lit(True) if where is None else where
    table, n = observed(df, name, {f"n{i}": F.count_if((by == v) & fits) for i, v in enumerate(wanted)})
    require_counts({v: n[f"n{i}"] for i, v in enumerate(wanted)}, least, what)
    return table


def report_empty(df: DataFrame, by: str, values: list, what: str) -> tuple[DataFrame, Callable[[], list]]:
    """``df``, and a function that names, once the job that reads it is done, the ``values`` of ``by`` without a row.

    It warns of each, as of classes that no cell got. Rows are counted by that job.
    """
    seen = Observation()
    told = df.observe(seen, *[F.count_if(F.col(by) == v).alias(f"n{i}") for i, v in enumerate(values)])

    def empty() -> list:
        found = seen.get
        none = [v for i, v in enumerate(values) if not found[f"n{i}"]]
        for v in none:
            warnings.warn(f"{what}: no row of {by} {v}", stacklevel=2)
        return none

    return told, empty
