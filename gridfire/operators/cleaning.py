"""Label cleaning: low cells that cluster with high ones lose their label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def sample_per_class(df: DataFrame, cap: int = 200_000) -> DataFrame:
    """At most ``cap`` rows of each label, those with the smallest hash (MD5) of the cell; the same in every run."""
    classes = [r.label for r in df.where("label IS NOT NULL").select("label").distinct().collect()]
    parts = [df.where(F.col("label") == k).orderBy(F.md5(F.concat_ws(",", "row", "col").cast("binary")), "row", "col").limit(cap) for k in sorted(classes)]
    return reduce(DataFrame.union, parts) if parts else df.where(F.lit(False))


def standardize(df: DataFrame, features: list[str]) -> DataFrame:
    """Z-scores by the population deviation; a constant column becomes 0. Missing values stay missing."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = {c: (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in features}
    return df.join(F.broadcast(stats)).withColumns(z).select(*df.columns)  # one row of statistics


def first_centres(rows: DataFrame, features: list[str], k: int, n_init: int, seed: int) -> list[list[list[float]]]:
    """For each start, ``k`` rows of different features as centres: those with the smallest hash (MD5) of seed, start and cell.

    Rows of equal features count as the one of the smallest cell, so that no two centres are one.
    """
    places = rows.groupBy(*[F.col(c).cast("double").alias(c) for c in features]).agg(F.min(F.struct("row", "col")).alias("cell_"))
    key = lambda i: F.md5(F.concat_ws(",", F.lit(seed + i), "cell_.row", "cell_.col").cast("binary"))
    picked = [places.withColumns({"start_": F.lit(i), "key_": key(i)}).orderBy("key_").limit(k) for i in range(n_init)]
    found = reduce(DataFrame.union, picked).collect()  # k rows for each start
    return [[[r[c] for c in features] for r in sorted((r for r in found if r.start_ == i), key=lambda r: r.key_)] for i in range(n_init)]


def centre_steps(rows: DataFrame, features: list[str], centres: list[list[list[float]]]) -> tuple[list[list[list[float]]], list[float]]:
    """The next centres of each start, and the cost of those it has: one aggregation for all starts.

    Of each row the nearest centre of every start is found, and sums by start and cluster are all that is shuffled. A
    centre without rows stays where it is.
    """
    distances = lambda cs: F.array(*[squared(features, c) for c in cs])
    each = [F.struct(F.lit(i).alias("start"), F.array_position(d := distances(cs), F.array_min(d)).cast("int").alias("at"), F.array_min(d).alias("cost")) for i, cs in enumerate(centres)]
    sums = rows.select(*features, F.explode(F.array(*each)).alias("p")).groupBy("p.start", "p.at").agg(F.sum("p.cost").alias("cost"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)])
    after, costs = [[list(c) for c in cs] for cs in centres], [0.0] * len(centres)
    for r in sums.collect():  # k rows for each start
        after[r.start][r["at"] - 1] = [r[f"m{i}"] for i in range(len(features))]
        costs[r.start] += r.cost
    return after, costs


def squared(features: list[str], centre: list[float]) -> Column:
    return reduce(lambda a, b: a + b, [(F.col(c) - x) ** 2 for c, x in zip(features, centre, strict=True)])


def kmeans_two(df: DataFrame, features: list[str], k: int = 2, n_init: int = 10, max_iter: int = 300, seed: int = 42) -> DataFrame:
    """Adds ``cluster``: of ``n_init`` starts, the one of the least cost. Rows with a missing feature are left out.

    ``df`` has ``row`` and ``col``. All starts go on together, each until its centres stay or for ``max_iter`` steps.
    Costs that agree to nine digits are equal, and of those the smallest centres count; clusters are numbered by their
    centres in ascending order. So nothing hangs on the order of a sum. Fewer than ``k`` different rows are one cluster.
    """
    rows = written(df.dropna(subset=features), "clustered")  # every step reads it
    centres = first_centres(rows, features, k, n_init, seed)
    if any(len(cs) < k for cs in centres):
        return rows.withColumn("cluster", F.lit(0))
    done: list[tuple[float, list[list[float]]]] = []
    for step in range(max_iter + 1):
        after, costs = centre_steps(rows, features, centres)
        still = [step < max_iter and any(abs(x - y) > 1e-12 * max(1.0, abs(x)) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True)) for a, b in zip(centres, after, strict=True)]
        done += [(float(f"{cost:.8e}"), sorted(cs)) for cost, cs, on in zip(costs, centres, still, strict=True) if not on]
        centres = [cs for cs, on in zip(after, still, strict=True) if on]
        if not centres:
            break
    return assign_clusters(rows, features, min(done)[1])


def assign_clusters(df: DataFrame, features: list[str], centers: list[list[float]]) -> DataFrame:
    """Adds ``cluster``: the nearest of the given centres; of equal ones the first."""
    d = [squared(features, center) for center in centers]
    return df.withColumn("cluster", F.array_position(F.array(*d), F.array_min(F.array(*d))).cast("int") - 1)


def majority_cluster(df: DataFrame, high: int) -> DataFrame:
    """The cluster that holds most rows of the label; of equal ones the lowest."""
    return df.where(F.col("label") == high).groupBy("cluster").count().orderBy(F.desc("count"), "cluster").limit(1).select("cluster")


def flag_low_in_high_cluster(df: DataFrame, high: int, low: int = 0) -> DataFrame:
    """(``row``, ``col``) of low cells in the cluster where most high ones are."""
    return df.where(F.col("label") == low).join(F.broadcast(majority_cluster(df, high)), "cluster", "left_semi").select("row", "col")


def drop_labels(labels: DataFrame, flagged: DataFrame) -> DataFrame:
    mark = flagged.select("row", "col").distinct().withColumn("flag_", F.lit(True))
    return labels.join(mark, ["row", "col"], "left").withColumn("label", F.when(F.col("flag_").isNull(), F.col("label"))).drop("flag_")


def clean_labels(df: DataFrame, features: list[str], cap: int = 200_000, k: int = 2, n_init: int = 10, max_iter: int = 300, seed: int = 42) -> DataFrame:
    """``df`` (row, col, label, features) with the labels of flagged low cells missing; each higher class is tried against class 0."""
    flagged = []
    for high in (1, 2, 3):
        both = standardize(sample_per_class(df.where(F.col("label").isin(0, high)), cap), features)
        flagged.append(flag_low_in_high_cluster(kmeans_two(both, features, k, n_init, max_iter, seed), high))
    return drop_labels(df, reduce(DataFrame.union, flagged))
