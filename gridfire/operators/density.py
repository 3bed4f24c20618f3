"""Incident density: smoothing, kernel density, percentiles and classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import Grid, point_to_cell
from ..sources.tables import written
from .profile import exact_percentiles
from .raster import land_mask

QUANTILES = (0.6, 0.75, 0.9)


def fire_counts(points: DataFrame, grid: Grid, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Points by cell, or the sum of their ``weight``; a missing weight counts as none."""
    return point_to_cell(points, grid).groupBy(*by, "row", "col").agg(how_many(weight).alias("n"))


def how_many(weight: str | None) -> Column:
    return F.count(F.lit(1)) if weight is None else F.coalesce(F.sum(weight), F.lit(0))


def kernel(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """Normalised Gaussian weights by offset."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [(k - radius, w / sum(raw)) for k, w in enumerate(raw)]


def _scatter(df: DataFrame, axis: str, n: int, weights: list[tuple[int, float]], keys: list[str]) -> DataFrame:
    """Each value goes to its neighbours along an axis. Beyond the border the line is mirrored: the mirror images of an index within reach give too."""
    reach = weights[-1][0]
    turns = range(-(reach // (2 * n)) - 1, reach // (2 * n) + 2)
    j = F.col(axis)
    images = F.array(*[x for m in turns for x in (j + 2 * n * m, F.lit(2 * n * m - 1) - j)])
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in weights])
    rest = [c for c in keys if c != axis]
    near = df.select(*rest, "v", F.explode(F.filter(images, lambda i: i.between(-reach, n - 1 + reach))).alias("i")).select(*rest, "v", "i", F.explode(pairs).alias("p"))
    moved = near.select(*rest, (F.col("i") + F.col("p.k")).cast("int").alias(axis), (F.col("v") * F.col("p.w")).alias("v"))
    return moved.where(F.col(axis).between(0, n - 1)).groupBy(*keys).agg(F.sum("v").alias("v"))


def gaussian_smooth(counts: DataFrame, grid: Grid, sigma: float = 3.0, truncate: float = 4.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Separable Gaussian of sparse counts, mirrored at the border: ``density`` of the cells within reach of one."""
    weights, keys = kernel(sigma, truncate), [*by, "row", "col"]
    rows = counts.select(*keys, F.col("n").cast("double").alias("v"))
    both = _scatter(_scatter(rows, "row", grid.height, weights, keys), "col", grid.width, weights, keys)
    return both.withColumnRenamed("v", "density")


#: Rows and columns of a block of cells, and pairs of a cell and a point that are looked at together, in kernel densities.
BLOCK, PAIRS = 512, 1 << 17


def add_terms(out: np.ndarray, ys: np.ndarray, xs: np.ndarray, north: np.ndarray, east: np.ndarray, n: np.ndarray, bandwidth: float, size: float) -> None:
    """Adds the Gaussian terms of points within ``size`` to the sums ``out`` of cells with centres at ``ys`` by ``xs``.

    A term is a product of one factor by row and one by column. Rows that all the points reach whole are a product of
    matrices; in the others the distance of each pair decides.
    """
    step = max(1, PAIRS // max(len(xs), len(ys)))
    for k in range(0, len(n), step):
        p, q, w = north[k : k + step], east[k : k + step], n[k : k + step]
        dx2, dy2 = (xs - q[:, None]) ** 2, (ys[:, None] - p) ** 2
        a, b = np.exp(-dy2 / (2 * bandwidth**2)), w[:, None] * np.exp(-dx2 / (2 * bandwidth**2))
        whole = dy2.max(1) + dx2.max() <= size**2
        out[whole] += a[whole] @ b
        part = np.flatnonzero(~whole & (dy2.min(1) + dx2.min() <= size**2))
        some = max(1, PAIRS // b.size)
        for i in range(0, len(part), some):
            rows = part[i : i + some]
            near = np.where(dy2[rows][:, :, None] + dx2 <= size**2, b, 0.0)
            out[rows] += np.matmul(a[rows][:, None, :], near)[:, 0, :]


def kernel_sums(places: DataFrame, land: DataFrame, grid: Grid, bandwidth: float, size: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(``row``, ``col``, ``s``) for each group: sums of ``n`` times the Gaussian of the places within ``size``, for cells in reach.

    The land's cells are cut into blocks. A place goes to the blocks that it reaches, and range partitions share out the
    places of a block however many there are. A task holds one block at a time: the terms of its places, a tile of them
    after the other, are added up in numpy, and what is shuffled on are the sums of cells, not pairs.
    """
    x0, y0, res, length = grid.x0, grid.y0, grid.res, grid.res * BLOCK
    ends = [f(axis).alias(name) for axis, names in (("row", ("r0_", "r1_")), ("col", ("c0_", "c1_"))) for f, name in zip((F.min, F.max), names, strict=True)]
    blocks = land.groupBy(F.floor(F.col("row") / BLOCK).alias("rb_"), F.floor(F.col("col") / BLOCK).alias("cb_")).agg(*ends)
    reached = lambda at: F.explode(F.sequence(F.floor((at - size - res) / length), F.floor((at + size + res) / length)))
    tile = max(size / 16, res)
    known = places.dropna(subset=list(by)) if by else places
    known = known.where((F.abs("northing") < math.inf) & (F.abs("easting") < math.inf)).withColumns({"ty_": F.floor(F.col("northing") / tile), "tx_": F.floor(F.col("easting") / tile)})
    spread = known.withColumn("rb_", reached(F.lit(y0) - F.col("northing"))).withColumn("cb_", reached(F.col("easting") - x0)).join(F.broadcast(blocks), ["rb_", "cb_"])  # a row for each block
    own, runs = [*by, "rb_", "cb_"], [*by, "rb_", "cb_", "ty_", "tx_"]
    dealt = spread.repartitionByRange(*runs, "northing", "easting").sortWithinPartitions(*runs)
    schema = T.StructType([places.schema[c] for c in by]).add("row", "integer").add("col", "integer").add("s", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, sums, corner = None, None, None, (0, 0)

        def done() -> pa.RecordBatch:
            r, c = np.nonzero(sums)
            groups = [first.column(x).take(pa.array(np.zeros(len(r), np.int64))) for x in by]
            return pa.RecordBatch.from_arrays([*groups, pa.array((r + corner[0]).astype(np.int32)), pa.array((c + corner[1]).astype(np.int32)), pa.array(sums[r, c])], names=schema.names)

        for batch in batches:
            new = np.zeros(batch.num_rows, bool)
            new[:1] = True
            for x in runs:
                v = batch.column(x)
                new[1:] |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
            north, east, n = (batch.column(x).to_numpy() for x in ("northing", "easting", "n"))
            starts = np.flatnonzero(new)
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                key = [batch.column(x)[a].as_py() for x in own]
                if key != held:
                    if held is not None:
                        yield done()
                    r0, r1, c0, c1 = (batch.column(x)[a].as_py() for x in ("r0_", "r1_", "c0_", "c1_"))
                    held, first, sums, corner = key, batch.slice(a, 1), np.zeros((r1 - r0 + 1, c1 - c0 + 1)), (r0, c0)
                    ys, xs = y0 - (np.arange(r0, r1 + 1) + 0.5) * res, x0 + (np.arange(c0, c1 + 1) + 0.5) * res
                p, q = north[a:b], east[a:b]
                rows = np.flatnonzero((ys > p.min() - size - res) & (ys < p.max() + size + res))
                cols = np.flatnonzero((xs > q.min() - size - res) & (xs < q.max() + size + res))
                if len(rows) and len(cols):
                    rows, cols = slice(rows[0], rows[-1] + 1), slice(cols[0], cols[-1] + 1)
                    add_terms(sums[rows, cols], ys[rows], xs[cols], p, q, n[a:b], bandwidth, size)
        if held is not None:
            yield done()

    doubles = [F.col(x).cast("double").alias(x) for x in ("northing", "easting", "n")]
    terms = dealt.select(*runs, "r0_", "r1_", "c0_", "c1_", *doubles).mapInArrow(run, schema)
    return terms.groupBy(*by, "row", "col").agg(F.sum("s").alias("s"))


def kde_density(points: DataFrame, land: DataFrame, grid: Grid, bandwidth: float = 500.0, cutoff: float = 8.0, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Gaussian kernel density at every land cell, normalised by all points; terms beyond ``cutoff`` bandwidths are below rounding.

    Points at one place are counted first, so a hot spot is one row. With ``weight``, each point counts as often as it says.
    Cells with no point within reach have 0; a group without points has no row, and one whose weights sum to nothing
    has missing densities.
    """
    places = points.groupBy(*by, "easting", "northing").agg(how_many(weight).alias("n"))
    totals = points.groupBy(*by).agg(how_many(weight).alias("total"), F.count(F.lit(1)).alias("points_")).where("points_ > 0")
    totals = totals.dropna(subset=list(by)) if by else totals
    sums = kernel_sums(places, land, grid, bandwidth, cutoff * bandwidth, by)
    every = land.select("row", "col").join(F.broadcast(totals))  # one row for each group
    joined = every.join(sums, [*by, "row", "col"], "left")
    density = F.try_divide(F.coalesce("s", F.lit(0.0)), F.col("total") * 2 * math.pi * bandwidth**2)
    return joined.select(*by, "row", "col", density.alias("density"))


def compute_density(points: DataFrame, land: DataFrame, grid: Grid, method: str = "convolution", by: tuple[str, ...] = (), weight: str | None = None, **options) -> DataFrame:
    if method == "convolution":
        return land_mask(gaussian_smooth(fire_counts(points, grid, by, weight), grid, by=by, **options), land)
    if method == "kde":
        return kde_density(points, land, grid, by=by, weight=weight, **options)
    raise ValueError(f"unknown density method: {method}")


def density_percentiles(density: DataFrame, quantiles: tuple[float, ...] = QUANTILES, threshold: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Percentiles by linear interpolation of the densities above the threshold, as ``p60`` and so on."""
    return exact_percentiles(density.where(F.col("density") > threshold), "density", {f"p{round(100 * q)}": q for q in quantiles}, by)


def classify_density(density: DataFrame, threshold: float = 0.0, by: tuple[str, ...] = (), kept: bool = False) -> DataFrame:
    """Adds ``label``: 0 below the 60th percentile, 1 from it, 2 from the 75th, 3 from the 90th; missing at or under the threshold.

    The densities are read three times, so they are written first, unless they are ``kept`` in a table already.
    """
    density = density if kept else written(density, "density")
    cuts = density_percentiles(density, threshold=threshold, by=by)
    joined = density.join(F.broadcast(cuts), list(by), "left") if by else density.join(F.broadcast(cuts))  # a row for each season
    d = F.col("density")
    label = F.when(d <= threshold, None).when(d >= F.col("p90"), 3).when(d >= F.col("p75"), 2).when(d >= F.col("p60"), 1).when(d > threshold, 0)
    return joined.withColumn("label", label.cast("int")).drop("p60", "p75", "p90")


def class_counts(labels: DataFrame, land: DataFrame, grid: Grid) -> DataFrame:
    """(``class``, ``n``): labels 0 to 3 (also if none), ``unlabelled`` land cells, ``outside`` cells."""
    joined = land.select("row", "col").join(labels.where("label IS NOT NULL").select("row", "col", "label"), ["row", "col"], "left")
    one = joined.agg(*[F.count_if(F.col("label") == k).alias(str(k)) for k in range(4)], F.count_if(F.col("label").isNull()).alias("unlabelled"), (F.lit(grid.height * grid.width) - F.count(F.lit(1))).alias("outside"))
    return one.unpivot([], ["0", "1", "2", "3", "unlabelled", "outside"], "class", "n")


def density_histogram(density: DataFrame, bins: int = 80, threshold: float = 0.0) -> DataFrame:
    """(``bin``, ``n``) of equal-width bins over the positive densities; the last one is closed."""
    kept = density.where(F.col("density") > threshold)
    ends = kept.agg(F.min("density").alias("a_"), F.max("density").alias("b_"))
    at: Column = F.when(F.col("a_") == F.col("b_"), 0).otherwise(F.least(F.floor(F.try_divide(F.col("density") - F.col("a_"), (F.col("b_") - F.col("a_")) / bins)), F.lit(bins - 1)))
    return kept.join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
