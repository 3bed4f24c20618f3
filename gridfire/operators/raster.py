"""Cell tables: alignment, mosaics, terrain, distance, stacking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid
from .resample import resampled


def land_mask(cells: DataFrame, land: DataFrame) -> DataFrame:
    return cells.join(land.select("row", "col"), ["row", "col"], "left_semi")


def grid_bounds(cells: DataFrame, grid: Grid) -> DataFrame:
    """The extent of the cells, edge to edge."""
    a = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    x, y = lambda c: F.lit(grid.x0) + c * grid.res, lambda r: F.lit(grid.y0) - r * grid.res
    return a.select(x(F.col("c0")).alias("left"), y(F.col("r1") + 1).alias("bottom"), x(F.col("c1") + 1).alias("right"), y(F.col("r0")).alias("top"))


def orient_north_up(samples: DataFrame, res: float, anchor: str = "reference") -> DataFrame:
    """(``row``, ``col``) of samples at ``northing``, ``easting``, from the north-west one.

    ``x0`` and ``y0`` are the grid's corner: the least easting and largest northing themselves (``reference``), or half
    a cell out (``center``).
    """
    ends = samples.agg(F.min("easting").alias("e0_"), F.max("northing").alias("n0_"))
    half = 0.0 if anchor == "reference" else res / 2
    placed = samples.join(F.broadcast(ends))  # one row
    return placed.withColumns({
        "row": F.round((F.col("n0_") - F.col("northing")) / res).cast("int"), "col": F.round((F.col("easting") - F.col("e0_")) / res).cast("int"),
        "x0": F.col("e0_") - half, "y0": F.col("n0_") + half,
    }).drop("e0_", "n0_")


def align_to_reference(source: DataFrame, source_grid: Grid, land: DataFrame, grid: Grid, by: tuple[str, ...] = (), value: str = "value", system: str = "bng", kernel: str = "bilinear", layers: list[tuple] | None = None) -> DataFrame:
    """The source at the centres of ``land``: see ``resampled`` for coordinate systems, kernels and missing cells.

    The neighbours of a cell are found once for all layers named by ``by``.
    """
    return resampled(source, source_grid, land, grid, by, value, system, kernel, layers)


def reproject_resample(source: DataFrame, source_grid: Grid, grid: Grid, system: str = "degrees", kernel: str = "bilinear", value: str = "value") -> DataFrame:
    """The source, in a coordinate system of its own, on every cell of a national grid."""
    return resampled(source, source_grid, grid.cells(source.sparkSession), grid, (), value, system, kernel)


def mosaic_tiles(tiles: DataFrame, order: str = "tile_order", value: str = "value") -> DataFrame:
    """The first tile with data wins."""
    return tiles.where(F.col(value).isNotNull()).groupBy("row", "col").agg(F.min_by(value, order).alias(value))


def terrain(cells: DataFrame, grid: Grid, value: str = "elevation") -> DataFrame:
    """Adds ``dx``, ``dy`` (along columns, down rows), ``slope`` and ``aspect`` in degrees.

    Central differences, one-sided at the grid's edge, over windows of one row or column of the dense grid; a missing
    neighbour or centre gives missing.
    """
    dense = grid.cells(cells.sparkSession).join(cells.select("row", "col", value), ["row", "col"], "left")

    def slope_along(axis: str, across: str, n: int):
        w = Window.partitionBy(across).orderBy(axis)
        before, here, after = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
        at = F.col(axis)
        inner = (after - before) / (2 * grid.res)
        return F.when(F.lit(n) < 2, None).when(at == 0, (after - here) / grid.res).when(at == n - 1, (here - before) / grid.res).otherwise(inner)

    out = dense.withColumn("dx", slope_along("col", "row", grid.width)).withColumn("dy", slope_along("row", "col", grid.height))
    known = F.col(value).isNotNull()
    slope = F.degrees(F.atan(F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)))
    aspect = F.pmod(F.degrees(F.atan2(-F.col("dy"), F.col("dx"))) + 360, F.lit(360.0))
    return out.withColumns({"slope": F.when(known, slope), "aspect": F.when(known, aspect)})


def nearest(g: np.ndarray) -> np.ndarray:
    """min over k of (i - k)^2 + g[k] for every i of each line (row of ``g``, whole numbers).

    The best k never falls as i grows, so those of every other i bound the ones between. Each halving is one pass over
    all lines: about ``width`` sums a line and level.
    """
    lines, width = g.shape
    best = np.zeros((lines, width), np.int64)
    out = np.zeros((lines, width), np.int64)
    shift = max(1, (width - 1).bit_length())
    step = 1 << shift
    while step >= 1:
        i = np.arange(step - 1, width, 2 * step)
        if len(i):
            low = np.where(i - step >= 0, best[:, np.maximum(i - step, 0)], 0).ravel()
            high = np.where(i + step < width, best[:, np.minimum(i + step, width - 1)], width - 1).ravel()
            n = high - low + 1
            starts = np.cumsum(n) - n
            k = np.arange(n.sum()) + np.repeat(low - starts, n)
            at, line = np.repeat(np.tile(i, lines), n), np.repeat(np.repeat(np.arange(lines), len(i)), n)
            least = np.minimum.reduceat(((at - k) ** 2 + g[line, k]) << shift | k, starts).reshape(lines, len(i))
            best[:, i], out[:, i] = least & ((1 << shift) - 1), least >> shift
        step //= 2
    return out


#: A squared distance that no grid has.
FAR = 1 << 42
#: Cells of a band of rows (64 rows at least), and of a partition, in distances.
BAND_CELLS, PART_CELLS = 1 << 14, 1 << 17


def distance_to_features(presence: DataFrame, grid: Grid, land: DataFrame | None = None, layers: list[str] | None = None) -> DataFrame:
    """(``layer``, ``row``, ``col``, ``km``): exact distance from each cell to the nearest presence cell of the layer.

    Along columns, neighbouring presence cells share the rows between them out at the middle; so each stands for one run
    of rows, known from its two neighbours. Runs are cut into bands of rows, which are what is shuffled; their cells are
    listed where the band is, and lines of a band go through numpy, some at a time. So the work is that of the cells,
    and no partition grows with the layer. Bands without land are left out, land is masked last. A layer without presence
    has null distances. ``layers`` names them; without it, those present.
    """
    spark = presence.sparkSession
    if (grid.width - 1).bit_length() + FAR.bit_length() > 63 or grid.height >= 1 << 20:
        raise OverflowError("distances are kept in 64 bits: grids of up to 2 ** 20 rows and columns")
    marks = presence.where(F.col("row").between(0, grid.height - 1)).select("layer", "col", F.col("row").alias("here")).distinct()
    names = spark.createDataFrame([(x,) for x in layers], "layer string") if layers else presence.select("layer").distinct()
    lines = names.select("layer", F.explode(F.sequence(F.lit(0), F.lit(grid.width - 1))).alias("col"))
    w = Window.partitionBy("layer", "col").orderBy("here")
    middle = lambda a, b: F.floor((a + b) / 2).cast("int")
    first = F.coalesce(middle(F.lag("here").over(w), F.col("here")) + 1, F.lit(0))
    last = F.coalesce(middle(F.col("here"), F.lead("here").over(w)), F.lit(grid.height - 1))
    runs = lines.join(marks, ["layer", "col"], "left").select("layer", "col", "here", first.alias("a_"), last.alias("b_"))
    high = max(64, BAND_CELLS // max(1, grid.width))
    bands = runs.withColumn("band_", F.explode(F.sequence(F.floor(F.col("a_") / high), F.floor(F.col("b_") / high))))
    if land is not None:
        held = land.select(F.floor(F.col("row") / high).alias("band_")).distinct()
        bands = bands.join(F.broadcast(held), "band_", "left_semi")  # a row for each band, of 64 rows of cells at least
    n = -(-grid.height * grid.width * len(layers or [""]) // PART_CELLS)
    placed = bands.repartition(min(max(n, 1), 10_000), "layer", "band_")
    own = F.sequence(F.greatest("a_", F.col("band_") * high).cast("int"), F.least("b_", (F.col("band_") + 1) * high - 1).cast("int"))
    near = placed.select("layer", F.explode(own).alias("row"), "col", "here").select("layer", "row", "col", F.abs(F.col("row") - F.col("here")).alias("g"))
    width, res = grid.width, grid.res

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # a partition has whole lines, one after the other; a batch may end within one

        def lines_of(table: pa.Table) -> pa.RecordBatch:
            g = table.column("g").to_numpy()
            g = np.where(np.isnan(g), FAR, g * g).astype(np.int64) if g.dtype.kind == "f" else g.astype(np.int64) ** 2
            d = nearest(g.reshape(-1, width)).ravel()
            km = pa.array(np.sqrt(d) * res / 1000, mask=d >= FAR)
            return pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("layer", "row", "col")), km], names=["layer", "row", "col", "km"])

        for batch in batches:
            held.append(batch)
            n = sum(b.num_rows for b in held)
            if n >= max(width, 1 << 15):
                table = pa.Table.from_batches(held)
                yield lines_of(table.slice(0, n - n % width))
                held = table.slice(n - n % width).to_batches()
        if sum(b.num_rows for b in held):
            yield lines_of(pa.Table.from_batches(held))

    sorted_ = near.sortWithinPartitions("layer", "row", "col")  # a band's lines are whole
    out = sorted_.mapInArrow(along, "layer string, row int, col int, km double")
    return land_mask(out, land) if land is not None else out


def stack_layers(layers: DataFrame, land: DataFrame, names: list[str]) -> DataFrame:
    """One row per land cell, a float column for each name; ``layers`` is (layer, row, col, value). One pivot, not a join a layer."""
    wide = layers.where(F.col("layer").isin(names)).groupBy("row", "col").pivot("layer", names).agg(F.first("value", True))
    return land.select("row", "col").join(wide, ["row", "col"], "left").select("row", "col", *[F.col(n).cast("float") for n in names])


def layers_to_arrays(layers: DataFrame, land: DataFrame, names: list[str]) -> DataFrame:
    """Named layers side by side for the land cells that have a value in each of them."""
    return stack_layers(layers, land, names).dropna(subset=names)
