"""Resampling: the values of source cells at the cells of another grid, whatever projection and cell size they have."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid, cell_center, from_bng
from ..sources.tables import written

#: Fixed value: radius in metres of the sphere of the vegetation composites' sinusoidal projection.
SPHERE = 6371007.181
#: What a source's coordinates may be: the national grid, WGS84 degrees, or sinusoidal metres.
SYSTEMS = ("bng", "degrees", "sinusoidal")
KERNELS = ("nearest", "bilinear", "triangle", "average")
#: Source values (cells times layers) up to which the source goes to all tasks; above, it is joined by a shuffle.
BROADCAST_VALUES = 2_000_000
#: Layers that one aggregation holds.
LAYERS = 64


def source_places(targets: DataFrame, system: str) -> DataFrame:
    """Sets ``sx_`` and ``sy_``, coordinates in the source's system, of ``easting`` and ``northing``.

    Outside the national grid the result is a table: a filter on it would else be pushed down with all steps of the
    inverse projection written out.
    """
    if system not in SYSTEMS:
        raise ValueError(f"unknown coordinate system: {system}; one of {', '.join(SYSTEMS)}")
    if system == "bng":
        return targets.withColumns({"sx_": F.col("easting"), "sy_": F.col("northing")}).drop("easting", "northing")
    placed = from_bng(targets)
    if system == "degrees":
        x, y = F.col("lon"), F.col("lat")
    else:
        x, y = SPHERE * F.radians("lon") * F.cos(F.radians("lat")), SPHERE * F.radians("lat")
    kept = [F.col(c) for c in targets.columns if c not in ("easting", "northing")]
    return written(placed.select(*kept, x.alias("sx_"), y.alias("sy_")), "places")


def cells_spanned(spark: SparkSession, grid: Grid, source_grid: Grid, system: str) -> tuple[float, float]:
    """How many source cells a cell of ``grid`` spans along x and y, at the middle of the grid."""
    if system == "bng":
        return grid.res / source_grid.res, grid.res / source_grid.res
    left, bottom, right, top = grid.bounds
    x, y, half = (left + right) / 2, (bottom + top) / 2, grid.res / 2
    ends = spark.createDataFrame([(0, x - half, y), (1, x + half, y), (2, x, y - half), (3, x, y + half)], "k int, easting double, northing double")
    at = {r.k: r for r in source_places(ends, system).collect()}  # four rows
    span = lambda a, b: ((at[a].sx_ - at[b].sx_) ** 2 + (at[a].sy_ - at[b].sy_) ** 2) ** 0.5 / source_grid.res
    return span(0, 1), span(2, 3)


def _reach(f: Column, n: int, kernel: str, span: float) -> Column:
    """Array of (``at``, ``w``): the source cells along one axis that count at ``f`` (in cells from the edge), and their weights."""
    pair = lambda i, w: F.struct(i.cast("int").alias("at"), w.alias("w"))
    if kernel == "nearest":
        return F.array(pair(F.floor(f), F.lit(1.0)))
    if kernel == "bilinear" or kernel == "triangle" and span <= 1:
        low = F.floor(f - 0.5)
        return F.array(pair(low, low + 1.5 - f), pair(low + 1, f - 0.5 - low))
    if kernel == "average":
        a, b = f - span / 2, f + span / 2
        every, weight = F.sequence(F.floor(a), F.ceil(b) - 1), lambda i: F.least(i + 1.0, b) - F.greatest(i + 0.0, a)
    else:
        every, weight = F.sequence(F.ceil(f - 0.5 - span), F.floor(f - 0.5 + span)), lambda i: 1 - F.abs(i + 0.5 - f) / span
    return F.transform(F.filter(every, lambda i: i.between(0, n - 1)), lambda i: pair(i, weight(i)))


def neighbours(targets: DataFrame, source_grid: Grid, kernel: str, spans: tuple[float, float]) -> DataFrame:
    """(``row``, ``col``, ``src_row``, ``src_col``, ``w``) of targets (``row``, ``col``, ``sx_``, ``sy_``) whose place is on the source."""
    fx, fy = (F.col("sx_") - source_grid.x0) / source_grid.res, (F.lit(source_grid.y0) - F.col("sy_")) / source_grid.res
    inside = targets.withColumns({"fx_": fx, "fy_": fy}).where(f"fx_ >= 0 AND fx_ < {source_grid.width} AND fy_ >= 0 AND fy_ < {source_grid.height}")
    rows = inside.select("row", "col", "fx_", F.explode(_reach(F.col("fy_"), source_grid.height, kernel, spans[1])).alias("r_"))
    both = rows.select("row", "col", "r_", F.explode(_reach(F.col("fx_"), source_grid.width, kernel, spans[0])).alias("c_"))
    return both.select("row", "col", F.col("r_.at").alias("src_row"), F.col("c_.at").alias("src_col"), (F.col("r_.w") * F.col("c_.w")).alias("w")).where("w > 1e-9")


def resampled(
    source: DataFrame,
    source_grid: Grid,
    targets: DataFrame,
    grid: Grid,
    by: tuple[str, ...] = (),
    value: str = "value",
    system: str = "bng",
    kernel: str = "bilinear",
    layers: list[tuple] | None = None,
) -> DataFrame:
    """(``by``, ``row``, ``col``, ``value``): the source at the cells ``row``, ``col`` of ``targets`` on ``grid``.

    ``system`` is that of the source's coordinates. The kernel is ``nearest``; ``bilinear`` (the four cells around a
    centre); ``triangle``, the same where the source is coarser, with a support that grows with the cell size where it
    is finer; or ``average``, the mean by area of what a target cell covers. How many source cells a target cell spans
    is taken at the middle of the grid. Missing source cells give their weight to the others. Targets whose centre is
    off the source, or without a known source cell, have no row.

    Weights are found once for all layers named by ``by``, which stand side by side in one row for each source cell.
    ``layers`` names them; without it they are read from the source first.
    """
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel: {kernel}; one of {', '.join(KERNELS)}")
    spark = source.sparkSession
    if layers is None:
        layers = [tuple(r) for r in source.select(*by).distinct().collect()] if by else [()]  # seasons and variables, a handful
    spans = (1.0, 1.0) if kernel in ("nearest", "bilinear") else cells_spanned(spark, grid, source_grid, system)
    x, y = cell_center(grid, F.col("row"), F.col("col"))
    places = source_places(targets.select("row", "col").withColumns({"easting": x, "northing": y}), system)
    near = neighbours(places, source_grid, kernel, spans)
    parts = [_weighted(near, source, source_grid, by, value, layers[k : k + LAYERS]) for k in range(0, len(layers), LAYERS)]
    return reduce(DataFrame.union, parts) if parts else _weighted(near, source, source_grid, by, value, [()]).limit(0)


def _weighted(near: DataFrame, source: DataFrame, source_grid: Grid, by: tuple[str, ...], value: str, layers: list[tuple]) -> DataFrame:
    types = {f.name: f.dataType for f in source.schema}
    fixed = lambda layer: {c: F.lit(v).cast(types[c]) for c, v in zip(by, layer or (None,) * len(by), strict=True)}
    mine = lambda layer: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(v) for c, v in fixed(layer).items()], F.lit(True))
    held = source.where(F.col(value).isNotNull()).groupBy(F.col("row").alias("src_row"), F.col("col").alias("src_col"))
    held = held.agg(*[F.avg(F.when(mine(layer), F.col(value))).alias(f"v{i}_") for i, layer in enumerate(layers)])
    if source_grid.height * source_grid.width * len(layers) <= BROADCAST_VALUES:
        held = F.broadcast(held)
    v = [F.col(f"v{i}_") for i in range(len(layers))]
    sums = near.join(held, ["src_row", "src_col"]).groupBy("row", "col").agg(*[(F.sum(F.col("w") * c) / F.sum(F.when(c.isNotNull(), F.col("w")))).alias(f"v{i}_") for i, c in enumerate(v)])
    each = F.array(*[F.struct(*[c.alias(name) for name, c in fixed(layer).items()], c.alias("value_")) for layer, c in zip(layers, v, strict=True)])
    return sums.select("row", "col", F.explode(each).alias("x_")).where("x_.value_ IS NOT NULL").select(*[F.col(f"x_.{c}") for c in by], "row", "col", F.col("x_.value_").alias(value))


def place_tiles(tiles: DataFrame, catalogue: DataFrame, tile: str = "tile") -> tuple[DataFrame, Grid]:
    """Tiles on the lattice of all of them, and that lattice: ``row`` and ``col`` are counted from its north-west corner.

    ``tiles`` has ``tile``, ``row``, ``col`` as the tile's file counts them; ``catalogue`` has, for each tile, the
    corner ``x0``, ``y0``, the cell size ``res``, ``height`` and ``width``, and its other columns (such as an order)
    come along. Tiles may overlap or leave gaps. A corner off the lattice by a part of a cell goes to the nearest line.
    All tiles have one cell size; another one, or a tile that the catalogue names twice, raises. Tiles that the
    catalogue doesn't name have no row.
    """
    ends = catalogue.agg(
        F.min("x0").alias("x0"), F.max("y0").alias("y0"), F.min("res").alias("res"), F.max("res").alias("other"), F.count(tile).alias("n"), F.count_distinct(tile).alias("tiles"),
        F.max(F.col("x0") + F.col("width") * F.col("res")).alias("x1"), F.min(F.col("y0") - F.col("height") * F.col("res")).alias("y1"),
    ).first()
    if not ends.n:
        raise ValueError("the catalogue names no tile")
    if abs(ends.other - ends.res) > 1e-9 * ends.res or ends.tiles < ends.n:
        raise ValueError(f"tiles of cell sizes {ends.res} to {ends.other}, {ends.n - ends.tiles} named twice")
    grid = Grid(ends.x0, ends.y0, ends.res, round((ends.y0 - ends.y1) / ends.res), round((ends.x1 - ends.x0) / ends.res))
    at = catalogue.withColumns({"down_": F.round((F.lit(grid.y0) - F.col("y0")) / grid.res).cast("int"), "over_": F.round((F.col("x0") - grid.x0) / grid.res).cast("int")})
    inside = (F.col("row") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") >= 0) & (F.col("col") < F.col("width"))
    placed = tiles.join(at, tile).where(inside).withColumns({"row": F.col("row") + F.col("down_"), "col": F.col("col") + F.col("over_")})
    return placed.drop("down_", "over_", "x0", "y0", "res", "height", "width"), grid


def crop_window(edges: DataFrame, grid: Grid) -> Grid | None:
    """The part of ``grid`` that the boundary's extent touches, as a grid of its own; None where they don't meet."""
    ends = edges.agg(F.min(F.least("x1", "x2")).alias("l"), F.max(F.greatest("x1", "x2")).alias("r"), F.min(F.least("y1", "y2")).alias("b"), F.max(F.greatest("y1", "y2")).alias("t"))
    line = lambda c, up: (F.ceil if up else F.floor)(c)
    w = ends.select(
        F.greatest(F.lit(0), line((F.lit(grid.y0) - F.col("t")) / grid.res, False)).alias("r0"), F.least(F.lit(grid.height), line((F.lit(grid.y0) - F.col("b")) / grid.res, True)).alias("r1"),
        F.greatest(F.lit(0), line((F.col("l") - grid.x0) / grid.res, False)).alias("c0"), F.least(F.lit(grid.width), line((F.col("r") - grid.x0) / grid.res, True)).alias("c1"), "l",
    ).first()
    if w.l is None or w.r0 >= w.r1 or w.c0 >= w.c1:
        return None
    return Grid(grid.x0 + w.c0 * grid.res, grid.y0 - w.r0 * grid.res, grid.res, w.r1 - w.r0, w.c1 - w.c0)


def on_window(cells: DataFrame, grid: Grid, window: Grid) -> DataFrame:
    """Cells of ``grid`` counted from the corner of ``window``; those outside it go. Other columns stay."""
    down, over = round((grid.y0 - window.y0) / grid.res), round((window.x0 - grid.x0) / grid.res)
    moved = cells.withColumns({"row": F.col("row") - down, "col": F.col("col") - over})
    return moved.where(F.col("row").between(0, window.height - 1) & F.col("col").between(0, window.width - 1))
