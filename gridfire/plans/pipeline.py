"""Composite jobs: from source tables to one row per land cell and season. Each handles all seasons at once.

What several layers need (training incidents, land, means, densities, distances) is written to the shared folder once
and read from there, so that no plan holds it twice.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import Grid, reprojected_grid
from ..operators import cleaning as C
from ..operators import density as D
from ..operators import incidents as I
from ..operators import profile as P
from ..operators import raster as R
from ..operators import resample as Z
from ..operators import series as S
from ..operators import vector as V
from ..sources.tables import observed, scratch_tables, written


@dataclass(frozen=True)
class Config:
    """Defaults of the jobs. Training years only reach features and labels, but for vegetation that isn't seasonal."""

    seasons: list[str] = field(default_factory=lambda: ["SPRING", "SUMMER", "FALL"])
    splits: dict[str, tuple[int, int]] = field(default_factory=lambda: {"train": (2009, 2020), "val": (2020, 2022), "test": (2022, 9999)})
    variables: list[str] = field(default_factory=lambda: ["tas", "tasmax", "tasmin", "rainfall", "sfcWind", "hurs"])
    method: str = "convolution"
    method_options: dict = field(default_factory=dict)
    #: Vegetation by season, or one layer for all.
    seasonal_ndvi: bool = True
    #: Keep the cells inside the boundary only.
    clip: bool = True
    #: Take the label from low cells that cluster with high ones.
    clean: bool = False
    #: Densities are rounded to so many digits before classes are cut, so that no class hangs on the order of a sum.
    density_digits: int | None = None
    #: Fewest training incidents of a season.
    least_incidents: int = 5
    #: Distance to training incidents as a feature; without it, nothing of the label's source is in the features.
    d_fires: bool = True
    #: Column of the incidents that says how many each counts for in the density; without it, one.
    weight: str | None = None


@dataclass(frozen=True)
class Sources:
    """Input tables of the jobs, and the grids they lie on. ``climate`` has (row, col), or (easting, northing) of samples
    at the cell size of ``source_grid``. Vegetation may be in degrees or sinusoidal metres, on ``ndvi_grid``."""

    cells: DataFrame
    grid: Grid
    boundary: DataFrame
    incidents: DataFrame
    roads: DataFrame
    rivers: DataFrame
    activity: DataFrame
    climate: DataFrame
    ndvi: DataFrame
    source_grid: Grid
    ndvi_grid: Grid | None = None
    ndvi_system: str = "bng"


def dem_from_tiles(tiles: DataFrame, tile_grid: Grid | None = None, res: float = 30.0, catalogue: DataFrame | None = None, kernel: str = "bilinear") -> tuple[DataFrame, Grid]:
    """Elevation on a national grid of cell size ``res``, and that grid, from tiles on grids of degrees.

    Tiles (``tile_order``, row, col, value) share one grid, or each has its own, as ``place_tiles`` has it (``tile``,
    row, col, value and a ``catalogue`` of corners and orders).
    """
    spark = tiles.sparkSession
    if catalogue is not None:
        tiles, tile_grid = Z.place_tiles(tiles, catalogue)
    grid = reprojected_grid(spark, tile_grid, res)
    return R.reproject_resample(R.mosaic_tiles(tiles), tile_grid, grid, kernel=kernel).withColumnRenamed("value", "elevation"), grid


def land_of(s: Sources, c: Config | None = None) -> DataFrame:
    """Cells with an elevation, inside the boundary."""
    land = s.cells.where("elevation IS NOT NULL").select("row", "col")
    return V.clip_cells_to_boundary(land, s.grid, s.boundary) if c is None or c.clip else land


def melt(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select("row", "col", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["row", "col"], names, "layer", "value").select("layer", "row", "col", "value")


def topography(s: Sources, land: DataFrame) -> DataFrame:
    """(row, col, elevation, slope, aspect); slope and aspect come from cells before any clipping."""
    return R.land_mask(R.terrain(s.cells, s.grid), land).select("row", "col", "elevation", "slope", "aspect")


def topography_features(s: Sources, c: Config | None = None) -> DataFrame:
    """Elevation, slope and aspect as layers."""
    return melt(topography(s, land_of(s, c)), ["elevation", "slope", "aspect"])


NEAR = ["d_roads", "d_rivers", "d_activity"]


def presence(s: Sources) -> DataFrame:
    """(layer, row, col) of roads, rivers and human activity."""
    lines = lambda df, name: V.rasterize_lines(df, s.grid).select(F.lit(name).alias("layer"), "row", "col")
    activity = V.rasterize_polygons(s.activity, s.grid, "feature_id").select(F.lit("d_activity").alias("layer"), "row", "col")
    return lines(s.roads, "d_roads").union(lines(s.rivers, "d_rivers")).union(activity)


def proximity_features(s: Sources, c: Config | None = None) -> DataFrame:
    """Distances to roads, rivers and human activity, in one pass for all."""
    far = R.distance_to_features(presence(s), s.grid, land_of(s, c), NEAR)
    return far.select("layer", "row", "col", F.col("km").alias("value"))


def static_features(s: Sources, c: Config | None = None) -> DataFrame:
    out = topography_features(s, c).union(proximity_features(s, c))
    return out if c is None or c.seasonal_ndvi else out.union(static_ndvi(s, land_of(s, c)))


def static_ndvi(s: Sources, land: DataFrame) -> DataFrame:
    """Vegetation of all files and years."""
    mean = S.mean_ndvi(S.select_files_by_date(s.ndvi))
    aligned = R.align_to_reference(mean, s.ndvi_grid or s.source_grid, land, s.grid, system=s.ndvi_system)
    return aligned.select(F.lit("ndvi").alias("layer"), "row", "col", "value")


def climate_means(s: Sources, c: Config) -> tuple[DataFrame, Grid]:
    """(season, layer, row, col, value) as a table, and its grid, north up; each variable needs some climate in each season."""
    climate, grid = s.climate, s.source_grid
    if "northing" in climate.columns:
        ends = {"r": F.max("row"), "c": F.max("col"), "x": F.first("x0"), "y": F.first("y0")}
        climate, e = observed(R.orient_north_up(climate.drop("row", "col"), grid.res), "climate", ends)
        P.require_counts({"the climate table": 0 if e["r"] is None else 1}, 1, "climate")
        grid = Grid(e["x"], e["y"], grid.res, e["r"] + 1, e["c"] + 1)
    mean = S.seasonal_climate_mean(climate.where(F.col("var").isin(c.variables)), c.splits["train"], c.seasons)
    wanted = [f"{v} {season}" for v in c.variables for season in c.seasons]
    mean = P.written_with_each(mean, "means", F.concat_ws(" ", "var", "season"), wanted, 1, "climate of the training years")
    return mean.withColumnRenamed("var", "layer"), grid


def ndvi_means(s: Sources, c: Config) -> DataFrame:
    """(season, layer, row, col, value) as a table; each season needs valid vegetation."""
    mean = S.mean_ndvi(I.training_window(S.dated(s.ndvi), c.splits["train"], c.seasons), ("season", "row", "col"))
    mean = P.written_with_each(mean, "means", F.col("season"), c.seasons, 1, "cells with valid vegetation in the training years", F.col("value").isNotNull())
    return mean.withColumn("layer", F.lit("ndvi"))


def climate_features(s: Sources, c: Config, land: DataFrame | None = None, means: tuple[DataFrame, Grid] | None = None) -> DataFrame:
    """(season, layer, row, col, value): seasonal means on the land cells."""
    mean, grid = means or climate_means(s, c)
    layers = [(season, v) for season in c.seasons for v in c.variables]
    return R.align_to_reference(mean, grid, land if land is not None else land_of(s, c), s.grid, ("season", "layer"), layers=layers)


def seasonal_ndvi(s: Sources, c: Config, land: DataFrame, means: DataFrame | None = None) -> DataFrame:
    mean = ndvi_means(s, c) if means is None else means
    layers = [(season, "ndvi") for season in c.seasons]
    return R.align_to_reference(mean, s.ndvi_grid or s.source_grid, land, s.grid, ("season", "layer"), system=s.ndvi_system, layers=layers)


def seasonal_features(s: Sources, c: Config, land: DataFrame | None = None, climate: tuple[DataFrame, Grid] | None = None, ndvi: DataFrame | None = None) -> DataFrame:
    """(``season``, layer, row, col, value) of climate, and of vegetation where it is seasonal."""
    land = land_of(s, c) if land is None else land
    out = climate_features(s, c, land, climate)
    return out.unionByName(seasonal_ndvi(s, c, land, ndvi)) if c.seasonal_ndvi else out


def training_incidents(s: Sources, c: Config) -> DataFrame:
    """Training incidents of the seasons inside the boundary, as a table; each season needs ``least_incidents``."""
    inside = I.incident_splits(s.incidents, s.boundary, c.splits)
    train = inside.where((F.col("split") == "train") & F.col("season").isin(c.seasons))
    return P.written_with_each(train, "incidents", F.col("season"), c.seasons, c.least_incidents, "training incidents")


def seasonal_density(s: Sources, c: Config, train: DataFrame, land: DataFrame) -> DataFrame:
    """(season, row, col, ``density``) as a table; each season needs a cell with a positive one."""
    density = D.compute_density(train, land, s.grid, c.method, ("season",), weight=c.weight, **c.method_options)
    if c.density_digits is not None:
        density = density.withColumn("density", F.round("density", c.density_digits))
    return P.written_with_each(density, "density", F.col("season"), c.seasons, 1, "cells with a positive density", F.col("density") > threshold_of(c))


def threshold_of(c: Config) -> float:
    """Densities up to it have no label."""
    return 0.0 if c.method == "convolution" else 1e-12


def seasonal_labels(s: Sources, c: Config, train: DataFrame | None = None, land: DataFrame | None = None, density: DataFrame | None = None) -> DataFrame:
    """(season, row, col, ``density``, ``label``) from training incidents."""
    if density is None:
        density = seasonal_density(s, c, training_incidents(s, c) if train is None else train, land_of(s, c) if land is None else land)
    return D.classify_density(density, threshold_of(c), ("season",), kept=True)


def fire_presence(train: DataFrame, s: Sources) -> DataFrame:
    """(layer, row, col): one layer for each season."""
    return V.rasterize_points(train, s.grid, ("season",)).select(F.concat(F.lit("d_fires "), "season").alias("layer"), "row", "col")


def together(*jobs: Callable) -> list:
    """The results of independent jobs, whose stages share the cluster; the first error is raised when all have ended."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def assemble_dataset(s: Sources, c: Config) -> DataFrame:
    """One row per season and land cell: elevation, slope, aspect, distances, climate, ndvi, d_fires, label as floats.

    Tables that don't need each other are made at the same time, and what their guards count is counted by the jobs that
    write them. Layers of all seasons are pivoted once by cell, seasonal ones by season and cell; both meet the land
    cells in a join.
    """
    spark = s.cells.sparkSession
    (land, n), train, climate, ndvi = together(
        lambda: observed(land_of(s, c), "land", {"n": F.count(F.lit(1))}), lambda: training_incidents(s, c), lambda: climate_means(s, c), lambda: ndvi_means(s, c) if c.seasonal_ndvi else None
    )
    P.require_counts({"the grid": n["n"]}, 1, "reference cells")
    fires = [f"d_fires {x}" for x in c.seasons] if c.d_fires else []
    marks = presence(s).union(fire_presence(train, s)) if c.d_fires else presence(s)
    far, density = together(lambda: written(R.distance_to_features(marks, s.grid, land, [*NEAR, *fires]), "distances"), lambda: seasonal_density(s, c, train, land))
    value = F.col("km").alias("value")
    static = far.where(F.col("layer").isin(NEAR)).select("layer", "row", "col", value)
    if not c.seasonal_ndvi:
        static = static.union(static_ndvi(s, land))
    names = [*NEAR, *([] if c.seasonal_ndvi else ["ndvi"])]
    static = static.groupBy("row", "col").pivot("layer", names).agg(F.first("value", True))
    labels = seasonal_labels(s, c, density=density).select("season", F.lit("label").alias("layer"), "row", "col", F.col("label").cast("double").alias("value"))
    layers = seasonal_features(s, c, land, climate, ndvi).unionByName(labels)
    if fires:
        near = far.where(F.col("layer").isin(fires)).select(F.substring_index("layer", " ", -1).alias("season"), F.lit("d_fires").alias("layer"), "row", "col", value)
        layers = layers.unionByName(near)
    later = [*c.variables, *(["ndvi"] if c.seasonal_ndvi else []), *(["d_fires"] if fires else []), "label"]
    wide = layers.groupBy("season", "row", "col").pivot("layer", later).agg(F.first("value", True))
    seasons = spark.createDataFrame([(x,) for x in c.seasons], "season string")
    cells = land.join(topography(s, land), ["row", "col"], "left").join(static, ["row", "col"], "left").join(F.broadcast(seasons))  # a handful of rows
    out = cells.join(wide, ["season", "row", "col"], "left")
    columns = ["elevation", "slope", "aspect", *names, *later]
    out = out.select("season", "row", "col", *[F.col(n).cast("float") for n in columns])
    return clean_seasons(out, c, columns[:-1]) if c.clean else out


def clean_seasons(dataset: DataFrame, c: Config, features: list[str]) -> DataFrame:
    """The dataset with labels cleaned season by season; cells with a missing feature keep theirs."""
    held = written(dataset, "dataset")
    parts = [C.clean_labels(held.where(F.col("season") == x), features) for x in c.seasons]
    return reduce(DataFrame.unionByName, parts).select(*dataset.columns)


def full_pipeline(s: Sources, c: Config, path: str | None = None) -> DataFrame:
    """The whole dataset. With a path it is written there, with a folder for each season, and the tables on the way are
    deleted; classes that no cell of a season got are warned of.
    """
    if not path:
        return assemble_dataset(s, c)
    spark = s.cells.sparkSession
    with scratch_tables(spark):
        out = assemble_dataset(s, c)
        classes = [f"{season} {k}" for season in c.seasons for k in range(4)]
        told, empty = P.report_empty(out.withColumn("class_", F.concat_ws(" ", "season", F.col("label").cast("int"))), "class_", classes, "labels")
        told.drop("class_").write.mode("overwrite").partitionBy("season").parquet(path)
        empty()
    return spark.read.parquet(path).select(*out.columns)


def season_profile(incidents: DataFrame, years: list[int]) -> DataFrame:
    """(``measure``, ``season``, ``year``, ``value``): the share of each season, and by year its count and percentage of the year."""
    share = I.season_share(incidents).select(F.lit("share").alias("measure"), "season", F.lit(None).cast("int").alias("year"), F.col("share").alias("value"))
    counts = I.season_year_counts(incidents, years).unpivot("season", [f"y{y}" for y in years], "year", "n")
    counts = counts.select(F.lit("count").alias("measure"), "season", F.substring("year", 2, 9).cast("int").alias("year"), F.col("n").cast("double").alias("value"))
    pct = I.season_year_pct(incidents).where(F.col("year").isin(years)).select(F.lit("percent").alias("measure"), "season", "year", F.col("pct").alias("value"))
    return share.union(counts).union(pct)


def dataset_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """By season and feature: what ``describe_features`` has, and ``lacking_pct``, the share without it of the rows that lack anything."""
    described = P.describe_features(df, features, ("season",))
    return described.join(P.nan_contributors(df, features, ("season",)).withColumnRenamed("pct", "lacking_pct"), ["season", "feature"], "left")
