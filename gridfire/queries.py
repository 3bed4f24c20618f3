"""The registered queries of the grid operators over the sample tables, and SQL that states the same by other means."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import grid as G
from .operators import cleaning as C
from .operators import density as D
from .operators import incidents as I
from .operators import parts as W
from .operators import profile as P
from .operators import raster as R
from .operators import resample as Z
from .operators import series as S
from .operators import vector as V
from .plans import pipeline as L
from .sources import files as E
from .sources import tables as T
from .views import FCLASSES, SPLITS, TRAIN, grid_of, source_grid_of, tile_grid_of, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
YEARS = list(range(1995, 2002))


class Data:
    """The views of a folder, with the grid and land of its cells."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.dir, name)

    @property
    def grid(self) -> G.Grid:
        return grid_of(self.grid_cells)

    @property
    def land(self) -> DataFrame:
        return self.grid_cells.where("elevation IS NOT NULL").select("row", "col")

    @property
    def edges(self) -> DataFrame:
        return V.edges_of(self.boundary_vertices)

    @property
    def activity(self) -> DataFrame:
        return V.box_edges(self.landuse_boxes.where(F.col("fclass").isin(FCLASSES)), ("feature_id",))


def query(sql: str | None = None, *views: str, name: str | None = None):
    """Registers ``f(Data)`` under its name, with SQL after a WITH clause of the views."""

    def add(f):
        nonlocal sql
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Data(spark, sf_dir))
        if sql is not None:
            head = with_views(*views)
            if sql.startswith("RECURSIVE "):
                head, sql = head.replace("WITH ", "WITH RECURSIVE ", 1), sql.removeprefix("RECURSIVE ")
            ORACLE_SQL[key] = head + ("\n" if sql.lstrip().startswith("SELECT") else " " if head == "WITH " else ", ") + sql.strip()
        return f

    return add


SEASON = "CASE WHEN month(call_date) IN (12, 1, 2) THEN 'WINTER' WHEN month(call_date) IN (3, 4, 5) THEN 'SPRING' WHEN month(call_date) IN (6, 7, 8) THEN 'SUMMER' ELSE 'FALL' END"
SPLIT = "CASE WHEN year(call_date) < 1995 THEN NULL WHEN year(call_date) < 2000 THEN 'train' WHEN year(call_date) < 2001 THEN 'val' ELSE 'test' END"
OBS_SEASON = SEASON.replace("call_date", "obs_date")
LAND = "land AS (SELECT row, col FROM grid_cells WHERE elevation IS NOT NULL)"
HEIGHT = "(SELECT max(row) + 1 FROM grid_cells)"


def inside_sql(points: str, x: str, y: str, out: str) -> str:
    """CTEs: ``out`` has the points of a table strictly inside the boundary (each point against every edge)."""
    return f"""{EDGES}, {within_sql(points, x, y, out)}"""


EDGES = "edges AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM boundary_vertices a JOIN boundary_vertices b ON b.seq = (a.seq + 1) % 5)"


def within_sql(points: str, x: str, y: str, out: str) -> str:
    return f"""{out} AS (SELECT p.* FROM {points} p WHERE (SELECT count(*) FROM edges WHERE ((y1 <= {y} AND {y} < y2) OR (y2 <= {y} AND {y} < y1)) AND x1 + ({y} - y1) / (y2 - y1) * (x2 - x1) > {x}) % 2 = 1)"""


# --- incidents ---


@query("SELECT incident_id, year(call_date) AS year, month(call_date) AS month, day(call_date) AS day FROM incidents", "incidents")
def date_parts(d):
    return I.date_parts(d.incidents).select("incident_id", "year", "month", "day")


@query("SELECT incident_id, call_date FROM incidents", "incidents")
def parse_call_date(d):
    text = d.incidents.select("incident_id", F.date_format("call_date", "dd/MM/yyyy").alias("call_date"))
    return I.parse_call_date(text, "call_date")


@query("SELECT incident_id, call_date FROM incidents WHERE month(call_date) IN (3, 4, 5)", "incidents")
def season_filter(d):
    return I.season_filter(d.incidents, "SPRING").select("incident_id", "call_date")


@query(f"SELECT incident_id, {SEASON} AS season FROM incidents", "incidents")
def season_of_month(d):
    return d.incidents.select("incident_id", G.season_of_month(F.month("call_date")).alias("season"))


@query(f"SELECT incident_id, {SPLIT} AS split FROM incidents", "incidents")
def split_by_year(d):
    return I.split_by_year(d.incidents, SPLITS).select("incident_id", "split")


@query(f"SELECT var, count(*) AS n, sum(value) AS total, {OBS_SEASON} AS season FROM climate_obs WHERE year(obs_date) BETWEEN 1995 AND 1999 AND month(obs_date) BETWEEN 3 AND 11 GROUP BY ALL", "climate_obs")
def training_window_filter(d):
    kept = I.training_window(d.climate_obs, TRAIN, ["SPRING", "SUMMER", "FALL"])
    return kept.groupBy("season", "var").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("SELECT min(year(call_date)) AS first_year, max(year(call_date)) AS last_year FROM incidents", "incidents")
def year_range(d):
    return I.year_range(d.incidents)


@query(f"SELECT {SEASON} AS season, count(*) / (SELECT count(*) FROM incidents) AS share FROM incidents GROUP BY 1", "incidents")
def season_share(d):
    return I.season_share(d.incidents)


@query(f"SELECT {SEASON} AS season, " + ", ".join(f"count(*) FILTER (year(call_date) = {y}) AS y{y}" for y in YEARS) + " FROM incidents GROUP BY 1", "incidents")
def season_year_counts(d):
    return I.season_year_counts(d.incidents, YEARS)


PCT = f"""s AS (SELECT {SEASON} AS season, year(call_date) AS year FROM incidents), names(season) AS (VALUES ('WINTER'), ('SPRING'), ('SUMMER'), ('FALL')),
    years AS (SELECT year, count(*) AS total FROM s GROUP BY 1), n AS (SELECT season, year, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT season, year, 100.0 * coalesce(n, 0) / total AS pct FROM names CROSS JOIN years LEFT JOIN n USING (season, year)"""


@query(PCT, "incidents")
def season_year_pct(d):
    return I.season_year_pct(d.incidents)


@query(PCT.replace("pct FROM", "percent FROM").replace("SELECT season, year, 100.0", "SELECT season, CAST(year AS VARCHAR) AS year, 100.0"), "incidents")
def season_year_long(d):
    wide = I.season_year_pct(d.incidents).groupBy("season").pivot("year", YEARS).agg(F.first("pct"))
    return wide.unpivot("season", [f"`{y}`" for y in YEARS], "year", "percent").where("percent IS NOT NULL")


@query(inside_sql("repeated_incidents", "easting", "northing", "hit") + " SELECT call_date, easting, northing, vehicles, 'Essex' AS name FROM hit", "repeated_incidents", "boundary_vertices")
def points_within_polygon_repeated(d):
    """Incidents without an id, up to four of which are alike in every column."""
    return V.points_within_polygon(d.repeated_incidents, d.edges).select("call_date", "easting", "northing", "vehicles", "name")


@query(inside_sql("repeated_incidents", "easting", "northing", "hit") + f" SELECT {SEASON} AS season, {SPLIT} AS split, easting, northing, count(*) AS n FROM hit GROUP BY ALL", "repeated_incidents", "boundary_vertices")
def incident_splits_repeated(d):
    return I.incident_splits(d.repeated_incidents, d.edges, SPLITS).groupBy("season", "split", "easting", "northing").agg(F.count(F.lit(1)).alias("n"))


SPLITS_SQL = inside_sql("incidents", "easting", "northing", "hit") + f" SELECT incident_id, {SEASON} AS season, {SPLIT} AS split FROM hit"


@query(SPLITS_SQL, "incidents", "boundary_vertices")
def incident_splits(d):
    return I.incident_splits(d.incidents, d.edges, SPLITS).select("incident_id", "season", "split")


@query(inside_sql("incidents", "easting", "northing", "hit") + " SELECT incident_id, 'Essex' AS name FROM hit", "incidents", "boundary_vertices")
def points_within_polygon(d):
    return V.points_within_polygon(d.incidents, d.edges).select("incident_id", "name")


# --- cells and vectors ---


@query("SELECT seq, x, y FROM regions WHERE name = 'NATION_7'", "regions")
def boundary_select(d):
    return V.boundary_select(d.regions, "NATION_7").select("seq", "x", "y")


@query("SELECT feature_id, fclass FROM landuse_boxes WHERE fclass IN ('household', 'machinery')", "landuse_boxes")
def fclass_filter(d):
    return d.landuse_boxes.where(F.col("fclass").isin(FCLASSES)).select("feature_id", "fclass")


@query("SELECT feature_id FROM landuse_boxes WHERE feature_id % 100 <> 0", "landuse_boxes")
def drop_empty_geometry(d):
    geom = d.landuse_boxes.withColumn("geom", F.when(F.col("feature_id") % 100 != 0, F.array("xmin", "ymin")))
    return V.drop_empty_geometry(geom).select("feature_id")


@query("SELECT row, col, 550000.0 + (col + 0.5) * 30 AS x, 220000.0 - (row + 0.5) * 30 AS y FROM grid_cells", "grid_cells")
def cell_center(d):
    x, y = G.cell_center(d.grid, F.col("row"), F.col("col"))
    return d.grid_cells.select("row", "col", x.alias("x"), y.alias("y"))


CELL = f"""c AS (SELECT *, CAST(floor((220000.0 - northing) / 30) AS INT) AS row, CAST(floor((easting - 550000.0) / 30) AS INT) AS col FROM incidents),
    on_grid AS (SELECT * FROM c WHERE row BETWEEN 0 AND {HEIGHT} - 1 AND col BETWEEN 0 AND 49)"""


@query(CELL + " SELECT incident_id, row, col FROM on_grid", "grid_cells", "incidents")
def point_to_cell(d):
    return G.point_to_cell(d.incidents, d.grid).select("incident_id", "row", "col")


@query(CELL + " SELECT row, col, count(*) AS n FROM on_grid GROUP BY 1, 2", "grid_cells", "incidents")
def fire_counts(d):
    return D.fire_counts(d.incidents, d.grid)


@query(CELL + " SELECT DISTINCT row, col FROM on_grid", "grid_cells", "incidents")
def rasterize_points(d):
    return V.rasterize_points(d.incidents, d.grid)


@query(f"SELECT 550000.0 AS left, 220000.0 - 30.0 * {HEIGHT} AS bottom, 551500.0 AS right, 220000.0 AS top", "grid_cells")
def grid_bounds(d):
    return R.grid_bounds(d.grid_cells, d.grid)


@query("c AS (SELECT row, col, 550000.0 + (col + 0.5) * 30 AS x, 220000.0 - (row + 0.5) * 30 AS y FROM grid_cells), " + inside_sql("c", "x", "y", "hit") + " SELECT row, col FROM hit", "grid_cells", "boundary_vertices")
def clip_cells_to_boundary(d):
    return V.clip_cells_to_boundary(d.grid_cells.select("row", "col"), d.grid, d.edges)


@query("SELECT row, col, elevation FROM grid_cells WHERE elevation IS NOT NULL", "grid_cells")
def land_mask(d):
    return R.land_mask(d.grid_cells, d.land)


def touched_sql(segments: str, out: str) -> str:
    """A CTE: cells whose box a segment touches, by separating axes, every cell against every segment."""
    side = lambda x, y: f"sign((x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1))"
    corners = [side(f"(550000.0 + (col + {a}) * 30)", f"(220000.0 - (row + {b}) * 30)") for a in (0, 1) for b in (0, 1)]
    return f"""{out} AS (SELECT DISTINCT row, col FROM grid_cells JOIN {segments} ON greatest(x1, x2) >= 550000.0 + col * 30 AND least(x1, x2) < 550000.0 + (col + 1) * 30
        AND greatest(y1, y2) >= 220000.0 - (row + 1) * 30 AND least(y1, y2) < 220000.0 - row * 30 AND abs({" + ".join(corners)}) < 4)"""


ROADS = touched_sql("road_segments", "roads")


@query(ROADS + " SELECT * FROM roads", "grid_cells", "road_segments")
def rasterize_lines(d):
    return V.rasterize_lines(d.road_segments, d.grid)


ACTIVITY = """activity AS (SELECT DISTINCT row, col FROM grid_cells JOIN landuse_boxes ON fclass IN ('household', 'machinery')
    AND xmax >= 550000.0 + col * 30 AND xmin < 550000.0 + (col + 1) * 30 AND ymax >= 220000.0 - (row + 1) * 30 AND ymin < 220000.0 - row * 30)"""


@query(ACTIVITY + " SELECT * FROM activity", "grid_cells", "landuse_boxes")
def rasterize_polygons(d):
    return V.rasterize_polygons(d.activity, d.grid, "feature_id")


@query(ACTIVITY.replace("fclass IN ('household', 'machinery')", "fclass IN ('household', 'machinery', 'building')") + " SELECT * FROM activity", "grid_cells", "landuse_boxes")
def human_activity_layer(d):
    buildings = V.box_edges(d.landuse_boxes.where("fclass = 'building'"), ("feature_id",))
    return V.human_activity_layer(d.activity, buildings, d.grid)


def distance_sql(layer: str) -> str:
    """Every land cell against every presence cell."""
    return f"SELECT '{layer}' AS layer, l.row, l.col, round(min(sqrt((l.row - p.row) * (l.row - p.row) + (l.col - p.col) * (l.col - p.col))) * 0.03, 6) AS km FROM land l LEFT JOIN {{0}} p ON true GROUP BY l.row, l.col"


def rounded(df: DataFrame, col: str = "km", digits: int = 6) -> DataFrame:
    return df.withColumn(col, F.round(col, digits))


@query(f"{ROADS}, {LAND} " + distance_sql("d_roads").format("roads"), "grid_cells", "road_segments")
def d_roads(d):
    return rounded(R.distance_to_features(V.rasterize_lines(d.road_segments, d.grid).withColumn("layer", F.lit("d_roads")), d.grid, d.land, ["d_roads"]))


RIVERS = touched_sql("river_segments", "rivers")


@query(f"{RIVERS}, {LAND} " + distance_sql("d_rivers").format("rivers"), "grid_cells", "river_segments")
def d_rivers(d):
    return rounded(R.distance_to_features(V.rasterize_lines(d.river_segments, d.grid).withColumn("layer", F.lit("d_rivers")), d.grid, d.land, ["d_rivers"]))


@query(f"{ACTIVITY}, {LAND} " + distance_sql("d_activity").format("activity"), "grid_cells", "landuse_boxes")
def d_activity(d):
    cells = V.rasterize_polygons(d.activity, d.grid, "feature_id")
    return rounded(R.distance_to_features(cells.withColumn("layer", F.lit("d_activity")), d.grid, d.land, ["d_activity"]))


@query(f"{CELL}, {LAND}, fires AS (SELECT DISTINCT row, col FROM on_grid WHERE month(call_date) IN (3, 4, 5) AND year(call_date) BETWEEN 1995 AND 1999) " + distance_sql("SPRING").format("fires"), "grid_cells", "incidents")
def d_fires(d):
    train = I.split_by_year(I.season_filter(d.incidents, "SPRING"), SPLITS).where("split = 'train'")
    marks = V.rasterize_points(train, d.grid).withColumn("layer", F.lit("SPRING"))
    return rounded(R.distance_to_features(marks, d.grid, d.land, ["SPRING"]))


@query(f"{ROADS}, {ACTIVITY}, {LAND} {distance_sql('d_activity').format('activity')} UNION ALL {distance_sql('d_roads').format('roads')}", "grid_cells", "road_segments", "landuse_boxes")
def distance_to_features(d):
    mark = lambda df, name: df.select(F.lit(name).alias("layer"), "row", "col")
    both = mark(V.rasterize_lines(d.road_segments, d.grid), "d_roads").union(mark(V.rasterize_polygons(d.activity, d.grid, "feature_id"), "d_activity"))
    return rounded(R.distance_to_features(both, d.grid, d.land, ["d_roads", "d_activity"]))


# --- terrain, alignment, series ---



def terrain_sql(cells: str, height: str, last: str) -> str:
    """CTEs: ``t`` has the gradient of a cell table by four self joins."""
    return f"""n AS (SELECT g.row, g.col, g.elevation AS z, e.elevation AS e, w.elevation AS w, s.elevation AS s, u.elevation AS u, {height} AS h, {last} AS last FROM {cells} g
    LEFT JOIN {cells} e ON e.row = g.row AND e.col = g.col + 1 LEFT JOIN {cells} w ON w.row = g.row AND w.col = g.col - 1
    LEFT JOIN {cells} s ON s.row = g.row + 1 AND s.col = g.col LEFT JOIN {cells} u ON u.row = g.row - 1 AND u.col = g.col),
    t AS (SELECT row, col, z, CASE col WHEN 0 THEN (e - z) / 30 WHEN last THEN (z - w) / 30 ELSE (e - w) / 60 END AS dx,
        CASE WHEN row = 0 THEN (s - z) / 30 WHEN row = h - 1 THEN (z - u) / 30 ELSE (s - u) / 60 END AS dy FROM n)"""


TERRAIN = terrain_sql("grid_cells", HEIGHT, "49")
SLOPE = "CASE WHEN z IS NOT NULL THEN round(degrees(atan(sqrt(dx * dx + dy * dy))), 4) END AS slope"
ASPECT = "CASE WHEN z IS NOT NULL THEN round((degrees(atan2(-dy, dx)) + 360) % 360, 4) END AS aspect"


@query(TERRAIN + " SELECT row, col, round(dx, 6) AS dx, round(dy, 6) AS dy FROM t", "grid_cells")
def terrain_gradient(d):
    return R.terrain(d.grid_cells, d.grid).select("row", "col", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@query(f"{TERRAIN} SELECT row, col, {SLOPE}, {ASPECT} FROM t", "grid_cells")
def slope_aspect(d):
    return R.terrain(d.grid_cells, d.grid).select("row", "col", F.round("slope", 4).alias("slope"), F.round("aspect", 4).alias("aspect"))


TILES = "tiles AS (SELECT row, col, CAST(col % 3 AS INT) AS tile_order, CASE WHEN (row + col) % 4 > 0 THEN elevation END AS value FROM grid_cells UNION ALL SELECT row, col, 5, elevation + 100 FROM grid_cells)"


@query(TILES + " SELECT row, col, arg_min(value, tile_order) AS value FROM tiles WHERE value IS NOT NULL GROUP BY 1, 2", "grid_cells")
def mosaic_tiles(d):
    c = d.grid_cells
    one = c.select("row", "col", (F.col("col") % 3).cast("int").alias("tile_order"), F.when((F.col("row") + F.col("col")) % 4 > 0, F.col("elevation")).alias("value"))
    return R.mosaic_tiles(one.union(c.select("row", "col", F.lit(5), F.col("elevation") + 100)))


CLIMATE = f"mean AS (SELECT {OBS_SEASON} AS season, var, row, col, avg(value) AS value FROM climate_obs WHERE year(obs_date) BETWEEN 1995 AND 1999 AND month(obs_date) BETWEEN 3 AND 11 GROUP BY ALL)"
ALL3 = ["SPRING", "SUMMER", "FALL"]
#: The layers of the climate means, named so that they needn't be read from them first.
CLIMATE_LAYERS = [(season, var) for season in ALL3 for var in ("tas", "rainfall", "hurs")]


@query(CLIMATE + " SELECT season, var, row, col, round(value, 6) AS value FROM mean", "climate_obs")
def seasonal_climate_mean(d):
    return rounded(S.seasonal_climate_mean(d.climate_obs, TRAIN, ALL3), "value")


def bilinear_sql(source: str, keys: str, out: str, land: str = "land") -> str:
    """CTEs: four lookups of the source's neighbours for each land cell."""
    cells = f"tgt_{out} AS (SELECT row, col, (col + 0.5) / 5 - 0.5 AS fx, (row + 0.5) / 5 - 0.5 AS fy FROM {land} WHERE (row + 0.5) / 5 < (SELECT max(row) + 1 FROM {source}) AND (col + 0.5) / 5 < 10)"
    near = f"""near_{out} AS (SELECT row, col, CAST(floor(fy) AS INT) + a AS sr, CAST(floor(fx) AS INT) + b AS sc, abs(1 - a - (fy - floor(fy))) * abs(1 - b - (fx - floor(fx))) AS w
        FROM tgt_{out}, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(a, b))"""
    return f"""{cells}, {near}, {out} AS (SELECT {keys}, n.row, n.col, sum(w * value) / sum(w) AS value FROM near_{out} n JOIN {source} s ON s.row = sr AND s.col = sc WHERE value IS NOT NULL AND w > 0 GROUP BY ALL)"""


@query(f"{CLIMATE}, {LAND}, {bilinear_sql('mean', 'season, var', 'aligned')} SELECT season, var, row, col, round(value, 6) AS value FROM aligned", "grid_cells", "climate_obs")
def align_to_reference(d):
    mean = S.seasonal_climate_mean(d.climate_obs, TRAIN, ALL3)
    return rounded(R.align_to_reference(mean, source_grid_of(d.climate_obs), d.land, d.grid, ("season", "var"), layers=CLIMATE_LAYERS), "value")


@query(f"""{CLIMATE}, c AS (SELECT row, col, 550000.0 + (col + 0.5) * 30 AS x, 220000.0 - (row + 0.5) * 30 AS y FROM grid_cells WHERE elevation IS NOT NULL), {inside_sql("c", "x", "y", "hit")},
    {bilinear_sql("mean", "season, var", "aligned", "hit")} SELECT season, var, row, col, round(value, 6) AS value FROM aligned""", "grid_cells", "climate_obs", "boundary_vertices")
def to_reference(d):
    """Climate features on the land inside the boundary."""
    inside = V.clip_cells_to_boundary(d.land, d.grid, d.edges)
    mean = S.seasonal_climate_mean(d.climate_obs, TRAIN, ALL3)
    return rounded(R.align_to_reference(mean, source_grid_of(d.climate_obs), inside, d.grid, ("season", "var"), layers=CLIMATE_LAYERS), "value")


NDVI_DATED = """dated AS (SELECT *, CAST(make_date(CAST(regexp_extract(file, 'doy(\\d{4})', 1) AS INT), 1, 1) + CAST(regexp_extract(file, 'doy\\d{4}(\\d{3})', 1) AS INT) - 1 AS DATE) AS obs_date FROM ndvi_obs)"""


@query(NDVI_DATED + " SELECT file, count(*) AS n FROM dated WHERE month(obs_date) IN (6, 7, 8) AND year(obs_date) BETWEEN 1995 AND 1999 GROUP BY 1", "ndvi_obs")
def select_files_by_date(d):
    return S.select_files_by_date(d.ndvi_obs, TRAIN, ["SUMMER"]).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT file, count(*) AS n FROM ndvi_obs WHERE file LIKE '%1996%' OR file LIKE '%1997%' GROUP BY 1", "ndvi_obs")
def select_files_by_year(d):
    return S.select_files_by_year(d.ndvi_obs, [1996, 1997]).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


NDVI = "CASE WHEN dn BETWEEN -2000 AND 10000 THEN dn * 0.0001 END"


@query(f"SELECT dn, round(CAST({NDVI} AS DOUBLE), 6) AS value, count(*) AS n FROM ndvi_obs GROUP BY 1, 2", "ndvi_obs")
def ndvi_scale_mask(d):
    return d.ndvi_obs.groupBy("dn", F.round(G.ndvi_scale_mask(F.col("dn")), 6).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT row, col, round(avg(CAST({NDVI} AS DOUBLE)), 6) AS value FROM ndvi_obs GROUP BY 1, 2", "ndvi_obs")
def mean_ndvi(d):
    return rounded(S.mean_ndvi(d.ndvi_obs), "value")


@query(f"""{NDVI_DATED}, mean AS (SELECT row, col, avg(CAST({NDVI} AS DOUBLE)) AS value FROM dated WHERE month(obs_date) IN (6, 7, 8) AND year(obs_date) BETWEEN 1995 AND 1999 GROUP BY 1, 2), {LAND},
    {bilinear_sql("mean", "0 AS z", "aligned").replace("GROUP BY ALL", "GROUP BY n.row, n.col")} SELECT row, col, round(value, 6) AS value FROM aligned""", "grid_cells", "ndvi_obs")
def ndvi_feature(d):
    mean = S.mean_ndvi(S.select_files_by_date(d.ndvi_obs, TRAIN, ["SUMMER"]))
    return rounded(R.align_to_reference(mean, source_grid_of(d.ndvi_obs), d.land, d.grid), "value")


@query("SELECT DISTINCT row, col, 550000.0 + col * 150.0 AS easting, 220000.0 - row * 150.0 AS northing, 550000.0 AS x0, 220000.0 AS y0 FROM climate_obs", "climate_obs")
def orient_north_up(d):
    at = d.climate_obs.select((550000.0 + F.col("col") * 150.0).alias("easting"), (220000.0 - F.col("row") * 150.0).alias("northing")).distinct()
    return R.orient_north_up(at, 150.0)


def steps_sql(source: str, name: str, *steps: dict[str, str]) -> str:
    """CTEs: ``name`` is the source with columns added step by step."""
    out, at = [], source
    for k, step in enumerate(steps):
        own = name if k == len(steps) - 1 else f"{name}_{k}"
        out.append(f"{own} AS (SELECT * EXCLUDE ({', '.join(c for c in step if any(c in x for x in steps[:k])) or 'zz'}), " + ", ".join(f"{e} AS {c}" for c, e in step.items()) + f" FROM {at})")
        out[-1] = out[-1].replace("SELECT * EXCLUDE (zz),", "SELECT *,")
        at = own
    return ", ".join(out)


def _ellipsoid(axes: tuple[float, float]) -> tuple[float, float]:
    return axes[0], 1 - axes[1] ** 2 / axes[0] ** 2


F0, PHI0, LAM0, E0, N0 = G.PROJECTION


def arc_sql(phi: str) -> str:
    (a, b), (d, t) = G.AIRY, (f"({phi} - {PHI0!r})", f"({phi} + {PHI0!r})")
    n = (a - b) / (a + b)
    c0, c1, c2, c3 = 1 + n + 5 / 4 * (n**2 + n**3), 3 * (n + n**2) + 21 / 8 * n**3, 15 / 8 * (n**2 + n**3), 35 / 24 * n**3
    return f"({b * F0!r} * ({c0!r} * {d} - {c1!r} * sin({d}) * cos({t}) + {c2!r} * sin(2 * {d}) * cos(2 * {t}) - {c3!r} * sin(3 * {d}) * cos(3 * {t})))"


def bng_sql(source: str, name: str) -> str:
    """CTEs: ``name`` is the source (lon, lat) with ``easting`` and ``northing``."""
    a, e2 = _ellipsoid(G.WGS84)
    b, f2 = _ellipsoid(G.AIRY)
    tx, ty, tz, s, *r = G.SHIFT
    rx, ry, rz = (math.radians(x / 3600) for x in r)
    turn = {"p": "sqrt(x * x + y * y)"}
    again = {"phi": f"atan2(z + {f2!r} * {b!r} / sqrt(1 - {f2!r} * sin(phi) ** 2) * sin(phi), p)"}
    return steps_sql(
        source, name, {"phi": "radians(lat)", "lam": "radians(lon)"}, {"nu": f"{a!r} / sqrt(1 - {e2!r} * sin(phi) ** 2)"},
        {"u": "nu * cos(phi) * cos(lam)", "v": "nu * cos(phi) * sin(lam)", "w": f"{1 - e2!r} * nu * sin(phi)"},
        {"x": f"{tx!r} + {1 + s!r} * u - {rz!r} * v + {ry!r} * w", "y": f"{ty!r} + {rz!r} * u + {1 + s!r} * v - {rx!r} * w", "z": f"{tz!r} - {ry!r} * u + {rx!r} * v + {1 + s!r} * w"},
        turn, {"phi": f"atan2(z, p * {1 - f2!r})"}, again, again, again,
        {"nu": f"{b * F0!r} / sqrt(1 - {f2!r} * sin(phi) ** 2)", "rho": f"{b * F0 * (1 - f2)!r} / (1 - {f2!r} * sin(phi) ** 2) ** 1.5", "l": f"atan2(y, x) - {LAM0!r}", "si": "sin(phi)", "co": "cos(phi)", "ta": "tan(phi)"},
        {"eta": "nu / rho - 1"},
        {"northing": f"{arc_sql('phi')} + {N0!r} + nu / 2 * si * co * l ** 2 + nu / 24 * si * co ** 3 * (5 - ta ** 2 + 9 * eta) * l ** 4 + nu / 720 * si * co ** 5 * (61 - 58 * ta ** 2 + ta ** 4) * l ** 6",
         "easting": f"{E0!r} + nu * co * l + nu / 6 * co ** 3 * (nu / rho - ta ** 2) * l ** 3 + nu / 120 * co ** 5 * (5 - 18 * ta ** 2 + ta ** 4 + 14 * eta - 58 * ta ** 2 * eta) * l ** 5"},
    )


def degrees_sql(source: str, name: str) -> str:
    """CTEs: ``name`` is the source (easting, northing) with ``lon`` and ``lat``."""
    a, e2 = _ellipsoid(G.AIRY)
    b, f2 = _ellipsoid(G.WGS84)
    shift, turn = G._rotation()
    back = np.linalg.inv(turn).tolist()
    rows = {k: " + ".join(f"{r[i]!r} * ({c} - {float(shift[i])!r})" for i, c in enumerate("uvw")) for k, r in zip("xyz", back, strict=True)}
    again = {"phi": f"phi + (northing - {N0!r} - {arc_sql('phi')}) / {a * F0!r}"}
    turned = {"phi": f"atan2(z + {f2!r} * {b!r} / sqrt(1 - {f2!r} * sin(phi) ** 2) * sin(phi), p)"}
    return steps_sql(
        source, name, {"phi": f"(northing - {N0!r}) / {a * F0!r} + {PHI0!r}", "d": f"easting - {E0!r}"}, *[again] * 5,
        {"nu": f"{a * F0!r} / sqrt(1 - {e2!r} * sin(phi) ** 2)", "rho": f"{a * F0 * (1 - e2)!r} / (1 - {e2!r} * sin(phi) ** 2) ** 1.5", "ta": "tan(phi)", "co": "cos(phi)"}, {"eta": "nu / rho - 1"},
        {"phi": "phi - ta * d ** 2 / (2 * rho * nu) + ta * d ** 4 / (24 * rho * nu ** 3) * (5 + 3 * ta ** 2 + eta - 9 * ta ** 2 * eta) - ta * d ** 6 / (720 * rho * nu ** 5) * (61 + 90 * ta ** 2 + 45 * ta ** 4)",
         "l": f"{LAM0!r} + (d / nu - d ** 3 / (6 * nu ** 3) * (nu / rho + 2 * ta ** 2) + d ** 5 / (120 * nu ** 5) * (5 + 28 * ta ** 2 + 24 * ta ** 4) - d ** 7 / (5040 * nu ** 7) * (61 + 662 * ta ** 2 + 1320 * ta ** 4 + 720 * ta ** 6)) / co"},
        {"nu": f"{a!r} / sqrt(1 - {e2!r} * sin(phi) ** 2)"}, {"u": "nu * cos(phi) * cos(l)", "v": "nu * cos(phi) * sin(l)", "w": f"{1 - e2!r} * nu * sin(phi)"}, rows,
        {"p": "sqrt(x * x + y * y)"}, {"phi": f"atan2(z, p * {1 - f2!r})"}, *[turned] * 4, {"lon": "degrees(atan2(y, x))", "lat": "degrees(phi)"},
    )


@query("spread AS (SELECT incident_id, easting / 550000.0 - 0.5 AS lon, 51.0 + northing / 440000.0 AS lat FROM incidents), w AS (SELECT incident_id, lon, lat FROM spread), " + bng_sql("w", "placed") + " SELECT incident_id, round(easting, 2) AS east, round(northing, 2) AS north FROM placed", "incidents")
def to_bng(d):
    """National grid coordinates of degrees spread by the incidents; tested against published points too."""
    degrees = d.incidents.select("incident_id", (F.col("easting") / 550000.0 - 0.5).alias("lon"), (F.lit(51.0) + F.col("northing") / 440000.0).alias("lat"))
    return G.to_bng(degrees).select("incident_id", F.round("easting", 2).alias("east"), F.round("northing", 2).alias("north"))


@query(degrees_sql("(SELECT incident_id, easting, northing FROM incidents)", "placed") + " SELECT incident_id, round(lon, 8) AS lon, round(lat, 8) AS lat FROM placed", "incidents")
def from_bng(d):
    return G.from_bng(d.incidents.select("incident_id", "easting", "northing")).select("incident_id", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


#: The border of the tiles, 21 places a side, on the national grid; the cells of its extent, back in degrees; the first tile with data at four neighbours.
DEM = f"""border AS (SELECT 0.5::DOUBLE AS west, 51.9::DOUBLE AS north, 0.5::DOUBLE + 50 * (1::DOUBLE / 3600) AS east, 51.9::DOUBLE - (SELECT max(row) + 1 FROM dem_tiles) * (1::DOUBLE / 3600) AS south),
    places AS (SELECT k::DOUBLE / 20 AS k, * FROM range(21) r(k), border),
    edge AS (SELECT west + k * (east - west) AS lon, south AS lat FROM places UNION ALL SELECT west + k * (east - west), north FROM places UNION ALL SELECT west, south + k * (north - south) FROM places UNION ALL SELECT east, south + k * (north - south) FROM places),
    {bng_sql("edge", "outline")}, extent AS (SELECT min(easting) AS x0, max(northing) AS y0, CAST(ceil((max(northing) - min(northing)) / 30) AS BIGINT) AS h, CAST(ceil((max(easting) - min(easting)) / 30) AS BIGINT) AS wide FROM outline),
    cells AS (SELECT CAST(r AS INT) AS row, CAST(k AS INT) AS col, x0 + (k + 0.5) * 30 AS easting, y0 - (r + 0.5) * 30 AS northing FROM extent, range(0, h) a(r), range(0, wide) b(k)), {degrees_sql("cells", "spot")},
    spots AS (SELECT row, col, (lon - 0.5) / (1::DOUBLE / 3600) - 0.5 AS fx, (51.9 - lat) / (1::DOUBLE / 3600) - 0.5 AS fy FROM spot),
    inner_ AS (SELECT * FROM spots WHERE fx >= -0.5 AND fx < 49.5 AND fy >= -0.5 AND fy < (SELECT max(row) + 1 FROM dem_tiles) - 0.5),
    four AS (SELECT row, col, CAST(floor(fy) AS INT) + a AS sr, CAST(floor(fx) AS INT) + b AS sc, abs(1 - a - (fy - floor(fy))) * abs(1 - b - (fx - floor(fx))) AS wt FROM inner_, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(a, b)),
    mosaic AS (SELECT row, col, arg_min(value, tile_order) AS value FROM dem_tiles WHERE value IS NOT NULL GROUP BY 1, 2),
    known AS (SELECT f.row, f.col, sum(wt * value) / sum(wt) AS elevation FROM four f JOIN mosaic m ON m.row = sr AND m.col = sc WHERE wt > 0 GROUP BY 1, 2),
    dem AS (SELECT cells.row, cells.col, elevation FROM cells LEFT JOIN known USING (row, col))"""


@query(DEM + " SELECT row, col, round(elevation, 3) AS elevation FROM dem WHERE elevation IS NOT NULL", "dem_tiles")
def reproject_resample(d):
    """Tiles on a grid of degrees, as one elevation layer on a national grid of 30 m."""
    tiles = d.dem_tiles
    return rounded(L.dem_from_tiles(tiles, tile_grid_of(tiles))[0], "elevation", 3)


@query(f"{DEM}, {terrain_sql('dem', '(SELECT h FROM extent)', '(SELECT wide - 1 FROM extent)')} SELECT row, col, round(z, 3) AS elevation, round(degrees(atan(sqrt(dx * dx + dy * dy))), 3) AS slope FROM t WHERE z IS NOT NULL", "dem_tiles")
def topography_from_tiles(d):
    """Mosaic, reprojection, and slope of the elevation before it is clipped."""
    tiles = d.dem_tiles
    cells, grid = L.dem_from_tiles(tiles, tile_grid_of(tiles))
    return R.terrain(cells, grid).where("elevation IS NOT NULL").select("row", "col", F.round("elevation", 3).alias("elevation"), F.round("slope", 3).alias("slope"))


# --- density and labels ---


def weights_sql() -> str:
    return "k(o, w) AS (VALUES " + ", ".join(f"({o}, CAST({w!r} AS DOUBLE))" for o, w in D.kernel(3.0)) + ")"


#: Each grid cell gathers from 25 x 25 cells, mirrored at the border.
SMOOTH = f"""{CELL}, {LAND}, n AS (SELECT row, col, count(*) AS n FROM on_grid WHERE month(call_date) IN (3, 4, 5) AND year(call_date) BETWEEN 1995 AND 1999 GROUP BY 1, 2), {weights_sql()},
    fold AS (SELECT row, col, a.w * b.w AS w, {HEIGHT} AS h, ((row + a.o) % (2 * {HEIGHT}) + 2 * {HEIGHT}) % (2 * {HEIGHT}) AS u, ((col + b.o) % 100 + 100) % 100 AS v FROM grid_cells, k a, k b),
    density AS (SELECT f.row, f.col, round(sum(w * n), 6) AS density FROM fold f JOIN n ON n.row = CASE WHEN u < h THEN u ELSE 2 * h - 1 - u END AND n.col = CASE WHEN v < 50 THEN v ELSE 99 - v END GROUP BY 1, 2),
    on_land AS (SELECT * FROM density SEMI JOIN land USING (row, col))"""
CUTS = "cuts AS (SELECT quantile_cont(density, 0.6) AS p60, quantile_cont(density, 0.75) AS p75, quantile_cont(density, 0.9) AS p90 FROM on_land WHERE density > 0)"
LABELS = f"{SMOOTH}, {CUTS}, labels AS (SELECT row, col, density, CASE WHEN density >= p90 THEN 3 WHEN density >= p75 THEN 2 WHEN density >= p60 THEN 1 WHEN density > 0 THEN 0 END AS label FROM on_land, cuts)"
BOTH = ("grid_cells", "incidents")


def spring_train(d: Data) -> DataFrame:
    return I.split_by_year(I.season_filter(d.incidents, "SPRING"), SPLITS).where("split = 'train'")


def spring_density(d: Data) -> DataFrame:
    return rounded(D.compute_density(spring_train(d), d.land, d.grid), "density")


@query(SMOOTH + " SELECT row, col, density FROM density WHERE density > 0", *BOTH)
def gaussian_smooth(d):
    return rounded(D.gaussian_smooth(D.fire_counts(spring_train(d), d.grid), d.grid), "density").where("density > 0")


@query(SMOOTH + " SELECT row, col, density FROM on_land", *BOTH)
def compute_density(d):
    return spring_density(d)


@query(f"""{LAND}, p AS (SELECT easting, northing FROM incidents WHERE month(call_date) IN (3, 4, 5) AND year(call_date) BETWEEN 1995 AND 1999),
    d AS (SELECT row, col, sum(exp(-((550000.0 + (col + 0.5) * 30 - easting) ** 2 + (220000.0 - (row + 0.5) * 30 - northing) ** 2) / 800.0)) / ((SELECT count(*) FROM p) * {2 * math.pi * 400!r}) AS density FROM land, p GROUP BY 1, 2)
    SELECT row, col, round(density * 1e9, 4) AS density FROM d WHERE density > 1e-12""", *BOTH)
def kde_density(d):
    dense = D.compute_density(spring_train(d), d.land, d.grid, "kde", bandwidth=20.0).where("density > 1e-12")
    return dense.withColumn("density", F.round(F.col("density") * 1e9, 4))


@query(f"{SMOOTH}, {CUTS} SELECT round(p60, 6) AS p60, round(p75, 6) AS p75, round(p90, 6) AS p90 FROM cuts", *BOTH)
def density_percentiles(d):
    cuts = D.density_percentiles(spring_density(d))
    return cuts.select(*[F.round(c, 6).alias(c) for c in cuts.columns])


@query(LABELS + " SELECT row, col, density, label FROM labels", *BOTH)
def classify_density(d):
    return D.classify_density(spring_density(d))


@query(f"""{LABELS}, j AS (SELECT label FROM land LEFT JOIN labels USING (row, col)), names(class) AS (VALUES ('0'), ('1'), ('2'), ('3'), ('unlabelled'), ('outside'))
    SELECT class, CASE class WHEN 'outside' THEN (SELECT 50 * {HEIGHT} - count(*) FROM j) WHEN 'unlabelled' THEN (SELECT count(*) FROM j WHERE label IS NULL) ELSE (SELECT count(*) FROM j WHERE CAST(label AS VARCHAR) = class) END AS n FROM names""", *BOTH)
def class_counts(d):
    return D.class_counts(D.classify_density(spring_density(d)), d.land, d.grid)


@query(f"""{SMOOTH}, e AS (SELECT min(density) AS a, max(density) AS b FROM on_land WHERE density > 0)
    SELECT CAST(CASE WHEN a = b THEN 0 ELSE least(floor((density - a) / ((b - a) / 80)), 79) END AS INT) AS bin, count(*) AS n FROM on_land, e WHERE density > 0 GROUP BY 1""", *BOTH)
def density_histogram(d):
    return D.density_histogram(spring_density(d))


def feature_table(d: Data) -> DataFrame:
    """Labelled cells with three features, two of them with missing values."""
    labels = D.classify_density(spring_density(d)).select("row", "col", "label")
    return d.grid_cells.join(labels, ["row", "col"], "left").withColumn("a", F.col("elevation") * 2.0 + F.col("col")).withColumn("b", F.when(F.col("col") % 7 != 0, F.col("row") * 0.5))


FEATURES = f"{LABELS}, f AS (SELECT g.row, g.col, elevation, label, elevation * 2.0 + g.col AS a, CASE WHEN g.col % 7 <> 0 THEN g.row * CAST(0.5 AS DOUBLE) END AS b FROM grid_cells g LEFT JOIN labels l ON g.row = l.row AND g.col = l.col)"


@query(FEATURES + " SELECT row, col, label FROM f WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(concat(row, ',', col)), row, col) <= 100", *BOTH)
def sample_per_class(d):
    return C.sample_per_class(feature_table(d), 100).select("row", "col", "label")


@query(FEATURES + """ SELECT row, col, round((elevation - avg(elevation) OVER ()) / stddev_pop(elevation) OVER (), 6) AS elevation, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 6) AS a FROM f""", *BOTH)
def standardize(d):
    z = C.standardize(feature_table(d), ["elevation", "a"])
    return z.select("row", "col", F.round("elevation", 6).alias("elevation"), F.round("a", 6).alias("a"))


NEAREST = FEATURES + ", cl AS (SELECT *, CASE WHEN elevation * elevation + a * a <= (elevation - 30.0) * (elevation - 30.0) + (a - 80.0) * (a - 80.0) THEN 0 ELSE 1 END AS cluster FROM f WHERE elevation IS NOT NULL AND label IS NOT NULL)"


def clustered(d: Data) -> DataFrame:
    return C.assign_clusters(feature_table(d).where("elevation IS NOT NULL AND label IS NOT NULL"), ["elevation", "a"], [[0.0, 0.0], [30.0, 80.0]])


@query(NEAREST + " SELECT row, col, cluster FROM cl", *BOTH)
def assign_clusters(d):
    return clustered(d).select("row", "col", "cluster")


@query(NEAREST + " SELECT cluster FROM cl WHERE label = 3 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1", *BOTH)
def majority_cluster(d):
    return C.majority_cluster(clustered(d), 3)


FLAGGED = NEAREST + ", m AS (SELECT cluster FROM cl WHERE label = 3 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(FLAGGED + " SELECT row, col FROM cl WHERE label = 0 AND cluster IN (SELECT cluster FROM m)", *BOTH)
def flag_low_in_high_cluster(d):
    return C.flag_low_in_high_cluster(clustered(d), 3)


@query(FLAGGED + " SELECT f.row, f.col, CASE WHEN f.label = 0 AND cl.cluster IN (SELECT cluster FROM m) THEN NULL ELSE f.label END AS label FROM f LEFT JOIN cl USING (row, col)", *BOTH)
def drop_labels(d):
    return C.drop_labels(feature_table(d), C.flag_low_in_high_cluster(clustered(d), 3)).select("row", "col", "label")


def kmeans_sql(source: str, name: str, steps: int = 40) -> str:
    """CTEs: ``name`` is the source (row, col, label, x, y) with ``cluster``, by ten starts of two centres, each some steps unrolled."""
    t = f"{name}_"
    near = lambda c: f"(CASE WHEN (x - {c}.x0) ** 2 + (y - {c}.y0) ** 2 <= (x - {c}.x1) ** 2 + (y - {c}.y1) ** 2 THEN 0 ELSE 1 END)"
    first = f"""{t}rows AS MATERIALIZED (SELECT row, col, label, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM {source} WHERE x IS NOT NULL AND y IS NOT NULL),
        {t}places AS (SELECT x, y, min((row, col)) AS cell FROM {t}rows GROUP BY x, y),
        {t}ranked AS (SELECT i, x, y, row_number() OVER (PARTITION BY i ORDER BY md5(concat_ws(',', 42 + i, cell[1], cell[2]))) AS k FROM {t}places, range(10) r(i)),
        {t}0 AS MATERIALIZED (SELECT a.i, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM {t}ranked a JOIN {t}ranked b ON a.i = b.i AND a.k = 1 AND b.k = 2)"""
    out = [first]
    for n in range(steps):
        mean = lambda v, k: f"coalesce(avg({v}) FILTER ({near('c')} = {k}), any_value(c.{v}{k})) AS {v}{k}"
        out.append(f"{t}{n + 1} AS MATERIALIZED (SELECT i, {mean('x', 0)}, {mean('y', 0)}, {mean('x', 1)}, {mean('y', 1)} FROM {t}rows, {t}{n} c GROUP BY i)")
    out.append(f"{t}costs AS (SELECT i, any_value(least((x0, y0), (x1, y1))) AS p, any_value(greatest((x0, y0), (x1, y1))) AS q, round(sum(least((x - x0) ** 2 + (y - y0) ** 2, (x - x1) ** 2 + (y - y1) ** 2)), 4) AS cost FROM {t}rows, {t}{steps} GROUP BY i)")
    out.append(f"{t}best AS (SELECT p[1] AS x0, p[2] AS y0, q[1] AS x1, q[2] AS y1 FROM {t}costs ORDER BY cost, p, q LIMIT 1)")
    out.append(f"{name} AS (SELECT row, col, label, {near('c')} AS cluster FROM {t}rows, {t}best c)")
    return ", ".join(out)


@query(f"{FEATURES}, two AS (SELECT row, col, label, elevation AS x, a AS y FROM f WHERE label IN (0, 3)), {kmeans_sql('two', 'parted')} SELECT row, col, cluster FROM parted", *BOTH)
def kmeans_two(d):
    return C.kmeans_two(feature_table(d).where("label IN (0, 3)"), ["elevation", "a"]).select("row", "col", "cluster")


def cleaned_sql() -> str:
    """CTEs ``gone1`` to ``gone3``: low cells in the cluster of most cells of each higher class, of standardised features."""
    out = []
    for high in (1, 2, 3):
        z = lambda c: f"({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0)"
        out.append(f"z{high} AS (SELECT row, col, label, {z('elevation')} AS x, {z('a')} AS y FROM f WHERE label IN (0, {high})), {kmeans_sql(f'z{high}', f'parted{high}')}")
        out.append(f"gone{high} AS (SELECT row, col FROM parted{high} WHERE label = 0 AND cluster = (SELECT cluster FROM parted{high} WHERE label = {high} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))")
    return ", ".join(out)


@query(f"{FEATURES}, {cleaned_sql()}, gone AS (SELECT * FROM gone1 UNION SELECT * FROM gone2 UNION SELECT * FROM gone3) SELECT f.row, f.col, CASE WHEN gone.row IS NULL THEN f.label END AS label FROM f LEFT JOIN gone ON gone.row = f.row AND gone.col = f.col", *BOTH)
def clean_labels(d):
    return C.clean_labels(feature_table(d), ["elevation", "a"]).select("row", "col", "label")


# --- datasets, profiles, checks ---


@query(f"{LABELS} SELECT l.row, l.col, CAST(elevation AS FLOAT) AS elevation, CAST(density AS FLOAT) AS density FROM land l LEFT JOIN grid_cells g ON g.row = l.row AND g.col = l.col LEFT JOIN on_land o ON o.row = l.row AND o.col = l.col", *BOTH)
def stack_layers(d):
    layer = lambda df, name: df.select(F.lit(name).alias("layer"), "row", "col", F.col(name).alias("value"))
    return R.stack_layers(layer(d.grid_cells, "elevation").union(layer(spring_density(d), "density")), d.land, ["elevation", "density"])


@query(f"{LABELS} SELECT row, col, CAST(elevation AS FLOAT) AS elevation, CAST(label AS FLOAT) AS label FROM grid_cells JOIN labels USING (row, col) WHERE elevation IS NOT NULL AND label IS NOT NULL", *BOTH)
def layers_to_arrays(d):
    """Named layers side by side for the cells that have a label."""
    layer = lambda df, name: df.select(F.lit(name).alias("layer"), "row", "col", F.col(name).cast("double").alias("value"))
    both = layer(d.grid_cells, "elevation").union(layer(D.classify_density(spring_density(d)), "label"))
    return R.layers_to_arrays(both, d.land, ["elevation", "label"])


def describe_sql(source: str, names: list[str]) -> str:
    one = lambda c: f"""SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS least, round(quantile_cont({c}, 0.25), 6) AS q25,
        round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS largest, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing_pct FROM {source}"""  # noqa: E731
    return " UNION ALL ".join(map(one, names))


NAMES = ["elevation", "a", "b"]


@query(FEATURES + " " + describe_sql("f", NAMES), *BOTH)
def describe_features(d):
    out = P.describe_features(feature_table(d), NAMES)
    return out.select("feature", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("feature", "n")])


SEASONED = FEATURES + ", s AS (SELECT *, CASE WHEN row % 2 = 0 THEN 'SPRING' ELSE 'FALL' END AS season FROM f)"


@query(SEASONED + ", m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, " + ", ".join(f"round(100.0 * count(*) FILTER (season = '{s}' AND {c} IS NULL) / count(*) FILTER (season = '{s}'), 3) AS \"{s}\"" for s in ("SPRING", "FALL")) + " FROM s" for c in NAMES
) + ') SELECT *, greatest("SPRING", "FALL") AS largest FROM m', *BOTH)
def nan_pct_by_feature(d):
    df = feature_table(d).withColumn("season", F.when(F.col("row") % 2 == 0, "SPRING").otherwise("FALL"))
    return P.nan_pct_by_feature(df, NAMES, ["SPRING", "FALL"])


MISSING = "(elevation IS NULL OR a IS NULL OR b IS NULL)"


@query(f"{FEATURES} SELECT count(*) FILTER {MISSING} AS n, 100.0 * count(*) FILTER {MISSING} / count(*) AS pct FROM f", *BOTH)
def rows_with_missing(d):
    return P.rows_with_missing(feature_table(d), NAMES)


@query(FEATURES + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 1) AS pct FROM f WHERE {MISSING}" for c in NAMES), *BOTH)
def nan_contributors(d):
    return P.nan_contributors(feature_table(d), NAMES)


@query(f"{FEATURES} SELECT row, col, CASE WHEN elevation IS NULL THEN -1 WHEN b IS NULL THEN 1 ELSE 0 END AS flag FROM f", *BOTH)
def nan_coverage_grid(d):
    return P.nan_coverage_grid(feature_table(d).where("elevation IS NOT NULL"), d.grid, NAMES)


@query("SELECT count(elevation) > 0 AS ok, CASE WHEN count(*) = 0 THEN 'no cells' WHEN count(elevation) = 0 THEN 'all cells are missing' ELSE 'ok' END AS message, 100.0 * count(elevation) / count(*) AS valid_pct FROM grid_cells", "grid_cells")
def validate_raster(d):
    return P.validate_raster(d.grid_cells, "elevation")


@query("SELECT false AS ok, CASE WHEN count(*) = 0 THEN 'no features' ELSE 'no coordinate system' END AS message FROM landuse_boxes", "landuse_boxes")
def validate_vector(d):
    return P.validate_vector(d.landuse_boxes)


@query("SELECT false AS ok, 'missing columns: label' AS message FROM (SELECT 1 FROM incidents LIMIT 1)", "incidents")
def validate_csv(d):
    return P.validate_table(d.incidents, ["incident_id", "label"])


@query(f"{LABELS} SELECT (SELECT count(*) FROM labels) AS rows, (SELECT count(*) FROM land) AS cells, (SELECT count(*) FROM labels) = (SELECT count(*) FROM land) AS ok", *BOTH)
def check_row_count(d):
    return P.check_row_count(D.classify_density(spring_density(d)), d.land)


def sources(d: Data) -> tuple[L.Sources, L.Config]:
    s = L.Sources(d.grid_cells, d.grid, d.edges, d.incidents, d.road_segments, d.river_segments, d.activity, d.climate_obs, d.ndvi_obs, source_grid_of(d.climate_obs))
    return s, L.Config(splits=SPLITS, variables=["tas", "rainfall", "hurs"], density_digits=6)


#: Land inside the boundary.
INSIDE = f"""{EDGES}, centres AS (SELECT row, col, 550000.0 + (col + 0.5) * 30 AS x, 220000.0 - (row + 0.5) * 30 AS y FROM grid_cells WHERE elevation IS NOT NULL),
    {within_sql("centres", "x", "y", "inside")}, land AS (SELECT row, col FROM inside)"""
RELIEF = f"{INSIDE}, {TERRAIN}, r AS (SELECT row, col, z AS elevation, {SLOPE}, {ASPECT} FROM t SEMI JOIN land USING (row, col))"
RELIEF_LAYERS = "SELECT 'elevation' AS layer, row, col, elevation AS value FROM r UNION ALL SELECT 'slope', row, col, slope FROM r UNION ALL SELECT 'aspect', row, col, aspect FROM r"
PLACES = ("grid_cells", "boundary_vertices")
SHAPES = ("road_segments", "river_segments", "landuse_boxes")


@query(f"{RELIEF} {RELIEF_LAYERS}", *PLACES)
def topography_features(d):
    return rounded(L.topography_features(sources(d)[0]), "value", 4)


@query(f"{RELIEF}, {ROADS}, {RIVERS}, {ACTIVITY} {RELIEF_LAYERS} UNION ALL {distance_sql('d_activity').format('activity')} UNION ALL {distance_sql('d_roads').format('roads')} UNION ALL {distance_sql('d_rivers').format('rivers')}", *PLACES, *SHAPES)
def static_features(d):
    far = F.col("layer").startswith("d_")
    return L.static_features(sources(d)[0]).withColumn("value", F.when(far, F.round("value", 6)).otherwise(F.round("value", 4)))


CLIMATE_IN = f"{INSIDE}, {CLIMATE}, {bilinear_sql('mean', 'season, var', 'aligned')}"


@query(CLIMATE_IN + " SELECT season, var AS layer, row, col, round(value, 6) AS value FROM aligned", *PLACES, "climate_obs")
def climate_features(d):
    """From samples with coordinates, which come north up first."""
    s, c = sources(d)
    at = d.climate_obs.withColumns({"easting": 550000.0 + F.col("col") * 150.0, "northing": 220000.0 - F.col("row") * 150.0}).drop("row", "col")
    return rounded(L.climate_features(replace(s, climate=at), c), "value")


NDVI_IN = f"""{NDVI_DATED}, green AS (SELECT {OBS_SEASON} AS season, row, col, avg(CAST({NDVI} AS DOUBLE)) AS value FROM dated WHERE month(obs_date) BETWEEN 3 AND 11 AND year(obs_date) BETWEEN 1995 AND 1999 GROUP BY 1, 2, 3),
    {bilinear_sql('green', 'season', 'greened')}"""


@query(f"{CLIMATE_IN}, {NDVI_IN} SELECT season, var AS layer, row, col, round(value, 6) AS value FROM aligned UNION ALL SELECT season, 'ndvi', row, col, round(value, 6) FROM greened", *PLACES, "climate_obs", "ndvi_obs")
def seasonal_features(d):
    return rounded(L.seasonal_features(*sources(d)), "value")


#: As SMOOTH and LABELS, for incidents inside the boundary and each season at once.
SEASONAL = f"""{INSIDE}, {within_sql("incidents", "easting", "northing", "hit")}, {CELL.replace("FROM incidents", "FROM hit")},
    seasoned AS (SELECT {SEASON} AS season, row, col FROM on_grid WHERE month(call_date) BETWEEN 3 AND 11 AND year(call_date) BETWEEN 1995 AND 1999),
    counted AS (SELECT season, row, col, count(*) AS n FROM seasoned GROUP BY 1, 2, 3), {weights_sql()},
    fold AS (SELECT row, col, a.w * b.w AS w, {HEIGHT} AS h, ((row + a.o) % (2 * {HEIGHT}) + 2 * {HEIGHT}) % (2 * {HEIGHT}) AS u, ((col + b.o) % 100 + 100) % 100 AS v FROM grid_cells SEMI JOIN land USING (row, col), k a, k b),
    dense AS (SELECT season, f.row, f.col, round(sum(w * n), 6) AS density FROM fold f JOIN counted n ON n.row = CASE WHEN u < h THEN u ELSE 2 * h - 1 - u END AND n.col = CASE WHEN v < 50 THEN v ELSE 99 - v END GROUP BY 1, 2, 3),
    cuts AS (SELECT season, quantile_cont(density, 0.6) AS p60, quantile_cont(density, 0.75) AS p75, quantile_cont(density, 0.9) AS p90 FROM dense WHERE density > 0 GROUP BY 1),
    labels AS (SELECT season, row, col, density, CASE WHEN density >= p90 THEN 3 WHEN density >= p75 THEN 2 WHEN density >= p60 THEN 1 WHEN density > 0 THEN 0 END AS label FROM dense JOIN cuts USING (season))"""


@query(SEASONAL + " SELECT season, row, col, density, label FROM labels", *PLACES, "incidents")
def seasonal_labels(d):
    return L.seasonal_labels(*sources(d))


def km_sql(cells: str, keys: str = "") -> str:
    own = f"{keys}, " if keys else ""
    return f"SELECT {own}l.row, l.col, min(sqrt((l.row - p.row) * (l.row - p.row) + (l.col - p.col) * (l.col - p.col))) * 0.03 AS km FROM land l, {cells} p GROUP BY {own}l.row, l.col"


def dataset_sql() -> str:
    far = ", ".join(f"far_{x} AS ({km_sql(x)})" for x in ("roads", "rivers", "activity"))
    climate = "wide AS (SELECT season, row, col, " + ", ".join(f"max(value) FILTER (var = '{v}') AS {v}" for v in ("tas", "rainfall", "hurs")) + " FROM aligned GROUP BY 1, 2, 3)"
    columns = {"elevation": "z", "slope": "degrees(atan(sqrt(dx * dx + dy * dy)))", "aspect": "(degrees(atan2(-dy, dx)) + 360) % 360"}
    columns |= {"d_roads": "a.km", "d_rivers": "b.km", "d_activity": "c.km", "tas": "tas", "rainfall": "rainfall", "hurs": "hurs", "ndvi": "greened.value", "d_fires": "fires.km", "label": "labels.label"}
    picked = ", ".join(f"CAST({e} AS FLOAT) AS {c}" for c, e in columns.items())
    return f"""{SEASONAL}, {TERRAIN}, {ROADS}, {RIVERS}, {ACTIVITY}, {far}, fires AS ({km_sql("(SELECT DISTINCT * FROM seasoned)", "season")}),
        {CLIMATE}, {bilinear_sql('mean', 'season, var', 'aligned')}, {climate}, {NDVI_IN}
        SELECT x.season, land.row, land.col, {picked} FROM land CROSS JOIN (VALUES ('SPRING'), ('SUMMER'), ('FALL')) x(season) JOIN t USING (row, col)
        LEFT JOIN far_roads a USING (row, col) LEFT JOIN far_rivers b USING (row, col) LEFT JOIN far_activity c USING (row, col) LEFT JOIN fires ON fires.season = x.season AND fires.row = land.row AND fires.col = land.col
        LEFT JOIN wide ON wide.season = x.season AND wide.row = land.row AND wide.col = land.col LEFT JOIN greened ON greened.season = x.season AND greened.row = land.row AND greened.col = land.col
        LEFT JOIN labels ON labels.season = x.season AND labels.row = land.row AND labels.col = land.col"""


ALL = (*PLACES, "incidents", *SHAPES, "climate_obs", "ndvi_obs")


@query(dataset_sql(), *ALL)
def assemble_dataset(d):
    """The whole dataset: eleven features and d_fires here, as the sample has three climate variables, and the label."""
    return L.assemble_dataset(*sources(d))


@query(dataset_sql(), *ALL)
def full_pipeline(d):
    """The same by way of its files, one folder a season."""
    return L.full_pipeline(*sources(d), path=T.shared_path(d.spark, "dataset"))


PROFILE = f"""s AS (SELECT {SEASON} AS season, year(call_date) AS year FROM incidents), names(season) AS (VALUES ('WINTER'), ('SPRING'), ('SUMMER'), ('FALL')),
    years AS (SELECT year, count(*) AS total FROM s GROUP BY 1), n AS (SELECT season, year, count(*) AS n FROM s GROUP BY 1, 2), asked AS (SELECT CAST(y AS INT) AS year FROM range(1995, 2002) r(y))"""


@query(f"""{PROFILE} SELECT 'share' AS measure, season, CAST(NULL AS INT) AS year, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM s) AS value FROM s GROUP BY season
    UNION ALL SELECT 'count', names.season, asked.year, CAST(coalesce(n, 0) AS DOUBLE) FROM names CROSS JOIN asked LEFT JOIN n ON n.season = names.season AND n.year = asked.year
    UNION ALL SELECT 'percent', names.season, years.year, 100.0 * coalesce(n, 0) / total FROM names CROSS JOIN years LEFT JOIN n ON n.season = names.season AND n.year = years.year""", "incidents")
def season_profile(d):
    return L.season_profile(d.incidents, YEARS)


def profile_sql(source: str, season: str) -> str:
    part = f"(SELECT * FROM {source} WHERE season = '{season}')"
    lacking = " UNION ALL ".join(f"SELECT '{c}' AS feature, round(100.0 * count(*) FILTER ({c} IS NULL) / nullif(count(*), 0), 1) AS lacking_pct FROM {part} WHERE {MISSING}" for c in NAMES)
    return f"SELECT '{season}' AS season, a.*, b.lacking_pct FROM ({describe_sql(part, NAMES)}) a LEFT JOIN ({lacking}) b USING (feature)"


@query(f"{SEASONED} {profile_sql('s', 'SPRING')} UNION ALL {profile_sql('s', 'FALL')}", *BOTH)
def dataset_profile(d):
    df = feature_table(d).withColumn("season", F.when(F.col("row") % 2 == 0, "SPRING").otherwise("FALL"))
    out = L.dataset_profile(df, NAMES)
    return out.select("season", "feature", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("season", "feature", "n", "lacking_pct")], "lacking_pct")


# --- sources and sinks: what is written and read again ---


@query("SELECT call_date, easting, northing, vehicles FROM incidents", "incidents")
def read_incidents(d):
    """From a file with the source's column names, one more column, and dates as text."""
    path = T.shared_path(d.spark, "incidents")
    names = {v: k for k, v in T.INCIDENT_COLUMNS.items()}
    raw = d.incidents.select(F.col("incident_id").alias("Other"), *[(F.date_format(c, "dd/MM/yyyy") if c == "call_date" else F.col(c)).alias(n) for c, n in names.items()])
    T.write_csv(raw, path)
    return T.read_incidents(d.spark, path)


@query("SELECT row, col, CAST(elevation AS FLOAT) AS value FROM grid_cells", "grid_cells")
def read_cells(d):
    """A layer out of two, with NaN for what is missing in the file."""
    path = T.shared_path(d.spark, "cells")
    layer = d.grid_cells.select(F.lit("elevation").alias("layer"), "row", "col", F.coalesce("elevation", F.lit(float("nan"))).alias("value"))
    T.write_cells(layer.union(layer.withColumns({"layer": F.lit("other"), "value": F.lit(1.0)})), path)
    return T.read_cells(d.spark, path, "elevation").select("row", "col", "value")


@query("SELECT CAST(feature_id AS VARCHAR) AS feature_id, fclass, easting, northing FROM (" + bng_sql("(SELECT feature_id, fclass, xmin / 550000.0 - 0.5 AS lon, 51.0 + ymin / 440000.0 AS lat FROM landuse_boxes WHERE fclass IN ('household', 'machinery'))", "placed").join(["WITH ", " SELECT feature_id, fclass, round(easting, 2) AS easting, round(northing, 2) AS northing FROM placed)"]), "landuse_boxes")
def read_vector_layer(d):
    """One layer of a vertex table, filtered by class, from degrees to the national grid."""
    path = T.shared_path(d.spark, "vertices")
    v = d.landuse_boxes.select(F.lit("landuse").alias("layer"), F.col("feature_id").cast("string").alias("feature_id"), "fclass", (F.col("xmin") / 550000.0 - 0.5).alias("x"), (F.lit(51.0) + F.col("ymin") / 440000.0).alias("y"))
    v.union(v.withColumn("layer", F.lit("buildings"))).write.parquet(path)
    got = T.read_layer(d.spark, path, "landuse", "fclass", FCLASSES, degrees=True)
    return got.select("feature_id", "fclass", F.round("x", 2).alias("easting"), F.round("y", 2).alias("northing"))


@query("SELECT name AS feature_id, name, 'Polygon' AS kind, 0 AS part, 0 AS ring, seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM regions UNION ALL SELECT CAST(feature_id AS VARCHAR), NULL, 'LineString', 0, 0, 0, x1, y1 FROM road_segments UNION ALL SELECT CAST(feature_id AS VARCHAR), NULL, 'LineString', 0, 0, 1, x2, y2 FROM road_segments", "regions", "road_segments")
def read_geojson(d):
    """Polygons and lines, written as GeoJSON features and read again."""
    path = T.shared_path(d.spark, "geojson")
    polygons = d.regions.select(F.col("name").alias("feature_id"), "name", F.lit("Polygon").alias("kind"), F.lit(0).alias("part"), "ring", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    end = lambda k: d.road_segments.select(F.col("feature_id").cast("string"), F.lit(None).cast("string").alias("name"), F.lit("LineString").alias("kind"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.lit(k - 1).alias("seq"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    T.write_geojson(polygons.union(end(1)).union(end(2)), path)
    return T.read_geojson(d.spark, path, lines=True)


@query("SELECT row, col, elevation FROM grid_cells", "grid_cells")
def read_csv(d):
    path = T.shared_path(d.spark, "csv")
    T.write_csv(d.grid_cells, path)
    return T.read_csv(d.spark, path, d.grid_cells.schema)


@query(SPLITS_SQL, "incidents", "boundary_vertices")
def write_splits(d):
    path = T.shared_path(d.spark, "splits")
    T.write_splits(I.incident_splits(d.incidents, d.edges, SPLITS).where("split IS NOT NULL"), path)
    return d.spark.read.parquet(path).select("incident_id", "season", "split")


@query("SELECT row, col, elevation, CAST(NULL AS DOUBLE) AS twice FROM grid_cells UNION ALL SELECT row, col, NULL, elevation * 2 FROM grid_cells", "grid_cells")
def open_many(d):
    """Two folders, each with a column that the other one lacks."""
    a, b = T.shared_path(d.spark, "one"), T.shared_path(d.spark, "two")
    d.grid_cells.write.parquet(a)
    d.grid_cells.select("row", "col", (F.col("elevation") * 2).alias("twice")).write.parquet(b)
    return T.open_many(d.spark, [a, b]).select("row", "col", "elevation", "twice")


@query("SELECT 'a' AS name, row, col FROM grid_cells UNION ALL SELECT 'b', row, col FROM grid_cells WHERE elevation IS NOT NULL", "grid_cells")
def write_if_absent(d):
    """A set of two outputs, made once: the second call finds both complete and doesn't make them."""
    paths = {name: T.shared_path(d.spark, name) for name in ("a", "b")}
    T.write_if_absent(d.spark, paths, lambda: {"a": d.grid_cells.select("row", "col"), "b": d.land})
    got = T.write_if_absent(d.spark, paths, lambda: {name: d.land.limit(0) for name in paths})
    return got["a"].select(F.lit("a").alias("name"), "row", "col").union(got["b"].select(F.lit("b").alias("name"), "row", "col"))


@query(f"SELECT incident_id, concat('fires_', {SEASON}) AS name FROM incidents", "incidents")
def seasonal_name(d):
    return d.incidents.select("incident_id", G.seasonal_name(F.lit("fires"), G.season_of_month(F.month("call_date"))).alias("name"))


# --- resampling across projections and cell sizes, tiles with origins of their own, cropping ---

GREEN = f"green AS (SELECT {OBS_SEASON} AS season, row, col, avg(CAST({NDVI} AS DOUBLE)) AS value FROM dated WHERE month(obs_date) BETWEEN 3 AND 11 AND year(obs_date) BETWEEN 1995 AND 1999 GROUP BY 1, 2, 3)"
#: The land's centres as degrees, in ``spot``.
SPOTS = f"places AS (SELECT row, col, 550000.0 + (col + 0.5) * 30 AS easting, 220000.0 - (row + 0.5) * 30 AS northing FROM grid_cells WHERE elevation IS NOT NULL), {degrees_sql('places', 'spot')}"
DEGREES, SINUSOIDAL = (0.1765, 51.8585, 0.002), (12100.0, 5766450.0, 231.65)
SPHERE_X, SPHERE_Y = f"{Z.SPHERE!r} * radians(lon) * cos(radians(lat))", f"{Z.SPHERE!r} * radians(lat)"


def centres_sql(x: str, y: str, corner: tuple[float, float, float]) -> str:
    """CTE: the places of ``spot`` that are on the vegetation's grid, as cells from the centre of its first one."""
    x0, y0, res = corner
    return f"""at_ AS (SELECT * FROM (SELECT row, col, ({x} - {x0!r}::DOUBLE) / {res!r}::DOUBLE - 0.5 AS fx, ({y0!r}::DOUBLE - {y}) / {res!r}::DOUBLE - 0.5 AS fy FROM spot)
        WHERE fx >= -0.5 AND fx < 9.5 AND fy >= -0.5 AND fy < (SELECT max(row) + 0.5 FROM ndvi_obs))"""


FOUR = "four AS (SELECT row, col, CAST(floor(fy) AS INT) + a AS sr, CAST(floor(fx) AS INT) + b AS sc, abs(1 - a - (fy - floor(fy))) * abs(1 - b - (fx - floor(fx))) AS w FROM at_, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS o(a, b))"
MEANS = "SELECT season, f.row, f.col, round(sum(w * value) / sum(w), 6) AS value FROM four f JOIN green g ON g.row = sr AND g.col = sc WHERE value IS NOT NULL AND w > 1e-9 GROUP BY ALL"


def vegetation_at(d, corner: tuple[float, float, float], system: str, kernel: str = "bilinear") -> DataFrame:
    """Seasonal vegetation of composites in a coordinate system of their own, at the land."""
    x0, y0, res = corner
    source = G.Grid(x0, y0, res, source_grid_of(d.ndvi_obs).height, 10)
    mean = S.mean_ndvi(I.training_window(S.dated(d.ndvi_obs), TRAIN, ALL3), ("season", "row", "col"))
    return rounded(R.align_to_reference(mean, source, d.land, d.grid, ("season",), system=system, kernel=kernel), "value")


@query(f"{NDVI_DATED}, {GREEN}, {SPOTS}, {centres_sql('lon', 'lat', DEGREES)}, {FOUR} {MEANS}", "grid_cells", "ndvi_obs")
def align_from_degrees(d):
    return vegetation_at(d, DEGREES, "degrees")


@query(f"{NDVI_DATED}, {GREEN}, {SPOTS}, {centres_sql(SPHERE_X, SPHERE_Y, SINUSOIDAL)}, {FOUR} {MEANS}", "grid_cells", "ndvi_obs")
def align_from_sinusoidal(d):
    return vegetation_at(d, SINUSOIDAL, "sinusoidal")


@query(f"""{NDVI_DATED}, {GREEN}, {SPOTS}, {centres_sql(SPHERE_X, SPHERE_Y, SINUSOIDAL)}
    SELECT season, a.row, a.col, round(value, 6) AS value FROM at_ a JOIN green g ON g.row = floor(fy + 0.5) AND g.col = floor(fx + 0.5) WHERE value IS NOT NULL""", "grid_cells", "ndvi_obs")
def resample_nearest(d):
    return vegetation_at(d, SINUSOIDAL, "sinusoidal", "nearest")


def coarser(d, kernel: str) -> DataFrame:
    """Elevation at a fourth of its resolution."""
    g = d.grid
    coarse = G.Grid(g.x0, g.y0, 4 * g.res, g.height // 4, g.width // 4)
    return rounded(R.align_to_reference(d.grid_cells, g, coarse.cells(d.spark), coarse, value="elevation", kernel=kernel), "elevation")


@query(f"SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, round(avg(elevation), 6) AS elevation FROM grid_cells WHERE row // 4 < {HEIGHT} // 4 AND col < 48 GROUP BY 1, 2 HAVING count(elevation) > 0", "grid_cells")
def resample_average(d):
    """The mean by area of 16 cells each."""
    return coarser(d, "average")


@query(f"""coarse AS (SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, 4 * r + 2.0 AS fy, 4 * c + 2.0 AS fx FROM range(0, {HEIGHT} // 4) a(r), range(0, 12) b(c)),
    w AS (SELECT coarse.row, coarse.col, elevation, (1 - abs(g.row + 0.5 - fy) / 4) * (1 - abs(g.col + 0.5 - fx) / 4) AS w FROM coarse JOIN grid_cells g ON abs(g.row + 0.5 - fy) < 4 AND abs(g.col + 0.5 - fx) < 4 WHERE elevation IS NOT NULL)
    SELECT row, col, round(sum(w * elevation) / sum(w), 6) AS elevation FROM w GROUP BY 1, 2""", "grid_cells")
def resample_triangle(d):
    """Bilinear weights whose support grows with the cell size: 64 cells each."""
    return coarser(d, "triangle")


#: Five overlapping tiles, each counted from its own corner.
OWN_TILES = """SELECT CAST(p_partkey % 5 AS INT) AS tile, CAST(floor(p_partkey / 200.0) AS INT) AS row, CAST(floor(p_partkey / 5.0) AS INT) % 40 AS col,
    CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS value FROM part"""
CORNERS = [(k, 5 - k, 0.5 + c / 3600, 51.9 - r / 3600) for k, (c, r) in enumerate([(20, 3), (0, 0), (35, 1), (50, 6), (12, 9)])]


def own_tiles(d) -> tuple[DataFrame, DataFrame]:
    """Tiles and their catalogue; heights follow the table."""
    tiles = d.spark.sql(OWN_TILES.replace("FROM part", f"FROM parquet.`{d.dir}/part.parquet`"))
    names = d.spark.createDataFrame([(k, o, x, y, 1 / 3600, 40) for k, o, x, y in CORNERS], "tile int, tile_order int, x0 double, y0 double, res double, width int")
    return tiles, names.join(tiles.groupBy("tile").agg((F.max("row") + 1).alias("height")), "tile")


@query(f"""tiles AS ({OWN_TILES}), corners(tile, tile_order, x0, y0) AS (VALUES {", ".join(f"({k}, {o}, {x!r}::DOUBLE, {y!r}::DOUBLE)" for k, o, x, y in CORNERS)}),
    spots AS (SELECT CAST(round((51.9 - (y0 - (row + 0.5) / 3600)) * 3600 - 0.5) AS INT) AS row, CAST(round((x0 + (col + 0.5) / 3600 - 0.5) * 3600 - 0.5) AS INT) AS col, tile_order, value FROM tiles JOIN corners USING (tile))
    SELECT row, col, arg_min(value, tile_order) AS value FROM spots WHERE value IS NOT NULL GROUP BY 1, 2""", "part")
def mosaic_own_origins(d):
    """The lattice of all tiles, by their corners; where tiles overlap the first in order with data counts."""
    return R.mosaic_tiles(Z.place_tiles(*own_tiles(d))[0])


@query(f"""centres AS (SELECT row, col, elevation, 550000.0 + (col + 0.5) * 30 AS x, 220000.0 - (row + 0.5) * 30 AS y FROM grid_cells WHERE elevation IS NOT NULL), {inside_sql("centres", "x", "y", "hit")},
    ends AS (SELECT greatest(0, floor((220000.0 - max(y)) / 30)) AS r0, least({HEIGHT}, ceil((220000.0 - min(y)) / 30)) AS r1, greatest(0, floor((min(x) - 550000.0) / 30)) AS c0, least(50, ceil((max(x) - 550000.0) / 30)) AS c1 FROM boundary_vertices)
    SELECT CAST(row - r0 AS INT) AS row, CAST(col - c0 AS INT) AS col, elevation, CAST(550000.0 + c0 * 30 AS DOUBLE) AS x0, CAST(220000.0 - r0 * 30 AS DOUBLE) AS y0, CAST(r1 - r0 AS INT) AS height, CAST(c1 - c0 AS INT) AS width FROM hit, ends""", "grid_cells", "boundary_vertices")
def crop_to_boundary(d):
    """The cells inside the boundary on the part of the grid that the boundary's extent touches, with that grid."""
    cells, g = V.crop_to_boundary(d.grid_cells.where("elevation IS NOT NULL"), d.grid, d.edges)
    return cells.select("row", "col", "elevation", F.lit(g.x0).alias("x0"), F.lit(g.y0).alias("y0"), F.lit(g.height).alias("height"), F.lit(g.width).alias("width"))


# --- files: pruned by name, combined by coordinates, missing ---

MONTH = "CAST(date_trunc('month', obs_date) AS DATE)"


@query(f"""{NDVI_DATED}, m AS (SELECT *, {MONTH} AS first_day FROM dated) SELECT concat('doy', year(first_day), lpad(CAST(dayofyear(first_day) AS VARCHAR), 3, '0')) AS month_file, count(*) AS n, CAST(sum(dn) AS BIGINT) AS total
    FROM m WHERE month(first_day) IN (6, 7, 8) AND year(first_day) BETWEEN 1995 AND 1999 GROUP BY 1""", "ndvi_obs")
def read_dated_files(d):
    """Vegetation in a folder for each month, read again for the summers of the training years: other files aren't opened."""
    path = T.shared_path(d.spark, "composites")
    first = F.trunc("obs_date", "month")
    monthly = S.dated(d.ndvi_obs).withColumn("month_file", F.concat(F.lit("doy"), F.year(first), F.lpad(F.dayofyear(first).cast("string"), 3, "0")))
    monthly.select("row", "col", "dn", F.col("month_file").alias("name"), "month_file").repartition("month_file").write.partitionBy("month_file").parquet(path)
    got = E.read_dated(d.spark, path, "row int, col int, dn int, name string", TRAIN, ["SUMMER"], dated="path")
    return got.groupBy(F.col("name").alias("month_file")).agg(F.count(F.lit(1)).alias("n"), F.sum("dn").alias("total"))


def daily(d) -> DataFrame:
    return d.climate_obs.groupBy("var", "obs_date", "row", "col").agg(F.round(F.avg("value"), 6).alias("value"))


@query("SELECT var, obs_date, row, col, round(avg(value), 6) AS value FROM climate_obs GROUP BY 1, 2, 3, 4", "climate_obs")
def combine_by_coords(d):
    """Two files whose dates overlap by three years, as one."""
    both = daily(d).where("obs_date < '1997-07-01'").withColumn("file", F.lit("a")).union(daily(d).where("obs_date >= '1994-07-01'").withColumn("file", F.lit("b")))
    return E.combine_by_coords(T.written(both, "climate"), ["obs_date", "row", "col"], by=("var",))


YEARLY = "yearly AS (SELECT var, CAST(year(obs_date + 45 * (row % 3)) AS INT) AS file, obs_date FROM climate_obs)"


@query(f"""{YEARLY}, ranges AS (SELECT var, file, min(obs_date) AS a, max(obs_date) AS b FROM yearly GROUP BY 1, 2)
    SELECT x.var, x.file AS a, y.file AS b FROM ranges x JOIN ranges y ON x.var = y.var AND x.file < y.file AND x.a <= y.b AND y.a <= x.b""", "climate_obs")
def overlapping_files(d):
    """Yearly files that take some weeks of the year before."""
    yearly = d.climate_obs.select("var", F.year(F.date_add("obs_date", 45 * (F.col("row") % 3))).alias("file"), "obs_date")
    return E.overlapping_files(E.coordinate_ranges(yearly, ["obs_date"], ("var",)), ["obs_date"], ("var",))


@query("SELECT 'cells' AS name, count(elevation) > 0 AS ok, CASE WHEN count(elevation) > 0 THEN 'ok' ELSE 'all cells are missing' END AS message FROM grid_cells UNION ALL SELECT x, false, 'missing path' FROM (VALUES ('raster'), ('vector'), ('table')) t(x)", "grid_cells")
def checked_paths(d):
    """A table that is there, and for each kind of check one that isn't."""
    path = T.shared_path(d.spark, "cells")
    d.grid_cells.write.parquet(path)
    read = lambda s, p: s.read.parquet(p)
    checks = {"raster": P.validate_raster, "vector": P.validate_vector, "table": P.validate_table}
    rows = [E.checked_path(d.spark, path, read, lambda df: P.validate_raster(df, "elevation")).select(F.lit("cells").alias("name"), "ok", "message")]
    rows += [E.checked_path(d.spark, f"{path}-none", read, check).select(F.lit(name).alias("name"), "ok", F.substring_index("message", ":", 1).alias("message")) for name, check in checks.items()]
    return reduce(DataFrame.union, rows)


# --- parts of the activity layer, and the branches of the composite jobs ---

PRESENT = ACTIVITY.replace("fclass IN ('household', 'machinery')", "fclass IN ('household', 'machinery', 'building')")


@query(f"""RECURSIVE {PRESENT}, reach AS (SELECT row, col, row * 50 + col AS part FROM activity UNION
    SELECT a.row, a.col, least(r.part, a.row * 50 + a.col) FROM reach r JOIN activity a ON abs(a.row - r.row) + abs(a.col - r.col) = 1 WHERE r.part < a.row * 50 + a.col)
    SELECT row, col, CAST(min(part) AS BIGINT) AS part FROM reach GROUP BY 1, 2""", "grid_cells", "landuse_boxes")
def activity_parts(d):
    """Land use and buildings dissolved into connected parts."""
    boxes = V.box_edges(d.landuse_boxes.where(F.col("fclass").isin(*FCLASSES, "building")), ("feature_id",))
    return W.connected_parts(V.rasterize_polygons(boxes, d.grid, "feature_id"), d.grid)


@query(f"""{LAND}, p AS (SELECT easting, northing, vehicles AS w FROM incidents WHERE month(call_date) IN (3, 4, 5) AND year(call_date) BETWEEN 1995 AND 1999),
    d AS (SELECT row, col, sum(w * exp(-((550000.0 + (col + 0.5) * 30 - easting) ** 2 + (220000.0 - (row + 0.5) * 30 - northing) ** 2) / 500000.0)) / ((SELECT sum(w) FROM p) * {2 * math.pi * 250000!r}) AS density FROM land, p GROUP BY 1, 2)
    SELECT row, col, round(density * 1e9, 4) AS density FROM d""", *BOTH)
def kde_weighted(d):
    """Kernel density of the default bandwidth, each incident counted by its vehicles."""
    out = D.kde_density(spring_train(d), d.land, d.grid, weight="vehicles")
    return out.select("row", "col", F.round(F.col("density") * 1e9, 4).alias("density"))


def plain_dataset_sql() -> str:
    """The dataset without clipping, seasonal vegetation and distance to incidents."""
    whole = dataset_sql().replace(INSIDE, f"{EDGES}, {LAND}").replace(NDVI_IN, f"mean_all AS (SELECT row, col, avg(CAST({NDVI} AS DOUBLE)) AS value FROM ndvi_obs GROUP BY 1, 2), {bilinear_sql('mean_all', '0 AS every', 'greened').replace('GROUP BY ALL', 'GROUP BY n.row, n.col')}")
    whole = whole.replace("LEFT JOIN greened ON greened.season = x.season AND greened.row", "LEFT JOIN greened ON greened.row")
    return whole.replace("CAST(fires.km AS FLOAT) AS d_fires, ", "")


@query(plain_dataset_sql(), *ALL)
def dataset_unclipped(d):
    """All land, one vegetation layer for all seasons, and nothing of the incidents among the features."""
    s, c = sources(d)
    return L.assemble_dataset(s, replace(c, clip=False, seasonal_ndvi=False, d_fires=False))
