"""Vector layers: polygon containment and rasterising, as equi-joins on tiles, scan lines and exploded cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid, point_to_cell
from .resample import crop_window, on_window

#: Edges, counted once for each tile that they are sent to, up to which tiles are broadcast; more are joined by a shuffle on the tile.
BROADCAST_EDGES = 100_000


def edges_of(vertices: DataFrame, by: tuple[str, ...] = ("name", "ring")) -> DataFrame:
    """(keys, ``x1``, ``y1``, ``x2``, ``y2``): each ring closed by an edge from its last vertex to its first."""
    w = Window.partitionBy(*by).orderBy("seq")
    first = lambda c: F.first(c).over(w)
    return vertices.select(*by, F.col("x").alias("x1"), F.col("y").alias("y1"), F.coalesce(F.lead("x").over(w), first("x")).alias("x2"), F.coalesce(F.lead("y").over(w), first("y")).alias("y2"))


def segments_of(vertices: DataFrame, by: tuple[str, ...] = ("feature_id", "part")) -> DataFrame:
    """(keys, ``x1``, ``y1``, ``x2``, ``y2``) of open lines; a line of one vertex gives nothing."""
    w = Window.partitionBy(*by).orderBy("seq")
    return vertices.select(*by, F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 IS NOT NULL")


def boundary_select(vertices: DataFrame, region: str, name: str = "name") -> DataFrame:
    return vertices.where(F.col(name) == region)


def drop_empty_geometry(features: DataFrame, geometry: str = "geom") -> DataFrame:
    return features.where(F.col(geometry).isNotNull() & (F.size(geometry) > 0))


def points_within_polygon(points: DataFrame, edges: DataFrame, x: str = "easting", y: str = "northing", name: str = "name", band: float = 64.0, reach: float = 4096.0) -> DataFrame:
    """Points strictly inside a polygon, one row for each point and polygon that holds it, with the polygon's ``name``.

    Even-odd rule: the edges that a ray to the right crosses are odd in number, so holes and parts need no care; points
    on an edge are out. A polygon's edges in a band of northings are one array, which goes to the tiles (``band`` high,
    ``reach`` wide) that the polygon covers; a point meets the arrays of its tile. Nothing is grouped by point, so rows
    alike in all columns stay as many as they are. Tiles are broadcast below a checked number of edges. Points with a
    missing coordinate are in no polygon.
    """
    bands = F.sequence(F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band))
    edge = F.struct("x1", "y1", "x2", "y2")
    banded = edges.select(name, edge.alias("e"), F.explode(bands).alias("band_")).groupBy(name, "band_").agg(
        F.collect_list("e").alias("edges_"), F.min(F.least("e.x1", "e.x2")).alias("a_"), F.max(F.greatest("e.x1", "e.x2")).alias("b_")
    )
    tiles = banded.select(name, "band_", "edges_", F.explode(F.sequence(F.floor(F.col("a_") / reach), F.floor(F.col("b_") / reach))).alias("tile_"))
    few = (tiles.agg(F.sum(F.size("edges_"))).first()[0] or 0) <= BROADCAST_EDGES
    px, py = F.col(x), F.col(y)
    placed = points.withColumns({"band_": F.floor(py / band), "tile_": F.floor(px / reach)})

    def side(e: Column) -> Column:
        return (e["x2"] - e["x1"]) * (py - e["y1"]) - (e["y2"] - e["y1"]) * (px - e["x1"])

    def on_edge(e: Column) -> Column:
        return (side(e) == 0) & px.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & py.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    def crosses(e: Column) -> Column:
        return ((e["y1"] > py) != (e["y2"] > py)) & ((side(e) > 0) == (e["y2"] > e["y1"]))

    joined = placed.join(F.broadcast(tiles) if few else tiles, ["band_", "tile_"])
    odd = F.aggregate("edges_", F.lit(False), lambda acc, e: acc != crosses(e))
    return joined.where(odd & ~F.exists("edges_", on_edge)).select(*[F.col(f"`{c}`") for c in points.columns], name)


def cells_inside(edges: DataFrame, grid: Grid, name: str = "name", by: tuple[str, ...] = ()) -> DataFrame:
    """(``name``, ``by``, ``row``, ``col``) of the cells whose centre is strictly inside a polygon.

    Scan lines: the edges that cross a row's centre line are sorted by where they do, and the columns between the first
    and second, third and fourth and so on are listed. So the work is that of the edges' rows and the cells filled.
    """
    at = lambda v: (F.lit(grid.y0) - v) / grid.res - 0.5  # the row whose centre is there
    top = F.greatest(F.lit(0), F.ceil(at(F.greatest("y1", "y2")))).cast("int")
    bottom = F.least(F.lit(grid.height - 1), F.floor(at(F.least("y1", "y2")))).cast("int")
    rows = edges.where("y1 <> y2").withColumns({"a_": top, "b_": bottom}).where("a_ <= b_").withColumn("row", F.explode(F.sequence("a_", "b_")))
    yc = F.lit(grid.y0) - (F.col("row") + 0.5) * grid.res
    crossing = rows.where((F.col("y1") > yc) != (F.col("y2") > yc)).select(name, *by, "row", (F.col("x1") + (yc - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x_"))
    lines = crossing.groupBy(name, *by, "row").agg(F.sort_array(F.collect_list("x_")).alias("x_"))
    col = lambda v: (v - grid.x0) / grid.res - 0.5
    pair = lambda k: F.struct(
        F.greatest(F.lit(0), F.floor(col(F.get("x_", 2 * k))) + 1).cast("int").alias("l"), F.least(F.lit(grid.width - 1), F.ceil(col(F.get("x_", 2 * k + 1))) - 1).cast("int").alias("r")
    )
    runs = lines.select(name, *by, "row", F.explode(F.filter(F.transform(F.sequence(F.lit(0), (F.size("x_") / 2).cast("int") - 1), pair), lambda p: p["l"] <= p["r"])).alias("p"))
    inside = runs.select(name, *by, "row", F.explode(F.sequence("p.l", "p.r")).alias("col"))
    # centres on a level edge or on a vertex are on the outline
    left, right = F.greatest(F.lit(0), F.ceil(col(F.least("x1", "x2")))).cast("int"), F.least(F.lit(grid.width - 1), F.floor(col(F.greatest("x1", "x2")))).cast("int")
    on_line = edges.where(at(F.col("y1")) == F.floor(at(F.col("y1")))).select(name, *by, at(F.col("y1")).cast("int").alias("row"), *(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    vertex = on_line.where(col(F.col("x1")) == F.floor(col(F.col("x1")))).select(name, *by, "row", col(F.col("x1")).cast("int").alias("l_"), col(F.col("x1")).cast("int").alias("r_"))
    level = on_line.where("y1 = y2").select(name, *by, "row", left.alias("l_"), right.alias("r_")).where("l_ <= r_").union(vertex)
    return inside.join(level.select(name, *by, "row", F.explode(F.sequence("l_", "r_")).alias("col")), [name, *by, "row", "col"], "left_anti")


def clip_cells_to_boundary(cells: DataFrame, grid: Grid, edges: DataFrame, name: str = "name") -> DataFrame:
    """Cells whose centre is inside the boundary."""
    return cells.join(cells_inside(edges, grid, name).select("row", "col"), ["row", "col"], "left_semi")


def crop_to_boundary(cells: DataFrame, grid: Grid, edges: DataFrame, name: str = "name") -> tuple[DataFrame, Grid]:
    """Cells whose centre is inside the boundary, and the grid that is left: the part that the boundary's extent touches.

    ``row`` and ``col`` are counted from the new grid's corner. A boundary off the grid raises.
    """
    window = crop_window(edges, grid)
    if window is None:
        raise ValueError("the boundary is off the grid")
    return on_window(clip_cells_to_boundary(cells, grid, edges, name), grid, window), window


def rasterize_points(points: DataFrame, grid: Grid, by: tuple[str, ...] = ()) -> DataFrame:
    return point_to_cell(points, grid).select(*by, "row", "col").distinct()


def rasterize_lines(segments: DataFrame, grid: Grid, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells that a segment touches: for each row of cells, the columns between the segment's ends in that row.

    Segments are cut to the grid's rows and columns before cells are listed, and cells are made distinct afterwards.
    """
    s = segments.select(*by, "x1", "y1", "x2", "y2")
    ya, yb = F.least("y1", "y2"), F.greatest("y1", "y2")
    top = F.greatest(F.lit(0), F.floor((F.lit(grid.y0) - yb) / grid.res)).cast("int")
    bottom = F.least(F.lit(grid.height - 1), F.floor((F.lit(grid.y0) - ya) / grid.res)).cast("int")
    rows = s.withColumns({"a_": top, "b_": bottom}).where("a_ <= b_").withColumn("row", F.explode(F.sequence("a_", "b_")))
    high, low = F.least(yb, F.lit(grid.y0) - F.col("row") * grid.res), F.greatest(ya, F.lit(grid.y0) - (F.col("row") + 1) * grid.res)
    at = lambda yy: F.col("x1") + F.try_divide((yy - F.col("y1")) * (F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))
    xa = F.when(F.col("y1") == F.col("y2"), F.least("x1", "x2")).otherwise(F.least(at(high), at(low)))
    xb = F.when(F.col("y1") == F.col("y2"), F.greatest("x1", "x2")).otherwise(F.greatest(at(high), at(low)))
    left = F.greatest(F.lit(0), F.floor((xa - grid.x0) / grid.res)).cast("int")
    right = F.least(F.lit(grid.width - 1), F.floor((xb - grid.x0) / grid.res)).cast("int")
    cols = rows.withColumns({"l_": left, "r_": right}).where("l_ <= r_")
    return cols.select(*by, "row", F.explode(F.sequence("l_", "r_")).alias("col")).distinct()


def box_edges(boxes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The four edges of each box (``xmin``, ``ymin``, ``xmax``, ``ymax``)."""
    e = lambda a, b, c, d: F.struct(F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(d).alias("y2"))
    four = F.array(e("xmin", "ymin", "xmax", "ymin"), e("xmax", "ymin", "xmax", "ymax"), e("xmax", "ymax", "xmin", "ymax"), e("xmin", "ymax", "xmin", "ymin"))
    return boxes.select(*by, F.explode(four).alias("e")).select(*by, "e.*")


def rasterize_polygons(edges: DataFrame, grid: Grid, name: str = "name", by: tuple[str, ...] = ()) -> DataFrame:
    """Cells touched by a polygon: those that an edge touches, and those with their centre inside."""
    return rasterize_lines(edges, grid, by).union(cells_inside(edges, grid, name, by).select(*by, "row", "col")).distinct()


def human_activity_layer(landuse_edges: DataFrame, building_edges: DataFrame, grid: Grid, name: str = "feature_id") -> DataFrame:
    """Presence of land use or buildings: the touched cells of a union are the union of the touched cells, so nothing is dissolved."""
    cells = lambda e: rasterize_polygons(e, grid, name)
    return cells(landuse_edges).union(cells(building_edges)).distinct()
