"""The sample tables seen as the jobs' inputs: one SQL text for each view, read alike by Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .functions.grid import Grid

VIEWS = {
    "grid_cells": """SELECT CAST(floor(p_partkey / 50.0) AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col,
        CASE WHEN p_type = 'ECONOMY' AND p_size > 40 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS elevation FROM part""",
    "incidents": """SELECT o_orderkey AS incident_id, CAST(o_orderdate AS DATE) AS call_date,
        550000.0 - 60.0 + CAST((o_orderkey * 7919 + o_custkey * 31) % 6600 AS DOUBLE) / 10.0 + 0.05 AS easting,
        220000.0 + 60.0 - CAST((o_orderkey * 104729 + o_custkey * 17) % 6600 AS DOUBLE) / 10.0 - 0.05 AS northing,
        CAST(1 + o_custkey % 5 AS INT) AS vehicles FROM orders""",
    "climate_obs": """SELECT CASE l_returnflag WHEN 'A' THEN 'tas' WHEN 'N' THEN 'rainfall' ELSE 'hurs' END AS var, CAST(l_shipdate AS DATE) AS obs_date,
        CAST(floor(l_suppkey / 10.0) AS INT) AS row, CAST(l_suppkey % 10 AS INT) AS col, CASE WHEN l_discount = 0.0 THEN NULL ELSE l_quantity END AS value FROM lineitem""",
    "ndvi_obs": """SELECT concat('MOD13Q1_NDVI_doy', CAST(year(l_shipdate) AS STRING), lpad(CAST(dayofyear(l_shipdate) AS STRING), 3, '0'), '_aid0001.tif') AS file,
        CAST(floor(l_suppkey / 10.0) AS INT) AS row, CAST(l_suppkey % 10 AS INT) AS col, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 16000 - 3000 AS INT) AS dn FROM lineitem""",
    "road_segments": """SELECT s_suppkey AS feature_id,
        550000.0 + CAST((s_suppkey * 389) % 1500 AS DOUBLE) + 0.5 AS x1, 220000.0 - CAST((s_suppkey * 211) % 1200 AS DOUBLE) - 0.5 AS y1,
        550000.0 + CAST((s_suppkey * 389 + 97) % 1500 AS DOUBLE) + 0.5 AS x2, 220000.0 - CAST((s_suppkey * 211 + 53) % 1200 AS DOUBLE) - 0.5 AS y2 FROM supplier WHERE s_suppkey % 10 = 0""",
    "river_segments": """SELECT s_suppkey AS feature_id,
        550000.0 + CAST((s_suppkey * 577) % 1500 AS DOUBLE) + 0.5 AS x1, 220000.0 - CAST((s_suppkey * 131) % 1200 AS DOUBLE) - 0.5 AS y1,
        550000.0 + CAST((s_suppkey * 577 + 143) % 1500 AS DOUBLE) + 0.5 AS x2, 220000.0 - CAST((s_suppkey * 131 + 71) % 1200 AS DOUBLE) - 0.5 AS y2 FROM supplier WHERE s_suppkey % 10 = 5""",
    "repeated_incidents": """SELECT CAST(o_orderdate AS DATE) AS call_date,
        550000.0 - 60.0 + CAST((o_orderkey * 7919 + o_custkey * 31) % 6600 AS DOUBLE) / 10.0 + 0.05 AS easting,
        220000.0 + 60.0 - CAST((o_orderkey * 104729 + o_custkey * 17) % 6600 AS DOUBLE) / 10.0 - 0.05 AS northing,
        CAST(1 + o_custkey % 5 AS INT) AS vehicles FROM orders CROSS JOIN (VALUES (1), (2), (3), (4)) AS k(n) WHERE n <= 1 + o_orderkey % 4""",
    "regions": """SELECT n_name AS name, 0 AS ring, seq, 540000.0 + 900.0 * n_nationkey + dx AS x, 210000.0 + 300.0 * n_regionkey + dy AS y
        FROM nation CROSS JOIN (VALUES (0, 0.0, 0.0), (1, 850.0, 20.0), (2, 800.0, 650.0), (3, 30.0, 700.0)) AS k(seq, dx, dy)""",
    "dem_tiles": """SELECT CAST(p_partkey % 2 AS INT) AS tile_order, CAST(floor(p_partkey / 50.0) AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col,
        CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS value FROM part
        UNION ALL SELECT 5 AS tile_order, CAST(floor(p_partkey / 50.0) AS INT) AS row, CAST(p_partkey % 50 AS INT) AS col, 100.0 + CAST(p_size AS DOUBLE) AS value FROM part WHERE p_partkey % 3 > 0""",
    "landuse_boxes": """SELECT c_custkey AS feature_id, lower(c_mktsegment) AS fclass,
        550000.0 + CAST((c_custkey * 37) % 1450 AS DOUBLE) + 0.5 AS xmin, 220000.0 - CAST((c_custkey * 53) % 1150 AS DOUBLE) - 45.5 AS ymin,
        550000.0 + CAST((c_custkey * 37) % 1450 AS DOUBLE) + 45.5 AS xmax, 220000.0 - CAST((c_custkey * 53) % 1150 AS DOUBLE) - 0.5 AS ymax FROM customer WHERE c_custkey % 50 = 0""",
    "boundary_vertices": """SELECT 'Essex' AS name, 0 AS ring, seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM
        (VALUES (0, 550010.0, 219990.0), (1, 551400.0, 219950.0), (2, 551480.0, 219100.0), (3, 550700.0, 219400.0), (4, 550020.0, 218850.0)) AS t(seq, x, y)""",
}
TABLES = re.compile(r"\bFROM (part|orders|lineitem|supplier|customer|nation)\b")

TRAIN, SPLITS = (1995, 2000), {"train": (1995, 2000), "val": (2000, 2001), "test": (2001, 9999)}
FCLASSES = ["household", "machinery"]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(TABLES.sub(lambda m: f"FROM parquet.`{sf_dir}/{m[1]}.parquet`", VIEWS[name]))


def grid_of(cells: DataFrame) -> Grid:
    """The sample grid; its height follows the table."""
    return Grid(550000.0, 220000.0, 30.0, (cells.selectExpr("max(row) + 1 AS h").first().h or 0), 50)


def tile_grid_of(tiles: DataFrame) -> Grid:
    """A grid of degrees, one second a cell."""
    return Grid(0.5, 51.9, 1 / 3600, (tiles.selectExpr("max(row) + 1 AS h").first().h or 0), 50)


def source_grid_of(obs: DataFrame) -> Grid:
    return Grid(550000.0, 220000.0, 150.0, (obs.selectExpr("max(row) + 1 AS h").first().h or 0), 10)


def with_views(*names: str) -> str:
    """WITH clause of the views; a table of its own name needs none."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names if n in VIEWS)
