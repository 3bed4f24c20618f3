"""Reading and writing the tables of the jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import to_bng

#: Columns of the incident file.
INCIDENT_COLUMNS = {"CallDateID": "call_date", "IncidentEasting": "easting", "IncidentNorthing": "northing", "NumberVehiclesDeployed": "vehicles"}
INCIDENTS = T.StructType().add("CallDateID", "string").add("IncidentEasting", "double").add("IncidentNorthing", "double").add("NumberVehiclesDeployed", "integer")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, the folder that driver and executors share.

    Without that setting a temporary folder stands in where Spark is one process; a cluster raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables of ``written``, for each ``scratch_tables`` that is open.
OWNED: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Owns the tables that jobs write inside, and deletes them at the end; so results are to be written or collected inside."""
    mine: list[str] = []
    OWNED.append(mine)
    try:
        yield
    finally:
        OWNED[:] = [paths for paths in OWNED if paths is not mine]
        for path in mine:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what reads it doesn't run its plan again. ``scratch_tables`` deletes it."""
    path = shared_path(df.sparkSession, name)
    if OWNED:
        OWNED[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``df`` as a table of ``written``, and aggregates of its rows, which the job that writes it finds by the way.

    A task that Spark runs again may count its rows twice, so use them as guards, not as results.
    """
    seen = Observation()
    table = written(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return table, seen.get


def read_incidents(spark: SparkSession, path: str, fmt: str = "dd/MM/yyyy") -> DataFrame:
    """The configured columns of an incident file, whatever others it has; a malformed date raises when it is read."""
    raw = spark.read.option("header", True).csv(path)
    typed = [F.col(f.name).cast(f.dataType).alias(INCIDENT_COLUMNS[f.name]) for f in INCIDENTS]
    return raw.select(*typed).withColumn("call_date", F.to_date("call_date", fmt))


def read_cells(spark: SparkSession, path: str, layer: str | None = None, value: str = "value") -> DataFrame:
    """A cell table; NaN becomes null. A named layer prunes to its partition."""
    df = spark.read.parquet(path)
    df = df.where(F.col("layer") == layer) if layer else df
    return df.withColumn(value, F.when(~F.isnan(value), F.col(value)))


def write_cells(cells: DataFrame, path: str, compression: str = "zstd", mode: str = "errorifexists") -> None:
    """Values go to 32 bits here, and only here; one partition folder a layer."""
    cells.withColumn("value", F.col("value").cast("float")).write.mode(mode).option("compression", compression).partitionBy("layer").parquet(path)


def read_layer(spark: SparkSession, path: str, layer: str, column: str | None = None, values: list[str] | None = None, degrees: bool = False) -> DataFrame:
    """The vertices (``x``, ``y``) of a layer of a vertex table; ``degrees``: they are WGS84 and go to the national grid."""
    df = spark.read.parquet(path).where(F.col("layer") == layer)
    df = df.where(F.col(column).isin(values)) if column else df
    return to_bng(df, "x", "y").drop("x", "y").withColumnsRenamed({"easting": "x", "northing": "y"}) if degrees else df


def open_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files as one table; columns that some lack are null there."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def _rings(kind: Column, text: Column) -> Column:
    """Coordinates as parts of rings of positions, whatever the type: each point or line of a collection is a part of one ring."""
    read = lambda depth: F.from_json(text, "array<" * (depth + 1) + "double" + ">" * (depth + 1))
    out = F.when(kind == "Point", F.array(F.array(F.array(read(0)))))
    out = out.when(kind == "MultiPoint", F.transform(read(1), lambda p: F.array(F.array(p)))).when(kind == "LineString", F.array(F.array(read(1))))
    out = out.when(kind == "MultiLineString", F.transform(read(2), lambda line: F.array(line))).when(kind == "Polygon", F.array(read(2)))
    return out.when(kind == "MultiPolygon", read(3))


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(``feature_id``, ``name``, ``kind``, ``part``, ``ring``, ``seq``, ``x``, ``y``): vertices of GeoJSON documents, one a file.

    ``lines``: one feature a line, as ``write_geojson`` has it; such files are split among tasks. Features without a
    geometry, and collections of geometries of several types, give nothing.
    """
    feature = "struct<id: string, type: string, properties: map<string,string>, geometry: struct<type: string, coordinates: string>>"
    raw = spark.read.schema(f"type string, id string, properties map<string,string>, geometry struct<type: string, coordinates: string>, features array<{feature}>").option("multiLine", not lines).json(path)
    own = F.array(F.struct("id", "type", "properties", "geometry"))
    each = raw.select(F.posexplode(F.when(F.col("type") == "FeatureCollection", F.col("features")).otherwise(own)).alias("at", "f"))
    doc = each.select(F.coalesce(F.try_element_at("f.properties", F.lit("feature_id")), "f.id", F.col("at").cast("string")).alias("feature_id"), F.try_element_at("f.properties", F.lit("name")).alias("name"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    parts = doc.select("feature_id", "name", "kind", F.posexplode(_rings(F.col("kind"), F.col("c"))).alias("part", "p"))
    rings = parts.select("feature_id", "name", "kind", "part", F.posexplode("p").alias("ring", "r"))
    return rings.select("feature_id", "name", "kind", "part", "ring", F.posexplode("r").alias("seq", "v")).select("feature_id", "name", "kind", "part", "ring", "seq", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


def write_geojson(vertices: DataFrame, path: str) -> None:
    """One feature a line; parts and rings of a feature are grouped, never more than one feature in a row.

    ``kind`` (Polygon if there is none) and ``part`` (0) may be left out.
    """
    v = vertices.withColumns({c: F.lit(x) for c, x in (("kind", "Polygon"), ("part", 0), ("name", None), ("ring", 0)) if c not in vertices.columns})
    key = ["feature_id", "name", "kind"]
    rings = v.groupBy(*key, "part", "ring").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("c"))
    parts = rings.groupBy(*key, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "c"))), lambda r: r["c"]).alias("c"))
    all_ = parts.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "c"))), lambda r: r["c"]).alias("c"))
    c = F.col("c")
    nested = {"Point": c[0][0][0], "MultiPoint": F.transform(c, lambda p: p[0][0]), "LineString": c[0][0], "MultiLineString": F.transform(c, lambda p: p[0]), "Polygon": c[0], "MultiPolygon": c}
    text = F.lit(None).cast("string")
    for kind, coordinates in nested.items():
        text = F.when(F.col("kind") == kind, F.to_json(coordinates)).otherwise(text)
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("feature_id").cast("string").alias("feature_id"), "name").alias("properties")))
    line = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"geometry":{"type":"'), "kind", F.lit('","coordinates":'), text, F.lit("}}"))
    all_.select(line.alias("value")).write.text(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder for each season and split."""
    df.write.mode(mode).partitionBy("season", "split").parquet(path)


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished output is at the path, in any store that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_if_absent(spark: SparkSession, paths: str | dict[str, str], make: Callable, force: bool = False) -> DataFrame | dict[str, DataFrame]:
    """The output at the path, or the outputs at the paths of a set by name.

    ``make()`` is called and written unless all of them are complete already, or if ``force``; for a set it returns the
    tables by name. An empty set is never complete.
    """
    several = isinstance(paths, dict)
    at = paths if several else {"": paths}
    if force or not at or not all(complete(spark, p) for p in at.values()):
        made = make() if several else {"": make()}
        for name, path in at.items():
            made[name].write.mode("overwrite").parquet(path)
    out = {name: spark.read.parquet(p) for name, p in at.items()}
    return out if several else out[""]
