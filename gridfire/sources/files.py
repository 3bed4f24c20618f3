"""Files as inputs: which ones to read, what they cover, and whether they are there."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.grid import composite_date, season_of_month
from .tables import written

#: The hidden columns of a file scan, which Spark knows before it opens a file.
NAME, PATH = "_metadata.file_name", "_metadata.file_path"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at the path, in any store that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(``file``, ``path``, ``bytes``) of the files under a folder and its folders; none is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", F.col("length").alias("bytes"))


def wanted_name(name: Column, years: tuple[int, int] | None, seasons: list[str] | None) -> Column:
    """Whether a file's dated name is in the half-open years and the seasons. Undated names are wanted, and without seasons all are."""
    if seasons is None:
        return F.lit(True)
    date = composite_date(name)
    fits = season_of_month(F.month(date)).isin(seasons)
    if years:
        fits = fits & (F.year(date) >= years[0]) & (F.year(date) < years[1])
    return date.isNull() | fits


def wanted_files(spark: SparkSession, path: str, years: tuple[int, int] | None, seasons: list[str] | None, pattern: str, dated: str = "file") -> DataFrame:
    """``list_files`` less those whose name (``dated`` "path": whose whole path) has a date that isn't wanted; a missing folder raises."""
    if not exists(spark, path):
        raise FileNotFoundError(f"missing path: {path}")
    return list_files(spark, path, pattern).where(wanted_name(F.col(dated), years, seasons))


def read_dated(spark: SparkSession, path: str, schema: T.StructType | str, years: tuple[int, int] | None = None, seasons: list[str] | None = None, pattern: str = "*.parquet", skip_unreadable: bool = False, dated: str = "file") -> DataFrame:
    """The rows of the wanted files under a folder and its folders, with their ``file``.

    The filter is on a name that Spark knows from listing, so files that aren't wanted are never opened; their names,
    which the driver has listed anyway, are looked up in a set. ``skip_unreadable`` leaves out files that can't be read,
    which ``unread_files`` names; otherwise they raise. No wanted file raises, as does a missing folder.
    """
    col = {"file": NAME, "path": PATH}[dated]
    names = [r[0] for r in wanted_files(spark, path, years, seasons, pattern, dated).select(dated).distinct().collect()]
    if not names:
        raise FileNotFoundError(f"no file under {path} matches {pattern}, years {years} and seasons {seasons}")
    read = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("ignoreCorruptFiles", skip_unreadable)
    return read.parquet(path).where(F.col(col).isin(names)).select("*", F.col(col).alias("file"))


def unread_files(spark: SparkSession, path: str, schema: T.StructType | str, years: tuple[int, int] | None = None, seasons: list[str] | None = None, pattern: str = "*.parquet", dated: str = "file") -> DataFrame:
    """(``file``, ``bytes``) of wanted files that gave no row: those that can't be read, and empty ones."""
    read = read_dated(spark, path, schema, years, seasons, pattern, True, dated).select(F.col("file").alias(dated)).distinct()
    return wanted_files(spark, path, years, seasons, pattern, dated).join(read, dated, "left_anti").select("file", "bytes")


# --- files combined by their coordinates ---


def coordinate_ranges(df: DataFrame, coords: list[str], by: tuple[str, ...] = (), source: str = "file") -> DataFrame:
    """(``by``, ``source``, and ``c_least``, ``c_most`` for each coordinate ``c``): what each file covers."""
    return df.groupBy(*by, source).agg(*[x for c in coords for x in (F.min(c).alias(f"{c}_least"), F.max(c).alias(f"{c}_most"))])


def overlapping_files(ranges: DataFrame, coords: list[str], by: tuple[str, ...] = (), source: str = "file") -> DataFrame:
    """(``by``, ``a``, ``b``): pairs of files whose ranges meet in all coordinates, ``a`` before ``b`` in name.

    ``ranges`` has a row for each file. Files are sorted along the first coordinate; where none begins before the ones
    before it end, it meets none of them. So only files in one such stretch are compared.
    """
    c = coords[0]
    w = Window.partitionBy(*by).orderBy(f"{c}_least", f"{c}_most", source)
    ended = F.max(f"{c}_most").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(ended.isNull() | (F.col(f"{c}_least") > ended), 1).otherwise(0)
    stretch = ranges.withColumn("new_", apart).withColumn("stretch_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")
    other = stretch.toDF(*[x if x in (*by, "stretch_") else f"{x}_2" for x in stretch.columns])
    meets = reduce(lambda x, y: x & y, [(F.col(f"{k}_least") <= F.col(f"{k}_most_2")) & (F.col(f"{k}_least_2") <= F.col(f"{k}_most")) for k in coords])
    pairs = stretch.join(other, [*by, "stretch_"]).where(meets & (F.col(source) < F.col(f"{source}_2")))
    return pairs.select(*by, F.col(source).alias("a"), F.col(f"{source}_2").alias("b"))


def combine_by_coords(df: DataFrame, coords: list[str], value: str = "value", by: tuple[str, ...] = (), source: str = "file", on_conflict: str = "raise") -> DataFrame:
    """(``by``, ``coords``, ``value``): the values of many files as one, each place once.

    Files may cover ranges that follow each other, leave gaps or overlap. Where several have a place, their known
    values must agree; missing ones give way. Values that differ raise an error that names the place and the files, or
    with ``on_conflict`` "first" the value of the file of the smallest name stays, or with "all" every value is
    returned with the ``source`` it is from. Rows with a null coordinate are places like any other.
    """
    keys = [*by, *coords]
    if on_conflict == "all":
        return conflicts(df, coords, value, by, source)
    if on_conflict == "raise":
        merged = df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("other_"), F.min_by(source, value).alias("a_"), F.max_by(source, value).alias("b_"))
        merged = written(merged, "combined")
        if differs := merged.where(F.col(value) != F.col("other_")).orderBy(*keys).limit(1).collect():
            r = differs[0]
            place = ", ".join(f"{k} {r[k]}" for k in keys)
            raise ValueError(f"values differ at {place}: {r[value]} in {r['a_']}, {r['other_']} in {r['b_']}")
        return merged.select(*keys, value)
    if on_conflict != "first":
        raise ValueError(f"unknown way with conflicts: {on_conflict}")
    first = F.min_by(value, F.when(F.col(value).isNotNull(), F.col(source)))
    return df.groupBy(*keys).agg(first.alias(value))


def conflicts(df: DataFrame, coords: list[str], value: str = "value", by: tuple[str, ...] = (), source: str = "file") -> DataFrame:
    """(``by``, ``coords``, ``value``, ``source``) of the places where files have different known values, each value with the smallest name."""
    keys = [*by, *coords]
    each = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(source).alias(source))
    several = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").drop("n_")
    on = reduce(lambda a, b: a & b, [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys])
    return each.alias("x").join(several.alias("y"), on, "left_semi").select(*keys, value, source)


# --- checks of paths that may be missing ---


def checked_path(spark: SparkSession, path: str, read: Callable[[SparkSession, str], DataFrame], check: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The row of ``check`` (``ok``, ``message`` first) for what is read from the path; it never raises.

    A missing path, and one that can't be read, is a row with ``ok`` false; other columns of the check are null there.
    """
    failed = lambda message: spark.createDataFrame([(False, message)], "ok boolean, message string")
    if not exists(spark, path):
        return failed(f"missing path: {path}")
    try:
        row = check(read(spark, path))
        got = row.collect()  # one row; reading is tried here
    except (AnalysisException, OSError, ValueError) as e:
        return failed(f"can't be read: {type(e).__name__}")
    except Exception as e:  # noqa: BLE001  what Spark raises for a file that isn't what its name says has no class of its own
        if "Py4J" not in type(e).__name__ and "pyspark" not in type(e).__module__:
            raise
        return failed(f"can't be read: {type(e).__name__}")
    return spark.createDataFrame(got, row.schema)
