"""Incidents: dates, seasons, splits and yearly profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import in_season, season_of_month, split_of_year
from .vector import points_within_polygon


def parse_call_date(df: DataFrame, col: str, fmt: str = "dd/MM/yyyy", lenient: bool = False) -> DataFrame:
    """Dates from text; a malformed one raises, or is null if ``lenient``."""
    return df.withColumn(col, F.to_date(F.try_to_timestamp(F.col(col), F.lit(fmt))) if lenient else F.to_date(col, fmt))


def date_parts(df: DataFrame, col: str = "call_date") -> DataFrame:
    return df.withColumns({"year": F.year(col), "month": F.month(col), "day": F.dayofmonth(col)})


def season_filter(df: DataFrame, season: str, col: str = "call_date") -> DataFrame:
    return df.where(in_season(F.month(col), season))


def split_by_year(df: DataFrame, splits: dict[str, tuple[int, int]], col: str = "call_date") -> DataFrame:
    return df.withColumn("split", split_of_year(F.year(col), splits))


def training_window(df: DataFrame, years: tuple[int, int], seasons: list[str], col: str = "obs_date") -> DataFrame:
    """Rows of the half-open years and the seasons, with their ``season``."""
    kept = df.where((F.year(col) >= years[0]) & (F.year(col) < years[1])).withColumn("season", season_of_month(F.month(col)))
    return kept.where(F.col("season").isin(seasons))


def incident_splits(incidents: DataFrame, edges: DataFrame, splits: dict[str, tuple[int, int]]) -> DataFrame:
    """Incidents inside the boundary with ``season`` and ``split``, all seasons in one plan."""
    dated = date_parts(incidents).withColumn("season", season_of_month(F.col("month")))
    return split_by_year(points_within_polygon(dated, edges), splits)


def season_year(df: DataFrame, col: str = "call_date") -> DataFrame:
    return df.select(season_of_month(F.month(col)).alias("season"), F.year(col).alias("year"))


def year_range(df: DataFrame) -> DataFrame:
    return season_year(df).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def season_share(df: DataFrame) -> DataFrame:
    counts = season_year(df).groupBy("season").count()
    return counts.select("season", (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"))


def season_year_counts(df: DataFrame, years: list[int]) -> DataFrame:
    """A column for each year; pairs without incidents are 0."""
    wide = season_year(df).groupBy("season").pivot("year", years).count().na.fill(0)
    return wide.select("season", *[F.col(f"`{y}`").alias(f"y{y}") for y in years])


def season_year_pct(df: DataFrame) -> DataFrame:
    """Share of each season in the incidents of its year, in percent; zero pairs are kept."""
    counts = season_year(df).groupBy("year").pivot("season", ["WINTER", "SPRING", "SUMMER", "FALL"]).count().na.fill(0)
    long = counts.unpivot("year", ["WINTER", "SPRING", "SUMMER", "FALL"], "season", "n")
    return long.select("season", "year", (100 * F.col("n") / F.sum("n").over(Window.partitionBy("year"))).alias("pct"))
