"""Time series of climate and vegetation, averaged by season."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import composite_digits, date_of_digits, ndvi_scale_mask, season_of_month
from .incidents import training_window


def seasonal_climate_mean(obs: DataFrame, years: tuple[int, int], seasons: list[str]) -> DataFrame:
    """Mean by season, variable and cell; missing values are skipped, and a cell of missing values only is missing."""
    return training_window(obs, years, seasons).groupBy("season", "var", "row", "col").agg(F.avg("value").alias("value"))


def dated(obs: DataFrame, col: str = "file", name: str = "obs_date") -> DataFrame:
    """Adds the date in the file's name, null if there is none.

    The number in the name is generated, so a row's name is searched once; as a plain column the search would be written
    out wherever the date is used.
    """
    read = obs.withColumn("digits_", F.explode(F.array(composite_digits(F.col(col)))))
    return read.withColumn(name, date_of_digits(F.col("digits_"))).drop("digits_")


def select_files_by_date(files: DataFrame, years: tuple[int, int] | None = None, seasons: list[str] | None = None, col: str = "file") -> DataFrame:
    """Rows of files whose dated name is in the seasons and years; undated names stay, and without seasons all do."""
    if seasons is None:
        return files
    date = F.col("date_")
    fits = season_of_month(F.month(date)).isin(seasons)
    if years:
        fits = fits & (F.year(date) >= years[0]) & (F.year(date) < years[1])
    return dated(files, col, "date_").where(date.isNull() | fits).drop("date_")


def select_files_by_year(files: DataFrame, years: list[int], col: str = "file") -> DataFrame:
    return files.where(F.col(col).rlike("|".join(map(str, years))))


def mean_ndvi(obs: DataFrame, by: tuple[str, ...] = ("row", "col")) -> DataFrame:
    return obs.groupBy(*by).agg(F.avg(ndvi_scale_mask(F.col("dn"))).alias("value"))
