"""The grid, and column functions on cells, dates and coordinates. A missing value is null, never NaN."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Months of each season. A winter is December, January and February of one calendar year.
SEASONS = {"WINTER": [12, 1, 2], "SPRING": [3, 4, 5], "SUMMER": [6, 7, 8], "FALL": [9, 10, 11]}


@dataclass(frozen=True)
class Grid:
    """North-up grid: upper-left corner, cell size, and size in cells."""

    x0: float
    y0: float
    res: float
    height: int
    width: int

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """Left, bottom, right, top."""
        return self.x0, self.y0 - self.height * self.res, self.x0 + self.width * self.res, self.y0

    def cells(self, spark: SparkSession) -> DataFrame:
        """(``row``, ``col``) of every cell."""
        return spark.range(self.height * self.width).select(F.floor(F.col("id") / self.width).cast("int").alias("row"), (F.col("id") % self.width).cast("int").alias("col"))


def season_of_month(month: Column) -> Column:
    out = F.lit("?")
    for name, months in SEASONS.items():
        out = F.when(month.isin(months), name).otherwise(out)
    return out


def in_season(month: Column, season: str) -> Column:
    return month.isin(SEASONS[season])


def split_of_year(year: Column, splits: dict[str, tuple[int, int]]) -> Column:
    """The name of the half-open range of years that holds the year; null outside all."""
    out = F.lit(None).cast("string")
    for name, (a, b) in splits.items():
        out = F.when((year >= a) & (year < b), name).otherwise(out)
    return out


def cell_center(grid: Grid, row: Column, col: Column) -> tuple[Column, Column]:
    return F.lit(grid.x0) + (col + 0.5) * grid.res, F.lit(grid.y0) - (row + 0.5) * grid.res


def point_to_cell(points: DataFrame, grid: Grid, x: str = "easting", y: str = "northing") -> DataFrame:
    """Adds ``row`` and ``col``; points off the grid go. A point on a border belongs to the cell right of or below it."""
    out = points.withColumn("row", F.floor((F.lit(grid.y0) - F.col(y)) / grid.res).cast("int")).withColumn("col", F.floor((F.col(x) - grid.x0) / grid.res).cast("int"))
    return out.where(F.col("row").between(0, grid.height - 1) & F.col("col").between(0, grid.width - 1))


def ndvi_scale_mask(dn: Column, scale: float = 1e-4, low: float = -0.2, high: float = 1.0) -> Column:
    """Scaled values; outside the bounds (which count as inside) they are missing."""
    return F.when((dn * scale).between(low, high), dn * scale)


def composite_digits(file: Column) -> Column:
    """Year and day of the year in a file name's part doyYYYYDDD, as one number; null if there is none."""
    return F.regexp_extract(file, r"doy(\d{7})", 1).try_cast("int")


def date_of_digits(digits: Column) -> Column:
    return F.date_add(F.make_date(F.floor(digits / 1000).cast("int"), F.lit(1), F.lit(1)), (digits % 1000).cast("int") - 1)


def composite_date(file: Column) -> Column:
    """The date in a file name's part doyYYYYDDD; null if there is none."""
    return date_of_digits(composite_digits(file))


#: Ellipsoids, datum shift and map projection of the British national grid.
AIRY, WGS84 = (6377563.396, 6356256.909), (6378137.0, 6356752.314245)
SHIFT = (-446.448, 125.157, -542.06, 20.4894e-6, -0.1502, -0.247, -0.8421)
PROJECTION = (0.9996012717, math.radians(49), math.radians(-2), 400000.0, -100000.0)


def to_bng(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds ``easting`` and ``northing`` of WGS84 degrees: seven-parameter shift, then transverse Mercator; right to a few metres.

    Each step is a column of its own, so that Spark computes it once and not wherever it is used.
    """
    c, kept = F.col, df.columns
    a, b = WGS84
    e2 = 1 - b * b / (a * a)
    df = df.withColumns({"phi_": F.radians(lat), "lam_": F.radians(lon)})
    df = df.withColumn("nu_", F.lit(a) / F.sqrt(1 - e2 * F.sin("phi_") ** 2))
    df = df.withColumns({"u_": c("nu_") * F.cos("phi_") * F.cos("lam_"), "v_": c("nu_") * F.cos("phi_") * F.sin("lam_"), "w_": (1 - e2) * c("nu_") * F.sin("phi_")})
    shift, turn = _rotation()
    df = df.withColumns({k: float(t) + float(r[0]) * c("u_") + float(r[1]) * c("v_") + float(r[2]) * c("w_") for k, t, r in zip(("x_", "y_", "z_"), shift, turn, strict=True)})
    a, b = AIRY
    e2 = 1 - b * b / (a * a)
    df = df.withColumn("p_", F.sqrt(c("x_") ** 2 + c("y_") ** 2)).withColumn("phi_", F.atan2(c("z_"), c("p_") * (1 - e2)))
    for _ in range(3):
        df = df.withColumn("phi_", F.atan2(c("z_") + e2 * (F.lit(a) / F.sqrt(1 - e2 * F.sin("phi_") ** 2)) * F.sin("phi_"), c("p_")))
    f0, phi0, lam0, e0, n0 = PROJECTION
    df = df.withColumns({"sin_": F.sin("phi_"), "cos_": F.cos("phi_"), "tan_": F.tan("phi_"), "d_": c("phi_") - phi0, "t_": c("phi_") + phi0, "l_": F.atan2("y_", "x_") - lam0})
    df = df.withColumns({"nu_": F.lit(a * f0) / F.sqrt(1 - e2 * c("sin_") ** 2), "rho_": F.lit(a * f0 * (1 - e2)) / (1 - e2 * c("sin_") ** 2) ** 1.5})
    df = df.withColumn("eta_", c("nu_") / c("rho_") - 1)
    nu, sin, cos, tan, eta, dl = (c(x) for x in ("nu_", "sin_", "cos_", "tan_", "eta_", "l_"))
    north = meridian_arc(c("d_"), c("t_")) + n0 + nu / 2 * sin * cos * dl**2 + nu / 24 * sin * cos**3 * (5 - tan**2 + 9 * eta) * dl**4 + nu / 720 * sin * cos**5 * (61 - 58 * tan**2 + tan**4) * dl**6
    east = e0 + nu * cos * dl + nu / 6 * cos**3 * (nu / c("rho_") - tan**2) * dl**3 + nu / 120 * cos**5 * (5 - 18 * tan**2 + tan**4 + 14 * eta - 58 * tan**2 * eta) * dl**5
    return df.select(*[x for x in kept if x not in ("easting", "northing")], east.alias("easting"), north.alias("northing"))


def _rotation() -> tuple[np.ndarray, np.ndarray]:
    """Shift and matrix of the datum change from WGS84."""
    tx, ty, tz, s, rx, ry, rz = SHIFT
    rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
    return np.array([tx, ty, tz]), np.array([[1 + s, -rz, ry], [rz, 1 + s, -rx], [-ry, rx, 1 + s]])


def meridian_arc(d: Column, t: Column) -> Column:
    """Distance along the meridian from the projection's origin; d and t are the latitude less and plus the origin's."""
    a, b = AIRY
    n, f0 = (a - b) / (a + b), PROJECTION[0]
    return b * f0 * (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(d) * F.cos(t)
        + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * d) * F.cos(2 * t) - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * t)
    )


def from_bng(df: DataFrame, easting: str = "easting", northing: str = "northing", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Sets ``lon`` and ``lat``, WGS84 degrees, of national grid coordinates: the way back of ``to_bng``, to some centimetres."""
    c, kept = F.col, [x for x in df.columns if x not in (lon, lat)]
    a, b = AIRY
    e2 = 1 - b * b / (a * a)
    f0, phi0, lam0, e0, n0 = PROJECTION
    df = df.withColumns({"n_": c(northing) - n0, "e_": c(easting) - e0}).withColumn("phi_", c("n_") / (a * f0) + phi0)
    for _ in range(5):
        df = df.withColumn("phi_", c("phi_") + (c("n_") - meridian_arc(c("phi_") - phi0, c("phi_") + phi0)) / (a * f0))
    df = df.withColumns({"sin_": F.sin("phi_"), "cos_": F.cos("phi_"), "tan_": F.tan("phi_")})
    df = df.withColumns({"nu_": F.lit(a * f0) / F.sqrt(1 - e2 * c("sin_") ** 2), "rho_": F.lit(a * f0 * (1 - e2)) / (1 - e2 * c("sin_") ** 2) ** 1.5})
    nu, rho, tan, cos, x = c("nu_"), c("rho_"), c("tan_"), c("cos_"), c("e_")
    eta = nu / rho - 1
    phi = c("phi_") - tan * x**2 / (2 * rho * nu) + tan * x**4 / (24 * rho * nu**3) * (5 + 3 * tan**2 + eta - 9 * tan**2 * eta) - tan * x**6 / (720 * rho * nu**5) * (61 + 90 * tan**2 + 45 * tan**4)
    lam = lam0 + (x / nu - x**3 / (6 * nu**3) * (nu / rho + 2 * tan**2) + x**5 / (120 * nu**5) * (5 + 28 * tan**2 + 24 * tan**4) - x**7 / (5040 * nu**7) * (61 + 662 * tan**2 + 1320 * tan**4 + 720 * tan**6)) / cos
    df = df.withColumns({"p_": phi, "l_": lam}).withColumn("nu_", F.lit(a) / F.sqrt(1 - e2 * F.sin("p_") ** 2))
    shift, turn = _rotation()
    back = np.linalg.inv(turn)
    df = df.withColumns({"u_": c("nu_") * F.cos("p_") * F.cos("l_") - float(shift[0]), "v_": c("nu_") * F.cos("p_") * F.sin("l_") - float(shift[1]), "w_": (1 - e2) * c("nu_") * F.sin("p_") - float(shift[2])})
    df = df.withColumns({k: float(r[0]) * c("u_") + float(r[1]) * c("v_") + float(r[2]) * c("w_") for k, r in zip(("x_g", "y_g", "z_g"), back, strict=True)})
    a, b = WGS84
    e2 = 1 - b * b / (a * a)
    df = df.withColumn("d_", F.sqrt(c("x_g") ** 2 + c("y_g") ** 2)).withColumn("phi_", F.atan2(c("z_g"), c("d_") * (1 - e2)))
    for _ in range(4):
        df = df.withColumn("phi_", F.atan2(c("z_g") + e2 * (F.lit(a) / F.sqrt(1 - e2 * F.sin("phi_") ** 2)) * F.sin("phi_"), c("d_")))
    return df.select(*kept, F.degrees(F.atan2("y_g", "x_g")).alias(lon), F.degrees("phi_").alias(lat))


def reprojected_grid(spark: SparkSession, grid: Grid, res: float, points: int = 21) -> Grid:
    """The national grid of cell size ``res`` over a grid of degrees: its border, at ``points`` places a side, projected."""
    left, bottom, right, top = grid.bounds
    steps = [k / (points - 1) for k in range(points)]
    border = [p for t in steps for p in ((left + t * (right - left), bottom), (left + t * (right - left), top), (left, bottom + t * (top - bottom)), (right, bottom + t * (top - bottom)))]
    placed = to_bng(spark.createDataFrame(border, "lon double, lat double"))
    e = placed.agg(F.min("easting").alias("l"), F.max("easting").alias("r"), F.min("northing").alias("b"), F.max("northing").alias("t")).first()
    return Grid(e.l, e.t, res, math.ceil((e.t - e.b) / res), math.ceil((e.r - e.l) / res))


def seasonal_name(base: Column, season: Column | None = None) -> Column:
    """``base_season``, or the base alone without a season."""
    return base if season is None else F.concat_ws("_", base, season)
