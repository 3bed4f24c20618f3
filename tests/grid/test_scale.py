"""Far cells and tall grids: what is only seen on larger tables."""

import math

import numpy as np
import pytest

from gridfire.functions.grid import Grid
from gridfire.operators import density, incidents, raster, series
from gridfire.queries import QUERIES


def test_kernel_density_of_cells_out_of_reach(spark):
    """Every land cell has a row, also farther than the cut-off from all points; groups are on their own."""
    g = Grid(0.0, 0.0, 30.0, 400, 1)
    land = spark.createDataFrame([(0, 0), (3, 0), (399, 0)], "row int, col int")
    points = spark.createDataFrame([("a", 15.0, -15.0, 2), ("a", 15.0, -45.0, 1), ("b", 15.0, -11985.0, 5), ("c", 15.0, -15.0, None)], "season string, easting double, northing double, w int")
    scale = 2 * math.pi * 500.0**2
    at = lambda d: math.exp(-(d**2) / (2 * 500.0**2))
    one = density.kde_density(points.where("season = 'a'"), land, g, weight="w")
    want = {0: (2 * at(0) + at(30)) / 3 / scale, 3: (2 * at(90) + at(60)) / 3 / scale, 399: 0.0}
    assert {r.row: r.density for r in one.collect()} == pytest.approx(want)
    each = {(r.season, r.row): r.density for r in density.kde_density(points, land, g, by=("season",), weight="w").collect()}
    assert len(each) == 9 and each["a", 399] == 0 and each["b", 0] == 0 and each["b", 399] == pytest.approx(1 / scale)
    assert each["a", 3] == pytest.approx(want[3]) and each["c", 0] is None
    assert density.kde_density(points.limit(0), land, g).count() == 0


def made_by_joins(df):
    """The most rows that a join of an executed plan made."""

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if "QueryStage" in name:
            return walk(p.plan())
        own = p.metrics().apply("numOutputRows").value() if "Join" in name else 0
        return max([own, *[walk(p.children().apply(i)) for i in range(p.children().size())]])

    return walk(df._jdf.queryExecution().executedPlan())


def all_pairs(points, cells, g, bandwidth, cutoff):
    """Weighted kernel density of cells by every pair, as the operator words it."""
    e, n, w = (np.array([p[k] for p in points]) for k in range(3))
    out = []
    for row, col in cells:
        d2 = (g.x0 + (col + 0.5) * g.res - e) ** 2 + (g.y0 - (row + 0.5) * g.res - n) ** 2
        out.append((w * np.exp(-d2 / (2 * bandwidth**2)))[d2 <= (cutoff * bandwidth) ** 2].sum() / (w.sum() * 2 * math.pi * bandwidth**2))
    return out


@pytest.mark.parametrize("block", [16, 512])
def test_kernel_density_joins_no_pairs(spark, monkeypatch, block):
    """Points and cells in reach don't meet row by row; the cut-off is a circle, and small enough here to be seen."""
    monkeypatch.setattr(density, "BLOCK", block)
    g, rng = Grid(1000.0, 2000.0, 10.0, 70, 45), np.random.default_rng(7)
    cells = [(r, c) for r in range(70) for c in range(45) if (r + c) % 3 and not 20 < r < 30]
    land = spark.createDataFrame(cells, "row int, col int")
    points = {k: [(float(x), float(y), int(w)) for x, y, w in zip(rng.uniform(850, 1600, 900), rng.uniform(1150, 2150, 900), rng.integers(0, 4, 900), strict=True)] for k in (1, 2)}
    points[2] += [(1234.5, 1765.4, 2)] * 3 + [(5e6, 1e15, 1)]
    rows = [(k, *p) for k, held in points.items() for p in held] + [(None, 1200.0, 1800.0, 1)]
    df = density.kde_density(spark.createDataFrame(rows, "year int, easting double, northing double, w int"), land, g, 60.0, 2.0, by=("year",), weight="w")
    got = {(r.year, r.row, r.col): r.density for r in df.collect()}
    want = {(k, *cell): d for k in points for cell, d in zip(cells, all_pairs(points[k], cells, g, 60.0, 2.0), strict=True)}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(d, rel=1e-11, abs=1e-30) for k, d in want.items())
    assert made_by_joins(df) <= 9 * len(rows)


def test_kernel_density_terms_in_parts(monkeypatch):
    """However many pairs are looked at together."""
    rng = np.random.default_rng(3)
    north, east, n = rng.uniform(0, 300, 50), rng.uniform(0, 300, 50), rng.uniform(0, 2, 50)
    ys, xs = np.arange(500.0, -200.0, -25.0), np.arange(-150.0, 420.0, 25.0)
    d2 = (ys[:, None, None] - north) ** 2 + (xs[None, :, None] - east) ** 2
    for size in (40.0, 250.0, 2000.0):
        want = np.where(d2 <= size**2, n * np.exp(-d2 / (2 * 70.0**2)), 0).sum(2)
        for pairs in (1, 200, 1 << 17):
            monkeypatch.setattr(density, "PAIRS", pairs)
            out = np.ones((len(ys), len(xs)))
            density.add_terms(out, ys, xs, north, east, n, 70.0, size)
            assert np.allclose(out, want + 1, rtol=1e-12, atol=0)


def test_kernel_density_shares_out_a_crowd(spark, monkeypatch, tmp_path):
    """Points that all lie in one small place are worked on by all partitions."""
    real = density.add_terms

    def counted(out, ys, xs, north, *rest, folder=str(tmp_path)):
        import uuid

        from pyspark import TaskContext

        with open(f"{folder}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(north)))
        real(out, ys, xs, north, *rest)

    monkeypatch.setattr(density, "add_terms", counted)
    g = Grid(0.0, 0.0, 30.0, 20, 20)
    points = spark.range(4000).selectExpr("CAST(100 + id % 50 / 100 AS DOUBLE) AS easting", "CAST(-100 - id / 1000 AS DOUBLE) AS northing")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert density.kde_density(points, g.cells(spark), g).where("density > 0").count() == 400
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per = {}
    for f in tmp_path.iterdir():
        per[f.name.split("-")[0]] = per.get(f.name.split("-")[0], 0) + int(f.read_text())
    assert sum(per.values()) == 4000 and len(per) == 4 and max(per.values()) < 2000


@pytest.mark.parametrize("small", [False, True])
def test_distances_on_tall_grids(spark, monkeypatch, small):
    """No window goes through all rows below each row; runs over several bands and partitions, marks off the grid."""
    g = Grid(0.0, 0.0, 100.0, 700 if small else 60_000, 3)
    if small:
        monkeypatch.setattr(raster, "BAND_CELLS", 1)
        monkeypatch.setattr(raster, "PART_CELLS", 100)
    rng = np.random.default_rng(5)
    marks = [(int(rng.integers(g.height)), int(rng.integers(2))) for _ in range(40)] + [(10, 1), (11, 1), (13, 1)]
    off = [("a", -1, 2), ("a", g.height, 2), ("a", 5, 3), ("other", 5, 2)]
    presence = spark.createDataFrame([("a", r, c) for r, c in marks] + off + [("b", 7, 2)], "layer string, row int, col int")
    out = raster.distance_to_features(presence, g, layers=["a", "b", "none"])
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString()
    got = out.toPandas()
    assert len(got) == 3 * g.height * g.width == len(got[["layer", "row", "col"]].drop_duplicates())
    assert got[got.layer == "none"].km.isna().all()
    for layer, held in (("a", marks), ("b", [(7, 2)])):
        x = got[got.layer == layer]
        want = np.min([np.hypot(x.row - r, x.col - c) for r, c in held], axis=0) * 0.1
        assert np.allclose(x.km, want, rtol=1e-12, atol=0)


def test_distances_are_found_where_land_is(spark, monkeypatch, tmp_path):
    """Bands of rows without land don't reach the step along rows; presence there counts for land elsewhere."""
    g = Grid(0.0, 0.0, 100.0, 60_000, 3)

    def counted(lines, folder=str(tmp_path)):
        import uuid

        from gridfire.operators.raster import nearest

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(lines)))
        return nearest(lines)

    monkeypatch.setattr(raster, "nearest", counted)
    land = spark.createDataFrame([(0, 1), (3, 2), (59_999, 2)], "row int, col int")
    presence = spark.createDataFrame([("a", 30_000, 0), ("b", 2, 2)], "layer string, row int, col int")
    got = {(r.layer, r.row, r.col): r.km for r in raster.distance_to_features(presence, g, land, ["a", "b"]).collect()}
    far = {("a", 0, 1): (30_000, 1), ("a", 3, 2): (29_997, 2), ("a", 59_999, 2): (29_999, 2), ("b", 0, 1): (2, 1), ("b", 3, 2): (1, 0), ("b", 59_999, 2): (59_997, 0)}
    assert got == pytest.approx({k: math.hypot(*v) * 0.1 for k, v in far.items()})
    high = raster.BAND_CELLS // g.width
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 2 * (high + g.height % high)
    assert raster.distance_to_features(presence, g, land.limit(0), ["a", "b"]).count() == 0


@pytest.mark.parametrize("name", ["assemble_dataset", "dataset_unclipped", "full_pipeline", "static_features"])
def test_composites_have_no_window_to_the_end(spark, sf_dir, monkeypatch, name):
    plans, real = [], raster.distance_to_features

    def seen(*args, **options):
        out = real(*args, **options)
        plans.append(out._jdf.queryExecution().toString())
        return out

    monkeypatch.setattr(raster, "distance_to_features", seen)
    QUERIES[name](spark, sf_dir)
    assert plans and not any("unboundedfollowing" in p for p in plans)


def test_dates_are_read_from_a_name_once(spark):
    """Wherever the date is used, also by filters that are pushed down."""
    files = ["a_doy2019059x", "doy2020366", "doy2020999", "doy202006", "", None]
    obs = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "file string, dn int")
    kept = incidents.training_window(series.dated(obs), (2019, 2021), ["WINTER"])
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") == 1
    assert sorted((str(r.obs_date), r.dn) for r in kept.collect()) == [("2019-02-28", 0), ("2020-12-31", 1)]
    assert [str(r.obs_date) for r in series.dated(obs).orderBy("dn").collect()] == ["2019-02-28", "2020-12-31", "2022-09-25", "None", "None", "None"]
