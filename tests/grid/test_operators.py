import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfire.functions import grid as G
from gridfire.operators import cleaning, density, incidents, profile, raster, series, vector
from gridfire.sources import tables

SQUARE = G.Grid(0.0, 30.0, 10.0, 3, 3)


def cells(spark, rows):
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for r, line in enumerate(rows) for c, v in enumerate(line)], "row int, col int, elevation double")


def test_gradient_by_hand(spark):
    got = {(r.row, r.col): r for r in raster.terrain(cells(spark, [[1, 1, 1], [8, 8, 8], [64, 64, None]]), SQUARE).collect()}
    assert [got[r, 0].dy * 10 for r in range(3)] == pytest.approx([7, 31.5, 56]) and got[0, 1].dx == 0
    assert got[1, 2].dy is None and got[2, 2].slope is None
    assert got[0, 0].slope == pytest.approx(math.degrees(math.atan(0.7))) and got[0, 0].aspect == pytest.approx(270)


def test_smoothing(spark):
    g = G.Grid(0.0, 41.0, 1.0, 41, 41)
    at = lambda *rc: spark.createDataFrame([(*rc, 1)], "row int, col int, n long")
    mid = density.gaussian_smooth(at(20, 20), g)
    got = {(r.row, r.col): r.density for r in mid.collect()}
    assert len(got) == 625 and sum(got.values()) == pytest.approx(1) and got[8, 20] == pytest.approx(got[32, 20])
    for n, j in ((5, 0), (12, 11), (13, 6), (41, 1)):
        line = np.zeros(n)
        line[j] = 1
        weights = np.array([w for _, w in density.kernel(3.0)])
        want = np.convolve(np.pad(line, 12, mode="symmetric"), weights, mode="valid")
        one = density.gaussian_smooth(spark.createDataFrame([(j, 0, 1)], "row int, col int, n long"), G.Grid(0.0, n, 1.0, n, 1))
        assert {r.row: r.density for r in one.collect()} == pytest.approx({i: w for i, w in enumerate(want) if w > 0})


def test_distance_matches_brute_force(spark):
    g = G.Grid(0.0, 17.0, 100.0, 17, 23)
    rng = np.random.default_rng(3)
    marks = {(int(rng.integers(17)), int(rng.integers(23))) for _ in range(6)}
    presence = spark.createDataFrame([("a", r, c) for r, c in marks], "layer string, row int, col int")
    for x in raster.distance_to_features(presence, g, layers=["a", "none"]).collect():
        want = min(math.dist((x.row, x.col), m) for m in marks) * 0.1 if x.layer == "a" else None
        assert x.km == (None if want is None else pytest.approx(want))


def test_points_in_a_square_with_a_hole(spark):
    ring = lambda k, pts: [("p", k, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    v = spark.createDataFrame(ring(0, [(0, 0), (10, 0), (10, 10), (0, 10)]) + ring(1, [(4, 4), (6, 4), (6, 6), (4, 6)]), "name string, ring int, seq int, x double, y double")
    pts = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 10.0, 5.0), (4, 11.0, 5.0), (5, 0.0, 0.0), (6, 5.0, 4.0), (7, 3.0, 4.0), (8, 5.0, 10.0), (9, 5.0, 3.0)]
    got = vector.points_within_polygon(spark.createDataFrame(pts, "id int, easting double, northing double"), vector.edges_of(v), band=3.0)
    assert sorted(r.id for r in got.collect()) == [1, 7, 9]


def test_rows_alike_stay_as_many_as_they_are(spark, monkeypatch):
    """1, 2, 3 and 4 equal points without an id, by the broadcast and by the shuffle."""
    v = spark.createDataFrame([("p", 0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10)])], "name string, ring int, seq int, x double, y double")
    pts = spark.createDataFrame([(float(k), 5.0) for k in (1, 2, 3, 4) for _ in range(k)] + [(11.0, 5.0)] * 2 + [(None, 5.0)], "easting double, northing double")
    for limit in (100_000, 0):
        monkeypatch.setattr(vector, "BROADCAST_EDGES", limit)
        got = [r.easting for r in vector.points_within_polygon(pts, vector.edges_of(v), band=3.0, reach=4.0).collect()]
        assert sorted(got) == [float(k) for k in (1, 2, 3, 4) for _ in range(k)]
    twice = v.union(v.withColumn("name", F.lit("q")))
    assert vector.points_within_polygon(pts, vector.edges_of(twice), band=3.0).groupBy("name").count().collect()[0]["count"] == 10


def test_scan_lines_match_points(spark):
    """Cells inside a concave polygon with a hole, of which some centres are on its outline, as by testing each centre."""
    rng = np.random.default_rng(5)
    ring = lambda k, pts: [("p", k, i, float(x), float(y)) for i, (x, y) in enumerate(pts)]
    grid = G.Grid(0.0, 24.0, 2.0, 12, 15)
    shapes = [ring(0, [(1, 1), (25, 3), (27, 21), (15, 9), (3, 23)]) + ring(1, [(9, 5), (15, 5), (15, 7), (9, 7)])]
    shapes += [ring(0, [tuple(p) for p in rng.integers(-4, 34, (7, 2))]) for _ in range(3)]
    for rows in shapes:
        edges = vector.edges_of(spark.createDataFrame(rows, "name string, ring int, seq int, x double, y double"))
        x, y = G.cell_center(grid, F.col("row"), F.col("col"))
        want = vector.points_within_polygon(grid.cells(spark).withColumns({"easting": x, "northing": y}), edges)
        got = vector.cells_inside(edges, grid)
        assert sorted((r.row, r.col) for r in got.collect()) == sorted((r.row, r.col) for r in want.collect())


def test_nearest_matches_brute_force():
    rng = np.random.default_rng(7)
    for width in (1, 2, 3, 17, 64, 100):
        g = np.where(rng.random((5, width)) < 0.4, raster.FAR, rng.integers(0, 30, (5, width)) ** 2)
        i = np.arange(width)
        want = ((i[:, None] - i) ** 2 + g[:, None, :]).min(2)
        assert (raster.nearest(g) == want).all()


def test_percentiles_match_numpy(spark):
    """Also where ranges are far narrower than the groups, and with ties, missing values and small groups."""
    rng = np.random.default_rng(8)
    groups = {"a": rng.random(3000), "b": rng.integers(0, 9, 2500).astype(float), "c": np.array([3.0]), "d": np.array([1.0, 2.0]), "e": np.round(rng.normal(size=999), 2)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("f", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    want = {"p60": 0.6, "p0": 0.0, "p99": 0.99, "p100": 1.0}
    for accuracy in (50, 10_000):
        got = {r.g: r for r in profile.exact_percentiles(df, "x", want, ("g",), accuracy).collect()}
        assert set(got) == set(groups)
        for k, v in groups.items():
            assert [got[k][n] for n in want] == pytest.approx([np.quantile(v, q) for q in want.values()])
    assert profile.exact_percentiles(df.where("g = 'a'"), "x", want, (), 50).first().p60 == pytest.approx(np.quantile(groups["a"], 0.6))


def test_guards_name_what_lacks(spark):
    df = spark.createDataFrame([("SPRING",)] * 5 + [("FALL",)] * 4, "season string")
    assert profile.require_each(df, "season", ["SPRING"], 5, "incidents").count() == 9
    with pytest.raises(ValueError, match="4 in FALL, 0 in SUMMER"):
        profile.require_each(df, "season", ["SPRING", "FALL", "SUMMER"], 5, "incidents")


def test_dates_files_and_splits(spark):
    df = spark.createDataFrame([("29/02/2020",), ("x",)], "d string")
    assert [str(r.d) for r in incidents.parse_call_date(df, "d", lenient=True).collect()] == ["2020-02-29", "None"]
    with pytest.raises(Exception, match="CANNOT_PARSE|DateTimeException|could not be parsed"):
        incidents.parse_call_date(df, "d").collect()
    years = spark.range(2008, 2024).select(G.split_of_year(F.col("id"), {"train": (2009, 2020), "val": (2020, 2022)}).alias("s"), "id").collect()
    assert [r.s for r in years if r.id in (2008, 2009, 2019, 2020, 2021, 2022)] == [None, "train", "train", "val", "val", None]
    files = spark.createDataFrame([("a_doy2020060_x",), ("a_doy2019060_x",), ("undated",), ("a_doy2019200",)], "file string")
    assert [str(r.d) for r in files.select(G.composite_date(F.col("file")).alias("d")).collect()][:3] == ["2020-02-29", "2019-03-01", "None"]
    assert sorted(r.file for r in series.select_files_by_date(files, (2009, 2020), ["SPRING"]).collect()) == ["a_doy2019060_x", "undated"]
    dn = spark.createDataFrame([(-2000,), (-2001,), (10000,), (10001,), (None,)], "dn int")
    assert [r.v for r in dn.select(G.ndvi_scale_mask(F.col("dn")).alias("v")).collect()] == [-0.2, None, 1.0, None, None]


def test_national_grid(spark):
    """The published worked example of the projection lies near 651409.9, 313177.3 in the older datum's degrees."""
    got = G.to_bng(spark.createDataFrame([(1.716073973, 52.658007833)], "lon double, lat double")).first()
    assert got.easting == pytest.approx(651409.8, abs=5) and got.northing == pytest.approx(313177.4, abs=5)


def test_national_grid_back(spark):
    at = [(651409.9, 313177.3), (250000.0, 800000.0), (550000.0, 220000.0)]
    df = spark.createDataFrame(at, "easting double, northing double")
    got = G.to_bng(G.from_bng(df).drop("easting", "northing")).collect()
    for (e, n), r in zip(at, got, strict=True):
        assert r.easting == pytest.approx(e, abs=0.05) and r.northing == pytest.approx(n, abs=0.05)
    tile = G.Grid(0.5, 51.9, 1 / 3600, 36, 36)
    grid = G.reprojected_grid(spark, tile, 30.0)
    assert (grid.height, grid.width) == pytest.approx((38, 24), abs=2)


def test_cleaning_and_profile(spark):
    rows = [(i, 0, 0 if i < 30 else 3, float(i % 3) + (50 if i >= 25 else 0)) for i in range(60)] + [(99, 0, None, 1.0)]
    df = spark.createDataFrame(rows, "row int, col int, label int, f double")
    out = {r.row: r.label for r in cleaning.clean_labels(df, ["f"], n_init=2).collect()}
    assert [k for k in range(30) if out[k] is None] == [25, 26, 27, 28, 29] and out[40] == 3
    assert profile.validate_raster(df.limit(0), "f").first().message == "no cells"
    assert profile.validate_table(df, ["row"]).first().ok and profile.validate_table(df.limit(0)).first().message == "empty"
    with pytest.raises(ValueError):
        profile.require(df, 100, "rows")
    with pytest.raises(ValueError):
        density.compute_density(df, df, SQUARE, "other")


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("CallDateID,Other,IncidentEasting,IncidentNorthing,NumberVehiclesDeployed\n03/04/2011,z,1.5,2.5,3\n")
    r = tables.read_incidents(spark, str(tmp_path / "a.csv")).first()
    assert (str(r.call_date), r.easting, r.vehicles) == ("2011-04-03", 1.5, 3)
    layer = spark.createDataFrame([("x", 0, 0, 1.5), ("x", 0, 1, float("nan"))], "layer string, row int, col int, value double")
    tables.write_cells(layer, str(tmp_path / "cells"))
    assert sorted((c.col, c.value) for c in tables.read_cells(spark, str(tmp_path / "cells"), "x").collect()) == [(0, 1.5), (1, None)]
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"n"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    v = tables.read_geojson(spark, str(tmp_path / "g.json"))
    assert v.count() == 4 and v.first().name == "n"
    tables.write_geojson(v, str(tmp_path / "out"))
    assert '"coordinates":[[[0.0,0.0],[1.0,0.0],[1.0,1.0],[0.0,0.0]]]' in spark.read.text(str(tmp_path / "out")).first().value
    shapes = {"Point": [1, 2], "MultiPoint": [[1, 2], [3, 4]], "LineString": [[0, 0], [5, 5]], "MultiLineString": [[[0, 0], [5, 5]], [[1, 1], [2, 2], [3, 3]]], "MultiPolygon": [[[[0, 0], [4, 0], [4, 4]], [[1, 1], [2, 1], [2, 2]]], [[[9, 9], [8, 9], [8, 8]]]]}
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": k, "properties": {"name": k}, "geometry": {"type": k, "coordinates": c}} for k, c in shapes.items()] + [{"type": "Feature", "properties": {}, "geometry": None}]}
    (tmp_path / "all.json").write_text(json.dumps(doc))
    v = tables.read_geojson(spark, str(tmp_path / "all.json"))
    assert {(r.kind, r.part, r.ring) for r in v.where("kind = 'MultiPolygon'").collect()} == {("MultiPolygon", 0, 0), ("MultiPolygon", 0, 1), ("MultiPolygon", 1, 0)}
    tables.write_geojson(v, str(tmp_path / "again"))
    assert sorted(tables.read_geojson(spark, str(tmp_path / "again"), lines=True).collect()) == sorted(v.collect())
    got = {json.loads(r.value)["geometry"]["type"]: json.loads(r.value)["geometry"]["coordinates"] for r in spark.read.text(str(tmp_path / "again")).collect()}
    assert got == shapes
    assert vector.segments_of(v.where("kind LIKE '%Line%'").withColumn("part", F.concat_ws("/", "kind", "part"))).count() == 4
    calls = []
    make = lambda: calls.append(1) or layer
    for _ in range(2):
        assert tables.write_if_absent(spark, str(tmp_path / "once"), make).count() == 2
    assert len(calls) == 1
    tables.write_if_absent(spark, str(tmp_path / "once"), make, force=True)
    assert len(calls) == 2
    tables.write_splits(spark.createDataFrame([("SPRING", "train", 1)], "season string, split string, n int"), str(tmp_path / "s"))
    assert (tmp_path / "s" / "season=SPRING" / "split=train").is_dir()
    tables.write_csv(layer, str(tmp_path / "c"))
    assert tables.read_csv(spark, str(tmp_path / "c"), layer.schema).count() == 2
    assert tables.open_many(spark, [str(tmp_path / "once"), str(tmp_path / "once")]).count() == 4
