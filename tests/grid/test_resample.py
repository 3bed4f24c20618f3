import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfire.functions.grid import Grid
from gridfire.operators import parts, profile, resample, vector
from gridfire.plans import pipeline
from gridfire.sources import tables

FINE = Grid(0.0, 120.0, 10.0, 12, 9)


def source(spark, layers=(("a",),)):
    rnd = np.random.default_rng(4)
    known = {(layer, r, c): None if rnd.random() < 0.2 else float(rnd.integers(100)) for layer in layers for r in range(12) for c in range(9)}
    return known, spark.createDataFrame([(*layer, r, c, v) for (layer, r, c), v in known.items()], "layer string, row int, col int, value double")


def brute(known, layer, fx, fy, span, kernel):
    """The weighted mean over every source cell."""
    total = weights = 0.0
    for r in range(12):
        for c in range(9):
            if kernel == "average":
                along = lambda i, f: max(0.0, min(i + 1, f + span / 2) - max(i, f - span / 2))
            elif kernel == "nearest":
                along = lambda i, f: float(i <= f < i + 1)
            else:
                reach = max(1.0, span) if kernel == "triangle" else 1.0
                along = lambda i, f: max(0.0, 1 - abs(i + 0.5 - f) / reach)
            w, v = along(r, fy) * along(c, fx), known[layer, r, c]
            if w > 1e-9 and v is not None:
                total, weights = total + w * v, weights + w
    return total / weights if weights else None


@pytest.mark.parametrize("kernel", resample.KERNELS)
@pytest.mark.parametrize("res", [4.0, 10.0, 25.0, 40.0])
def test_kernels_match_brute_force(spark, monkeypatch, kernel, res):
    known, df = source(spark, (("a",), ("b",), ("c",)))
    coarse = Grid(-3.0, 125.0, res, int(140 // res), int(110 // res))
    monkeypatch.setattr(resample, "LAYERS", 2)
    monkeypatch.setattr(resample, "BROADCAST_VALUES", 0 if res == 25 else 10**6)
    got = {(r.layer, r.row, r.col): r.value for r in resample.resampled(df, FINE, coarse.cells(spark), coarse, ("layer",), kernel=kernel).collect()}
    want = {}
    for layer in "abc":
        for r in range(coarse.height):
            for c in range(coarse.width):
                fx, fy = (coarse.x0 + (c + 0.5) * res) / 10, (120.0 - (coarse.y0 - (r + 0.5) * res)) / 10
                if 0 <= fx < 9 and 0 <= fy < 12 and (v := brute(known, (layer,), fx, fy, res / 10, kernel)) is not None:
                    want[layer, r, c] = v
    assert got.keys() == want.keys() and got == pytest.approx(want)


def test_resampling_refuses_what_it_doesnt_know(spark):
    _, df = source(spark)
    for options in ({"system": "mercator"}, {"kernel": "cubic"}):
        with pytest.raises(ValueError, match="unknown"):
            resample.resampled(df, FINE, FINE.cells(spark), FINE, **options)
    assert resample.resampled(df.limit(0), FINE, FINE.cells(spark), FINE, ("layer",)).count() == 0


def test_tiles_that_dont_fit_raise(spark):
    tiles = spark.createDataFrame([(1, 0, 0, 5.0), (2, 0, 0, 6.0), (2, 9, 0, 7.0), (3, 0, 0, 8.0)], "tile int, row int, col int, value double")
    names = lambda *rows: spark.createDataFrame(rows, "tile int, x0 double, y0 double, res double, height int, width int")
    placed, grid = resample.place_tiles(tiles, names((1, 10.0, 50.0, 1.0, 2, 2), (2, 11.2, 53.0, 1.0, 2, 4)))
    assert grid == Grid(10.0, 53.0, 1.0, 5, 5) and sorted((r.tile, r.row, r.col) for r in placed.collect()) == [(1, 3, 0), (2, 0, 1)]
    for bad in (((1, 0.0, 0.0, 1.0, 1, 1), (2, 0.0, 0.0, 2.0, 1, 1)), ((1, 0.0, 0.0, 1.0, 1, 1), (1, 0.0, 0.0, 1.0, 1, 1))):
        with pytest.raises(ValueError, match="tiles of cell sizes"):
            resample.place_tiles(tiles, names(*bad))


def test_cropping(spark):
    edges = spark.createDataFrame([("p", 15.0, 95.0, 44.0, 95.0), ("p", 44.0, 95.0, 44.0, 61.0), ("p", 44.0, 61.0, 15.0, 61.0), ("p", 15.0, 61.0, 15.0, 95.0)], "name string, x1 double, y1 double, x2 double, y2 double")
    cells, window = vector.crop_to_boundary(FINE.cells(spark), FINE, edges)
    assert window == Grid(10.0, 100.0, 10.0, 4, 4)
    back = {(r.row + 2, r.col + 1) for r in cells.collect()}
    assert back == {(r.row, r.col) for r in vector.clip_cells_to_boundary(FINE.cells(spark), FINE, edges).collect()} and back
    far = edges.select("name", *[(F.col(c) + 1000).alias(c) for c in ("x1", "y1", "x2", "y2")])
    with pytest.raises(ValueError, match="off the grid"):
        vector.crop_to_boundary(FINE.cells(spark), FINE, far)


def test_parts_match_brute_force(spark):
    rnd = random.Random(3)
    g = Grid(0.0, 0.0, 1.0, 40, 150)
    cells = {(r, c) for r in range(40) for c in range(150) if rnd.random() < 0.55}
    spiral = {(2 * k, c) for k in range(20) for c in range(150)} | {(2 * k + 1, 149 if k % 2 else 0) for k in range(20)}
    for marked in (cells, spiral):
        want = {}
        for start in sorted(marked):
            if start not in want:
                stack = [start]
                while stack:
                    at = stack.pop()
                    if at in marked and at not in want:
                        want[at] = start[0] * 150 + start[1]
                        stack += [(at[0] + a, at[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
        df = spark.createDataFrame([*marked, next(iter(marked))], "row int, col int")
        got = parts.connected_parts(df, g).collect()
        assert {(r.row, r.col): r.part for r in got} == want and len(got) == len(want)
    assert parts.connected_parts(df.limit(0), g).count() == 0


def test_guards_count_while_writing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    assert profile.written_with_each(df, "t", F.col("k"), ["a", "b"], 1, "rows", F.col("v").isNotNull()).count() == 3
    with pytest.raises(ValueError, match="rows: 2 needed, but there are 1 in b, 0 in c"):
        profile.written_with_each(df, "t", F.col("k"), ["a", "b", "c"], 2, "rows")
    table, seen = tables.observed(df.limit(0), "t", {"n": F.count(F.lit(1))})
    assert table.count() == 0 and seen["n"] == 0


def test_empty_classes_are_reported(spark):
    told, empty = profile.report_empty(spark.createDataFrame([("x 0",), ("x 2",), (None,)], "class string"), "class", ["x 0", "x 1", "x 2"], "labels")
    told.count()
    with pytest.warns(UserWarning, match="no row of class x 1"):
        assert empty() == ["x 1"]


def test_jobs_together():
    assert pipeline.together(lambda: 1, lambda: 2) == [1, 2]
    with pytest.raises(ZeroDivisionError):
        pipeline.together(lambda: 1 // 0, lambda: 2)


def test_scratch_tables_go(spark):
    """Tables written inside, by any thread, are deleted at the end, also after an error; others stay."""
    before = tables.written(spark.range(2), "kept")
    with tables.scratch_tables(spark):
        inner = pipeline.together(lambda: tables.written(spark.range(3), "a"), lambda: tables.observed(spark.range(4), "b", {"n": F.count(F.lit(1))})[0])
        assert [t.count() for t in inner] == [3, 4]
        files = [f for t in inner for f in t.inputFiles()]
    assert not any(spark._jvm.java.io.File(spark._jvm.java.net.URI(f)).exists() for f in files)
    with pytest.raises(ZeroDivisionError), tables.scratch_tables(spark):
        files = tables.written(spark.range(1), "c").inputFiles()
        1 // 0
    assert not spark._jvm.java.io.File(spark._jvm.java.net.URI(files[0])).exists() and before.count() == 2 and not tables.OWNED
