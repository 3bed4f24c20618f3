import re

import pytest
from pyspark.sql import functions as F

from gridfire.operators import profile
from gridfire.sources import files


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Composites in folders by year, one without a date, one that is no Parquet file."""
    top = tmp_path_factory.mktemp("composites")
    for k, (sub, name) in enumerate([("1996", "a_doy1996180_x"), ("1996", "a_doy1996010_x"), ("1997", "a_doy1997200_x"), ("1997/more", "a_doy2005200_x"), ("", "plain")]):
        one = tmp_path_factory.mktemp("one")
        spark.createDataFrame([(k, r) for r in range(3)], "dn int, row int").coalesce(1).write.mode("overwrite").parquet(str(one))
        (top / sub).mkdir(parents=True, exist_ok=True)
        next(one.glob("part-*")).rename(top / sub / f"{name}.parquet")
    return top


SCHEMA = "dn int, row int"


def files_read(df):
    """The number of files that the scan of an executed plan opened, from its metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    return scan.metrics().get("numFiles").get().value()


def test_only_wanted_files_are_opened(spark, folder):
    got = files.read_dated(spark, str(folder), SCHEMA, (1995, 2000), ["SUMMER"])
    assert {r.file for r in got.collect()} == {"a_doy1996180_x.parquet", "a_doy1997200_x.parquet", "plain.parquet"}
    assert files_read(files.read_dated(spark, str(folder), SCHEMA, (1995, 2000), ["SUMMER"])) == 3 and files_read(files.read_dated(spark, str(folder), SCHEMA)) == 5
    assert files.list_files(spark, str(folder), "*.parquet").count() == 5


def test_unreadable_files_are_counted_or_raise(spark, folder, tmp_path):
    for f in folder.rglob("*.parquet"):
        (tmp_path / f.name).write_bytes(f.read_bytes())
    (tmp_path / "a_doy1996181_x.parquet").write_bytes(b"no parquet at all")
    (tmp_path / "a_doy2010181_x.parquet").write_bytes(b"nor this")
    with pytest.raises(Exception, match="doy1996181"):
        files.read_dated(spark, str(tmp_path), SCHEMA, (1995, 2000), ["SUMMER"]).collect()
    assert files.read_dated(spark, str(tmp_path), SCHEMA, (1995, 2000), ["SUMMER"], skip_unreadable=True).count() == 9
    assert [tuple(r) for r in files.unread_files(spark, str(tmp_path), SCHEMA, (1995, 2000), ["SUMMER"]).collect()] == [("a_doy1996181_x.parquet", 17)]
    with pytest.raises(FileNotFoundError, match="no file under"):
        files.read_dated(spark, str(tmp_path), SCHEMA, (1980, 1981), ["SUMMER"], pattern="a_*.parquet")
    with pytest.raises(FileNotFoundError, match="missing path"):
        files.read_dated(spark, str(tmp_path / "none"), SCHEMA)


def test_files_are_combined_by_coordinates(spark):
    rows = [("a", t, 0, float(t)) for t in range(4)] + [("b", t, 0, float(t)) for t in range(3, 7)] + [("c", t, 1, 1.0) for t in range(9)] + [("d", 20, 0, None), ("e", 20, 0, 5.0), ("f", None, 0, 2.0)]
    df = spark.createDataFrame(rows, "file string, t int, x int, value double")
    got = files.combine_by_coords(df, ["t", "x"]).collect()
    assert sorted((r.t, r.x, r.value) for r in got if r.t is not None and r.x == 0) == [*((t, 0, float(t)) for t in range(7)), (20, 0, 5.0)]
    assert len(got) == 7 + 9 + 1 + 1
    pairs = files.overlapping_files(files.coordinate_ranges(df.where("t IS NOT NULL"), ["t", "x"]), ["t", "x"])
    assert sorted((r.a, r.b) for r in pairs.collect()) == [("a", "b"), ("d", "e")]
    bad = df.union(spark.createDataFrame([("g", 5, 0, 5.5)], df.schema))
    with pytest.raises(ValueError, match=re.escape("values differ at t 5, x 0: 5.0 in b, 5.5 in g")):
        files.combine_by_coords(bad, ["t", "x"])
    assert [r.value for r in files.combine_by_coords(bad, ["t", "x"], on_conflict="first").where("t = 5 AND x = 0").collect()] == [5.0]
    assert sorted(tuple(r) for r in files.conflicts(bad, ["t", "x"]).collect()) == [(5, 0, 5.0, "b"), (5, 0, 5.5, "g")]
    assert files.combine_by_coords(df.limit(0), ["t", "x"]).count() == 0


def test_missing_paths_are_rows(spark, tmp_path):
    good, bad = str(tmp_path / "good"), tmp_path / "bad"
    spark.range(3).select(F.col("id").cast("double").alias("value")).write.parquet(good)
    bad.mkdir()
    (bad / "x.parquet").write_bytes(b"junk")
    read = lambda s, p: s.read.parquet(p)
    ask = lambda p, check: tuple(files.checked_path(spark, str(p), read, check).first()[:2])
    assert ask(good, profile.validate_raster) == (True, "ok")
    for check in (profile.validate_raster, profile.validate_vector, profile.validate_table):
        assert ask(tmp_path / "none", check) == (False, f"missing path: {tmp_path / 'none'}")
        assert ask(bad, check)[0] is False and "can't be read" in ask(bad, check)[1]
