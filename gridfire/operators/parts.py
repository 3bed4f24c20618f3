"""Connected parts of a set of cells, by runs of cells along rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..sources.tables import observed, written

#: Columns of a bucket in which runs of neighbouring rows meet.
BUCKET = 64


def row_runs(cells: DataFrame, grid: Grid) -> DataFrame:
    """(``run``, ``row``, ``a``, ``b``): cells side by side in a row, from column ``a`` to ``b``; ``run`` numbers their first cell."""
    w = Window.partitionBy("row").orderBy("col")
    marked = cells.select("row", "col").distinct().withColumn("gap_", F.col("col") - F.row_number().over(w))
    runs = marked.groupBy("row", "gap_").agg(F.min("col").alias("a"), F.max("col").alias("b"))
    return runs.select((F.col("row").cast("long") * grid.width + F.col("a")).alias("run"), "row", "a", "b")


def touching_runs(runs: DataFrame) -> DataFrame:
    """(``u``, ``v``): runs of neighbouring rows that share a column; each pair once, ``u`` above.

    Runs meet by row and bucket of columns, so a row of many runs doesn't compare each with each.
    """
    cut = F.explode(F.sequence(F.floor(F.col("a") / BUCKET), F.floor(F.col("b") / BUCKET)))
    upper = runs.select(F.col("run").alias("u"), F.col("row").alias("at"), "a", "b", cut.alias("k"))
    lower = runs.select(F.col("run").alias("v"), (F.col("row") - 1).alias("at"), F.col("a").alias("a_"), F.col("b").alias("b_"), cut.alias("k"))
    return upper.join(lower, ["at", "k"]).where("a <= b_ AND a_ <= b").select("u", "v").distinct()


def least_reached(nodes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(``run``, ``part``): the smallest run that each of ``nodes`` reaches over ``edges`` (``u``, ``v``).

    A step takes the smallest label around each run and then the label of that label, so that labels travel ever
    farther: some log n steps. A step is a table, whose job counts what has changed; it ends when nothing has.
    """
    both = written(edges.union(edges.select("v", "u")), "edges")
    labels = written(nodes.select("run", F.col("run").alias("part")), "parts")
    for _ in range(rounds):
        around = both.join(labels.select(F.col("run").alias("v"), "part"), "v").groupBy(F.col("u").alias("run")).agg(F.min("part").alias("near"))
        step = labels.join(around, "run", "left").select("run", "part", F.least("part", "near").alias("next"))
        # the root that a run names takes the least that any of its runs has found
        found = step.groupBy(F.col("part").alias("root")).agg(F.min("next").alias("least"))
        new = step.join(found, F.col("part") == F.col("root")).select("run", "part", F.least("next", "least").alias("next"))
        jump = new.select(F.col("run").alias("to"), F.col("next").alias("far"))
        new = new.join(jump, F.col("next") == F.col("to"), "left").select("run", F.least("next", "far").alias("part"), F.col("part").alias("was"))
        labels, seen = observed(new, "parts", {"changed": F.count_if(F.col("part") != F.col("was"))})
        labels = labels.drop("was")
        if not seen["changed"]:
            return labels
    raise RuntimeError(f"parts didn't settle in {rounds} steps")


def connected_parts(cells: DataFrame, grid: Grid) -> DataFrame:
    """(``row``, ``col``, ``part``) of the different cells: those that hang together by their sides have one part.

    A part's number is that of its first cell in row order, row * width + col. Cells that touch at a corner only are
    parts of their own, as parts of a dissolved polygon are.
    """
    runs = written(row_runs(cells, grid), "runs")
    named = least_reached(runs, touching_runs(runs))
    return runs.join(named, "run").select("row", F.explode(F.sequence("a", "b")).alias("col"), "part")
