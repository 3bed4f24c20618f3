"""Helpers shared by the corpus operators: shared scratch space, Arrow batch mapping, column names."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path under ``spark.checkpoint.dir``, which driver and executors share.

    Where neither that setting nor a checkpoint folder is there, a temporary folder stands in if Spark runs in one
    process (tests); on a cluster it raises, as no other folder is known to be shared.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's own setting: shuffle files go when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Spark's own setting: rows of an Arrow batch.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the jobs inside; what was set before comes back."""
    keys = {CLEANUP: "true"} | {BATCH_ROWS if k == "batch_rows" else k: v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def checkpointed(df: DataFrame, batch_rows: int = 10_000) -> DataFrame:
    """``df`` computed and kept in the shared checkpoint folder; its lineage ends there."""
    scratch(df.sparkSession, "unused")
    with settings(df.sparkSession, batch_rows=str(batch_rows)):
        return df.checkpoint()


def written(df: DataFrame, name: str, batch_rows: int = 10_000) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later reads don't run its plan again, and its shuffle files go."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with settings(spark, batch_rows=str(batch_rows)):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes the files of a table of ``written``, which nothing reads any more."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame | list[str], *names: str) -> list[str]:
    """The names, each with underscores put before it until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in (df if isinstance(df, list) else df.columns)}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def text_of(col: str) -> F.Column:
    """The text column as a string; null counts as empty."""
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def slices(batch: pa.RecordBatch, column: str, rows: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows and about ``most_bytes`` bytes of a column; a longer value is a slice alone."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False) if most_bytes else None
    at = 0
    while at < batch.num_rows:
        n = min(rows, batch.num_rows - at)
        if most_bytes:
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + n]), most_bytes, side="right")))
        yield batch.slice(at, n)
        at += n


def map_batches(
    df: DataFrame,
    read: str,
    fn: Callable[[list], dict[str, Iterable]],
    schema: T.StructType,
    keep: list[str] | None = None,
    rows: int = 256,
    most_bytes: int = 0,
    arrow_in: bool = False,
) -> DataFrame:
    """Adds the columns of ``schema``: ``fn`` gets up to ``rows`` values of column ``read`` and returns a list or Arrow array for each new column.

    ``most_bytes`` also bounds the bytes of text or binary values in a call. ``arrow_in``: ``fn`` gets them as an Arrow
    array, not as a list.

    The columns in ``keep`` (all by default) pass through as Arrow data; a new column that has the name of one of them
    gets an underscore before its own. Small slices bound the Python worker's memory, whatever the size of Spark's own
    Arrow batches.
    """
    keep = df.columns if keep is None else keep
    names = [f.name for f in schema]
    added = [T.StructField(n, f.dataType) for n, f in zip(fresh(keep, *names), schema, strict=True)]
    out = T.StructType([df.schema[c] for c in keep] + added)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, read, rows, most_bytes):
                new = fn(part.column(read) if arrow_in else part.column(read).to_pylist())
                cols = [part.column(c) for c in keep] + [
                    new[n] if isinstance(new[n], pa.Array) else pa.array(new[n], type=f.type) for n, f in zip(names, list(arrow)[len(keep) :], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if c.type != f.type else c for c, f in zip(cols, arrow, strict=True)], schema=arrow
                )

    need = keep if read in keep else [*keep, read]
    return df.select(*[f"`{c}`" for c in need]).mapInArrow(run, out)
