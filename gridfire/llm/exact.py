"""Exact dedup by 128-bit content hash, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, text_of


def content_hash(text: Column) -> Column:
    """The 128-bit content hash, as 16 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=content_hash) -> DataFrame:
    """One row per different text: ``h``, ``text_sha256``, ``keep_id``, ``group_size``.

    The grouping key is the hash and the text itself: Spark compares the bytes of texts of equal hash, so a hash
    collision never joins two texts. Partial aggregation reduces copies before the shuffle, so a group of any size
    sends one row from each map task.
    """
    pick = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).withColumn("h", digest(F.col("text")))
    return (
        rows.groupBy("h", "text")
        .agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=content_hash) -> DataFrame:
    """All rows and columns of ``docs`` with ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` added.

    ``keep`` names the id that stays of each group of equal texts: "smallest" or "largest". The text is compared as
    it is, without any change. Null text counts as empty. Null ids never win over others; a group of null ids only
    has ``keep_id`` null and is kept. Rows repeated with the same id and text are one document: each of them is
    marked as its group says. A table without rows gives no rows. Columns of ``docs`` named like one of the new
    ones stay, and the new one gets an underscore before its name.

    Members find their class by the content hash and the SHA-256 of the text, so two texts of one hash keep their
    own classes here as well. Only digests and ids meet in this join; Spark splits a hot class (skew join).
    """
    h, sha, keep_id, size, kept = fresh(docs, "h", "text_sha256", "keep_id", "group_size", "kept")
    rows = docs.withColumns({h: digest(text_of(text_col)), sha: F.sha2(text_of(text_col).cast("binary"), 256)})
    class_h, class_sha, class_keep, class_n = fresh(rows, "class_h", "class_sha", "class_keep", "class_n")
    classes = exact_classes(docs, id_col, text_col, keep, digest).toDF(class_h, class_sha, class_keep, class_n)
    on = (F.col(f"`{h}`") == F.col(f"`{class_h}`")) & (F.col(f"`{sha}`") == F.col(f"`{class_sha}`"))
    joined = rows.join(classes, on, "inner")
    return joined.select(
        *[f"`{c}`" for c in docs.columns],
        F.col(f"`{class_keep}`").alias(keep_id),
        F.col(f"`{class_n}`").alias(size),
        F.col(f"`{id_col}`").eqNullSafe(F.col(f"`{class_keep}`")).alias(kept),
        F.col(f"`{sha}`").alias(sha),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each group of equal texts, in the columns it has.

    One shuffle by hash and text; the row that stays brings its other columns along. Rows repeated with one id and
    text count as copies of each other, so one of them stays.
    """
    pick, absent = {"smallest": (F.min_by, F.isnull), "largest": (F.max_by, F.isnotnull)}[keep]
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        text_of(text_col).alias("text"),
        F.struct(F.col(f"`{text_col}`").isNull().alias("null_text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]).alias("row"),
        F.struct(absent(F.col(f"`{id_col}`")), F.col(f"`{id_col}`")).alias("rank"),
    ).withColumn("h", content_hash(F.col("text")))
    once = rows.groupBy("h", "text").agg(pick("row", "rank").alias("row"))
    back = {c: F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)}
    return once.select(*[F.when(~F.col("row.null_text"), F.col("text")).alias(c) if c == text_col else back[c] for c in docs.columns])
