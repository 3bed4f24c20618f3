"""License scans: MinHash bands over overlapping text windows, with DataFrame operations only.

A text's words make shingles of five. A template of m shingles belongs to the class of the smallest c in 4, 16, 64,
256, ... that is m or more; windows of 2c shingles start every c shingles, so a copy of the template lies whole in one.
A sketch is the ``rows_kept`` smallest of the shingles' 64-bit hashes, and each of them is a band of one row. If a
window and a template have similarity J (shared shingles over all), the chance that no band agrees is
(1 - J) ** rows_kept: the smallest hashes of both together are in both sketches wherever they are in both sets. A
window that contains 0.8 of a template of m > c / 4 shingles has J of 0.099 or more, so with 64 rows it is missed with
a chance of 0.0013 at most. Windows of the classes up to 64 are no longer than twice a sketch: there, all shingles are
keys, and nothing is missed.

Bands only name candidates, as pairs of a text and a template. The candidates' texts are read again, and the share of
the template's shingles that a window contains is counted on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, text_of, written
from .license_texts import TEMPLATES

#: Templates, or candidates, up to so many rows are broadcast to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: The window classes; a template longer than the last one belongs to it.
CLASSES = [4**k for k in range(1, 11)]


def templates(spark: SparkSession, rows: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(``license``, ``text``)"""
    return spark.createDataFrame(rows, "license string, text string")


def with_words(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the words of the text: runs of letters and digits, in lower case. A column of its own is split once."""
    return rows.withColumn("words_", F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def shingles(width: int, make) -> Column:
    """``make`` of the words of each shingle, repeats included; null where a text has fewer words."""
    at = lambda i: make(*[F.get(F.col("words_"), i + k) for k in range(width)])
    return F.when(F.size("words_") >= width, F.transform(F.sequence(F.lit(0), F.size("words_") - width), at))


def sketch(hashes: Column, rows_kept: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, rows_kept)


def windows(n: Column, c: Column | int) -> Column:
    """The numbers of the windows of n shingles."""
    return F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(n / F.lit(c) if isinstance(c, int) else n / c).cast("int") - 1) - 1)


def candidates(texts: DataFrame, known: DataFrame, width: int, rows_kept: int, whole_to: int) -> DataFrame:
    """Different (``id``, ``t``): texts (``id``, ``text``) and templates (``t``, ``c``, ``s``: hashes) that share a band."""
    sizes = known.agg(F.count(F.lit(1)).alias("n"), F.collect_set("c").alias("classes")).first()
    hashes = with_words(texts, F.col("text")).select("id", shingles(width, F.xxhash64).alias("s")).where("s IS NOT NULL")
    tagged = lambda c, keys: F.transform(keys, lambda x: F.xxhash64(F.lit(c), x))
    window_keys = lambda c: F.flatten(F.transform(windows(F.size("s"), c), lambda k: sketch(F.slice(F.col("s"), k * c + 1, 2 * c), rows_kept)))
    large = sorted(c for c in sizes.classes if c > whole_to)
    parts = [F.array_distinct("s")] * any(c <= whole_to for c in sizes.classes) + [tagged(c, window_keys(c)) for c in large]
    keys = hashes.select("id", F.explode(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("key"))
    own = F.when(F.col("c") <= whole_to, F.array_distinct("s")).otherwise(F.transform(sketch(F.col("s"), rows_kept), lambda x: F.xxhash64(F.col("c"), x)))
    ours = known.select("t", F.explode(own).alias("key"))
    return keys.join(F.broadcast(ours) if sizes.n <= BROADCAST_ROWS else ours, "key").select("id", "t").distinct()


def license_scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5, rows_kept: int = 64, whole_to: int = 64) -> DataFrame:
    """One row per document and licence found: id, ``license``, ``containment``, ``first_shingle``.

    ``containment`` is the largest share of a template's different shingles in one window, ``least`` or more;
    ``first_shingle`` is the start of the first such window. ``rows_kept`` is the size of a sketch, and ``whole_to``
    the largest class without sketches. Null and empty texts, and those of under ``width`` words, have no match, as
    have such templates. Repeated rows count as one document, and rows with a null id as one. Columns beyond id and
    text don't matter; empty tables give no rows. A text's words and shingles are in one task's memory at a time.
    """
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    known = with_words(templates.select("license", text_of("text").alias("text")).distinct(), F.col("text"))
    known = known.select("license", "text", F.xxhash64("license", "text").alias("t"), shingles(width, F.xxhash64).alias("s"), F.array_distinct(shingles(width, lambda *w: F.concat_ws(" ", *w))).alias("parts"))
    classes = F.array(*map(F.lit, CLASSES))
    known = known.where("s IS NOT NULL").withColumn("m", F.size("parts")).withColumn("c", F.coalesce(F.get(F.filter(classes, lambda x: x >= F.col("m")), F.lit(0)), F.lit(CLASSES[-1])))
    if known.isEmpty():
        return texts.select(F.col("id").alias(id_col), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_shingle")).where(F.lit(False))
    pairs = written(candidates(texts, known, width, rows_kept, whole_to), "candidates")
    few = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    mine = pairs.select(F.col("id").alias("id_"), "t")
    met = texts.join(F.broadcast(mine) if few else mine, F.col("id").eqNullSafe(F.col("id_"))).select("id", "text", "t")
    split = with_words(met, F.col("text")).select("id", "t", shingles(width, lambda *w: F.concat_ws(" ", *w)).alias("s"))
    small = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ours = known.select("t", "license", "parts", "m", "c")
    both = split.join(F.broadcast(ours) if small else ours, "t")
    share = lambda k: F.size(F.array_intersect(F.slice(F.col("s"), k * F.col("c") + 1, 2 * F.col("c")), F.col("parts"))) / F.col("m")
    shares = both.select("id", "license", "c", F.transform(windows(F.size("s"), F.col("c")), share).alias("shares"))
    found = shares.where(F.array_max("shares") >= least).withColumn("at", (F.array_position(F.transform("shares", lambda x: x >= least), True).cast("int") - 1) * F.col("c"))
    return found.groupBy(F.col("id").alias(id_col), "license").agg(F.max(F.array_max("shares")).alias("containment"), F.min("at").alias("first_shingle"))
