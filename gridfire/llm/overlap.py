"""Exact Jaccard join of texts by their word n-grams, by vertical partitioning of one global order of n-grams.

The order puts rare n-grams first (by the power of two of the number of sets that hold them, then by hash). It is cut
into fragments, and with it every set into segments. Of a candidate pair the overlap is counted in each fragment on its
own, as one row, and the sum over its fragments is the whole overlap. So no row holds more than a set's n-grams of one
fragment, and a long text's segments meet in different tasks.

Which pairs are candidates, without a chance to miss one:

* Sets that can't be similar to any other leave first. In any order, a similar pair's first common n-grams lie among
  the first ones of both sides, so each set is looked at by its lowest hashes, and stays if enough of those occur in
  other sets. What stays is looked at whole: most n-grams of a set must occur elsewhere.
* Equal sets are one.
* A pair must share an n-gram among the first of both, and how many are the first follows from both sizes.

Large groups of near copies make no pairs of all: each set meets one set for each of its first n-grams, the one that
holds the most frequent n-grams. That joins most of a group. Then only what is still apart meets, and where one group
holds most rows of an n-gram, only what is outside it meets them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from .common import dropped, fresh, map_batches, text_of, written
from .components import connected_components
from .jaccard import shingle_hashes

#: Ids of candidates that go to all tasks at most; more meet the texts in a shuffle.
BROADCAST_IDS = 500_000
#: Fragments for each power of two of document counts (a power of two itself), and the ratio of two size classes.
SLICES, STEP = 4, 1.02
#: Rows of an Arrow batch where rows hold whole texts or sets.
SMALL = 500


def need(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of sets of ``n`` and ``m`` n-grams: percent * union <= 100 * overlap."""
    return F.ceil(percent * (n + m) / F.lit(100.0 + percent) - 1e-9)


def lowest(n: int, percent: int) -> tuple[int, int]:
    """(how many of a set's lowest hashes to look at, how many of them must occur in another set's lowest ones)

    Of n n-grams, at most n - ceil(n * percent / 100) are in no similar set, so among that many and 1 + n / 5 more
    some 1 + n / 5 are common. The other side's fifth may be smaller, as its set may be.
    """
    least = -(-n * percent // 100)
    return min(n, n - least + 1 + n // 5), 1 + least // 5


def digested(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Of each row its id, ``n`` (n-grams), ``set`` (a digest of them), ``low`` (its lowest hashes), ``enough`` (how many must be shared)."""

    def digest(texts: list) -> dict[str, list]:
        sets = [shingle_hashes(t, width) for t in texts]
        cut = [lowest(len(s), percent) for s in sets]
        return {
            "n": [len(s) for s in sets], "set": [xxh3_128_digest(s.tobytes()) for s in sets],
            "low": [s[:k].view("int64") for s, (k, _) in zip(sets, cut, strict=True)], "enough": [k for _, k in cut],
        }

    schema = T.StructType().add("n", "long").add("set", "binary").add("low", T.ArrayType(T.LongType())).add("enough", "long")
    return map_batches(rows, "text", digest, schema, keep=["id"], rows=64)


def candidates(known: DataFrame) -> DataFrame:
    """Ids of ``digested`` rows with enough shared n-grams among their lowest ones."""
    low = known.where("n > 0").select("id", F.explode("low").alias("h"))
    shared = low.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("h")
    found = low.join(shared, "h").groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    return found.join(known.select("id", "enough"), "id").where("shared >= enough").select("id").distinct()


def segments(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (``set``, ``n``, ``v``: fragment, ``seg``: hashes in order, ``before``: n-grams of the set before them, ``centre``).

    N-grams of no other set have no row; they come first in the order, so they count in ``before``. Sets of which too
    many n-grams occur in no other set have no row. ``centre`` is higher the more sets share the set's n-grams.
    """
    grams = sets.select("set", "n", F.explode("shingles").alias("s"))
    level = F.floor(F.log2("df")).cast("int")
    df = grams.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("s", level.alias("level"))
    # hashes in signed order, in both the fragments and the arrays
    part = (F.shiftright("s", 64 - SLICES.bit_length() + 1) + SLICES // 2).cast("int")
    held = grams.join(df, "s").groupBy("set", "n", "level", part.alias("part")).agg(F.sort_array(F.collect_list("s")).alias("seg"))
    whole, size = Window.partitionBy("set"), F.size("seg")
    placed = held.withColumn("v", F.col("level") * SLICES + F.col("part")).withColumn("shared", F.sum(size).over(whole))
    return (
        placed.where(100 * F.col("shared") >= percent * F.col("n"))
        .withColumn("centre", F.sum(size * F.pow(F.lit(2.0), "level")).over(whole) / F.col("n"))
        .withColumn("before", F.col("n") - F.col("shared") + F.coalesce(F.sum(size).over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("set", "n", "v", "seg", "before", "centre")
    )


def prefixes(cut: DataFrame, percent: int) -> DataFrame:
    """Rows (``set``, ``n``, ``centre``, ``s``, ``at``: place in the order from 1) of the n-grams of which a similar pair shares one."""
    n = F.col("n")
    last = n - F.ceil(n * percent / F.lit(100.0) - 1e-9) + 1
    few = F.slice("seg", F.lit(1), F.least(F.size("seg"), last - F.col("before")).cast("int"))
    return cut.where(F.col("before") < last).select("set", "n", "centre", F.col("before"), F.posexplode(few).alias("k", "s")).select("set", "n", "centre", "s", (F.col("before") + F.col("k") + 1).alias("at"))


def hub_pairs(first: DataFrame, percent: int) -> DataFrame:
    """Each set with the most central set of each of its first n-grams, where their sizes and places allow it."""
    hubs = first.groupBy("s").agg(F.max(F.struct("centre", "set", "n", "at")).alias("hub"), F.count(F.lit(1)).alias("held")).where("held > 1").drop("held")
    met = first.join(hubs, "s").where(F.col("set") != F.col("hub.set"))
    c = need(F.col("n"), F.col("hub.n"), percent)
    fits = (F.col("at") <= F.col("n") - c + 1) & (F.col("hub.at") <= F.col("hub.n") - c + 1)
    return met.where(fits).select(F.least("set", "hub.set").alias("a"), F.greatest("set", "hub.set").alias("b")).distinct()


def apart_pairs(first: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All candidates of different labels; ``labels`` (``node``, ``component``) leaves out what is joined with nothing.

    The first n-grams that must hold a common one are fewer the larger the other set is. So keys are an n-gram with a
    size class of the smaller set; a set stands for its own class, and looks into those of what it may be similar to.
    """
    n = F.col("n")
    size_class = lambda x: F.floor(F.log(x.cast("double")) / F.lit(math.log(STEP)) + 1e-9)
    floor_of = lambda k: F.greatest(F.lit(1), F.ceil(F.pow(F.lit(STEP), k) * (1 - 1e-9) - 1e-6))  # noqa: E731  smallest size of a class
    smallest = F.ceil(n * percent / F.lit(100.0) - 1e-9)
    named = first.join(labels.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("label", F.coalesce("component", "set")).drop("component", "centre")
    short = named.withColumn("k", size_class(n)).where(F.col("at") <= n - need(n, n, percent) + 1)
    long = named.withColumn("k", F.explode(F.sequence(size_class(smallest), size_class(n))))
    long = long.where(F.col("at") <= n - need(n, F.greatest(floor_of(F.col("k")), smallest), percent) + 1)
    counts = short.select("k", "s", "label").union(long.select("k", "s", "label")).groupBy("k", "s", "label").agg(F.count(F.lit(1)).alias("rows"))
    main = counts.groupBy("k", "s").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").drop("labels")
    short, long = (side.join(main, ["k", "s"]) for side in (short, long))
    long = long.select("k", "s", "main", *[F.col(c).alias(f"{c}_") for c in ("set", "label", "n", "at")])

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        c = need(n, F.col("n_"), percent)
        fits = (F.col("label") != F.col("label_")) & (n <= F.col("n_")) & (F.col("at") <= n - c + 1) & (F.col("at_") <= F.col("n_") - c + 1)
        return x.drop("main").join(y.drop("main"), ["k", "s"]).where(fits).select(F.least("set", "set_").alias("a"), F.greatest("set", "set_").alias("b"))

    return meet(short.where("label <> main"), long).union(meet(short.where("label = main"), long.where("label_ <> main"))).distinct()


def linked(pairs: DataFrame, cut: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) that are similar: overlaps are counted by fragment, and summed by pair."""
    x = cut.select(F.col("set").alias("a"), F.col("n").alias("na"), "v", F.col("seg").alias("x"))
    y = cut.select(F.col("set").alias("b"), F.col("n").alias("nb"), "v", F.col("seg").alias("y"))
    part = pairs.join(x, "a").join(y, ["b", "v"]).select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("both"))
    whole = part.groupBy("a", "b").agg(F.sum("both").alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return whole.where((100 + percent) * F.col("both") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles``, ``component_id``.

    A document's set holds the different shingles of ``width`` words of its text (A-Z in lower case, words between
    ASCII white space; fewer words make one shingle). Documents link where 100 * overlap >= ``percent`` * union, and
    a component's id is the smallest document id that links reach. Shingles are known by 64-bit hashes.

    Null and empty texts have no set, link with nothing and are their own component. Repeated rows link with each
    other like any copies. Rows with a null id have a null component and make no links. An empty table gives no rows.
    """
    n_name, component = fresh([id_col], "n_shingles", "component_id")
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    known = written(digested(rows, width, percent), "known", SMALL)
    live = written(candidates(known.where("id IS NOT NULL")), "live")
    few = live.count() <= BROADCAST_IDS
    texts = rows.join(F.broadcast(live) if few else live, "id", "left_semi")
    whole = T.StructType().add("set", "binary").add("n", "long").add("shingles", T.ArrayType(T.LongType()))

    def sets_of(batch: list) -> dict[str, list]:
        sets = [shingle_hashes(t, width) for t in batch]
        return {"set": [xxh3_128_digest(s.tobytes()) for s in sets], "n": [len(s) for s in sets], "shingles": [s.view("int64") for s in sets]}

    sets = written(map_batches(texts, "text", sets_of, whole, keep=[], rows=64).where("n > 0").groupBy("set", "n").agg(F.first("shingles").alias("shingles")), "sets", SMALL)
    dropped(live)
    cut = written(segments(sets, percent), "segments")
    dropped(sets)
    first = written(prefixes(cut, percent), "first")
    near = written(linked(hub_pairs(first, percent), cut, percent), "near")
    rest = written(linked(apart_pairs(first, connected_components(near), percent), cut, percent), "rest")
    dropped(cut)
    dropped(first)
    groups = connected_components(near.union(rest)).select(F.col("node").alias("set"), F.col("component").alias("group"))
    dropped(near)
    dropped(rest)
    # of each set the smallest id, of each group the smallest of those
    least = known.where("n > 0 AND id IS NOT NULL").groupBy("set").agg(F.min("id").alias("own"))
    named = least.join(groups, "set", "left").withColumn("group", F.coalesce("group", "set"))
    reached = named.groupBy("group").agg(F.min("own").alias("reached"))
    named = named.join(reached, "group").select("set", "reached")
    told = known.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("set")).alias("set")).join(named, "set", "left")
    return told.select(F.col("id").alias(id_col), F.col("n").alias(n_name), F.coalesce("reached", "id").alias(component))
