"""Pairs of texts by the Jaccard similarity of their word shingles: MinHash bands for candidates, exact verification."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from xxhash import xxh3_128_digest, xxh64_intdigest

from .common import map_batches, text_of, written
from .components import connected_components

#: A pair of similarity 0.8 shares no band with a chance of (1 - 0.8 ** ROWS) ** BANDS, or 2 in 100,000; of 0.85, 4 in 100 million.
BANDS, ROWS = 36, 6
#: Rows of an Arrow batch where rows hold whole texts.
SMALL = 500
_RANDOM = np.random.default_rng(42)
FLIPS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64)
FACTORS = _RANDOM.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
MIX = _RANDOM.integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)


def shingle_hashes(text: str, width: int = 5) -> np.ndarray:
    """The different hashes of a text's word shingles, ascending; words as in ``simhash.fingerprint``, fewer words make one shingle."""
    words = text.encode().lower().split()
    k = min(width, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends + 1))
    n = len(words) - k + 1 if words else 0
    return np.unique(np.fromiter((xxh64_intdigest(joined[s:e]) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n))


def bands(hashes: np.ndarray, block: int = 512) -> np.ndarray:
    """One number for each band: its minima, mixed. Blocks of shingles bound the memory of very long texts."""
    low = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), block):
        low = np.minimum(low, ((hashes[at : at + block, None] ^ FLIPS) * FACTORS).min(axis=0))
    return (low.reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def similar(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose ``texts`` (``id``, ``text``) have a Jaccard similarity of ``least`` or more."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")
    out = both.select("a", "b").schema
    schema = to_arrow_schema(out)

    def run(batches):
        hashes = lru_cache(64)(lambda t: shingle_hashes(t, width))
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                s, t = hashes(x.as_py()), hashes(y.as_py())
                shared = len(np.intersect1d(s, t, assume_unique=True)) if least * max(len(s), len(t)) <= min(len(s), len(t)) + 1e-9 else 0
                keep.append(shared >= least * (len(s) + len(t) - shared) - 1e-9)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("a", "b")], schema=schema)

    return both.mapInArrow(run, out).distinct()


def prefix_pairs(sets: DataFrame, labels: DataFrame, least: float, step: float = 1.02) -> DataFrame:
    """Pairs (``a``, ``b``) of different labels that may have a similarity of ``least`` or more: none that has is missing.

    ``sets`` has ``id`` and ``shingles`` (hashes, each once); ``labels`` (``node``, ``component``) may leave ids out.
    Sets of n and m shingles at that similarity share least / (1 + least) * (n + m), so in any order of all shingles,
    rare ones first, each side holds a shared one among its first. How many are the first depends on the size of the
    other side, hence keys are a shingle with a class of sizes (each ``step`` times the one before) of the smaller set;
    a set stands for its own class and looks into the classes of what it may be similar to. Where one label holds most
    rows of a key, only what is of another label meets them, so a large group of known copies makes no pairs.
    """
    size_class = lambda n: F.floor(F.log(n) / F.lit(float(np.log(step))) + 1e-9)
    share = least / (1 + least)
    first = lambda n, other: n - F.ceil(share * (n + other) - 1e-9) + 1
    lowest = lambda k: F.greatest(F.lit(1), F.ceil(F.pow(F.lit(step), k) * (1 - 1e-9) - 1e-6))
    n = F.col("n")
    named = sets.join(labels, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("label"), F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    ranked = named.join(named.groupBy("s").agg(F.count(F.lit(1)).alias("df")), "s").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy("df", "s")))
    smallest = F.ceil(least * n - 1e-9)
    ranked = written(ranked.where((F.col("at") <= n - smallest + 1) & (F.col("df") > 1)).drop("df"), "ranked")
    short = ranked.withColumn("k", size_class(n)).where(F.col("at") <= first(n, lowest(F.col("k")))).drop("at")
    long = ranked.withColumn("k", F.explode(F.sequence(size_class(smallest), size_class(n)))).where(F.col("at") <= first(n, F.greatest(lowest(F.col("k")), smallest))).drop("at")
    counts = short.union(long.select(short.columns)).groupBy("k", "s", "label").agg(F.count(F.lit(1)).alias("rows"))
    main = counts.groupBy("k", "s").agg(F.max_by("label", "rows").alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("k", "s", "main")
    short, long = short.join(main, ["k", "s"]), long.join(main, ["k", "s"]).select("k", "s", "main", F.col("id").alias("id_"), F.col("label").alias("label_"), F.col("n").alias("n_"))

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        fits = (F.col("label") != F.col("label_")) & (least * F.greatest("n", "n_") <= F.least("n", "n_") + 1e-9)
        return x.drop("main").join(y.drop("main"), ["k", "s"]).where(fits).select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b"))

    return meet(short.where("label <> main"), long).union(meet(short.where("label = main"), long.where("label_ <> main"))).distinct()


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, few: int = 16, joined: DataFrame | None = None) -> DataFrame:
    """Edges (``a``, ``b``) of ids, which join documents of similarity ``least`` or more; they give the groups, not all pairs.

    Documents of equal shingles form a class first, named by its smallest id. Classes that share a band are candidates.
    In a band of ``few`` classes or less all pairs are verified. In a larger one each class is verified against the
    band's hub, the class that is in the largest bands; that joins nearly all of a group of copies, in proportion to
    its size. What is not joined then is found by ``prefix_pairs`` over all classes of large bands, so no link between
    two groups is lost there. Edges that are known already can be given as ``joined``: what they join isn't compared
    again in that step. Texts without a word are one class; rows with a null id have no edge.
    """
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))

    def digest(texts: list) -> dict[str, list]:
        sets = [shingle_hashes(t, width) for t in texts]
        return {"set": [xxh3_128_digest(s.tobytes()) for s in sets], "bands": [bands(s) if len(s) else None for s in sets]}

    known = written(map_batches(rows, "text", digest, T.StructType().add("set", "binary").add("bands", T.ArrayType(T.LongType())), keep=["id"], rows=64), "known", SMALL)
    classes = known.groupBy("set").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("bands").alias("bands"))
    copies = known.select("id", "set").join(classes.where("rep <> last").select("set", "rep"), "set").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    banded = classes.select(F.col("rep").alias("id"), F.posexplode("bands").alias("band", "value")).distinct()
    full = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(banded.join(full, ["band", "value"]), "shared")
    texts = written(rows.join(shared.select("id").distinct(), "id", "left_semi"), "texts")
    small, large = shared.where(F.col("n") <= few).drop("n"), shared.where(F.col("n") > few)
    inner = small.join(small.select("band", "value", F.col("id").alias("other")), ["band", "value"]).where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    weights = large.groupBy("id").agg(F.sum("n").alias("weight"))
    hubs = large.join(weights, "id").groupBy("band", "value").agg(F.max_by("id", F.struct("weight", "id")).alias("hub"))
    outer = large.join(hubs, ["band", "value"]).where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    links = written(similar(inner.union(outer).distinct(), texts, width, least), "links", SMALL)
    members = written(weights.select("id"), "members")
    if members.isEmpty():
        return copies.union(links)
    shingles = T.StructType().add("shingles", T.ArrayType(T.LongType()))
    sets = map_batches(texts.join(members, "id", "left_semi").dropDuplicates(["id"]), "text", lambda xs: {"shingles": [shingle_hashes(x, width).view(np.int64) for x in xs]}, shingles, keep=["id"])
    sets = written(sets, "sets", SMALL)
    rest = similar(prefix_pairs(sets, connected_components(links if joined is None else links.union(joined)), least), texts, width, least)
    return copies.union(links).union(written(rest, "rest", SMALL))
