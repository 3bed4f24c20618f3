"""SimHash near-dedup with multi-index hashing over fingerprint segments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import checkpointed, fresh, map_batches, text_of, written
from .components import connected_components
from .jaccard import similar_links

HALF = 0xFFFFFFFF


def fingerprint(text: str, width: int = 3, block: int = 8192) -> int:
    """The 64-bit SimHash of a text, as a signed number.

    A-Z in lower case, words between ASCII white space, shingles of ``width`` words joined by a space, repeats
    included; fewer words make one shingle, none make fingerprint zero. Each shingle hashes by XXH64 with seed 42; a
    bit is 1 if it is set in over half the hashes. Blocks of shingles bound the memory of very long texts.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    ends = ends[min(width, len(words)) - 1 :].tolist()
    starts = starts[:n].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, block):
        h = np.fromiter((xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts[at : at + block], ends[at : at + block], strict=True)), np.uint64, min(block, n - at))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fingerprint", width: int = 3, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a long column of fingerprints, ``_name`` if there is such a column already; null text counts as empty."""
    (text,) = fresh(docs, "text_")
    keep = docs.columns if keep is None else keep
    rows = docs.withColumn(text, text_of(text_col)).select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])])
    return map_batches(rows, text, lambda xs: {name: [fingerprint(x, width) for x in xs]}, T.StructType().add(name, "long"), keep=keep)


def high(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def low(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(HALF))


def parts(half: Column, cuts: tuple[int, ...]) -> list[Column]:
    """A 32-bit number cut at the given bits."""
    edges = [0, *cuts, 32]
    return [F.shiftright(half, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]


def near_pairs(fps: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of the distinct values of long column ``fp`` that differ in 1 or 2 bits; each pair once.

    Multi-index hashing on two 32-bit segments. Of two bits that differ, either all lie in one segment, so that the
    other one matches (a ball of radius 0), or each segment has one (a ball of radius 1 in the high segment). What the
    ball leaves of the distance bounds the other segment, which is cut again by the same pigeonhole: into three parts
    of which one matches, or into two where one bit is left. So table keys hold 43 bits or more, and a bucket holds
    only fingerprints that agree in all of them. A probe flips only 0 to 1, as the other end of the pair is found by
    flipping back. Candidates are verified on all 64 bits.
    """
    key = lambda kind, half, i, part: F.struct(F.lit(kind).cast("tinyint").alias("kind"), half.alias("half"), F.lit(i).cast("tinyint").alias("i"), part.alias("part"))
    fp = F.col("fp")
    same = [key(0, high(fp), i, p) for i, p in enumerate(parts(low(fp), (11, 22)))] + [key(1, low(fp), i, p) for i, p in enumerate(parts(high(fp), (11, 22)))]
    exact = fps.select("fp", F.explode(F.array(*same)).alias("key"))
    table = fps.select("fp", F.explode(F.array(*[key(2, high(fp), i, p) for i, p in enumerate(parts(low(fp), (16,)))])).alias("key"))
    ball = fps.select("fp", F.explode(F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: high(fp).bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))), lambda x: x != high(fp))).alias("other"))
    probes = ball.select("fp", F.explode(F.array(*[key(2, F.col("other"), i, p) for i, p in enumerate(parts(low(fp), (16,)))])).alias("key"))

    def fetch(left: DataFrame, right: DataFrame, where: Column) -> DataFrame:
        both = left.select(F.col("fp").alias("x"), "key.*").join(right.select(F.col("fp").alias("y"), "key.*"), ["kind", "half", "i", "part"])
        return both.where(where & F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).between(1, 2)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    return fetch(exact, exact, F.col("x") < F.col("y")).union(fetch(probes, table, F.lit(True))).distinct()


def simhash_links(fps: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Classes of equal ``fingerprint`` (``fp``, ``rep``: the smallest id) and the links (``a``, ``b``) between their ids."""
    classes = fps.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col("fingerprint").alias("fp")).agg(F.min(id_col).alias("rep"))
    pairs = near_pairs(classes.select("fp"))
    name = lambda side: classes.select(F.col("fp").alias(side), F.col("rep").alias(f"rep_{side}"))
    return classes, pairs.join(name("a"), "a").join(name("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (long), ``component_id``.

    Fingerprints link at 2 or fewer differing bits; a component's id is the smallest document id in it. Documents
    of equal fingerprint form a class first, so copies never make pairs: links run between classes, each named by its
    smallest id. Null text counts as empty, and empty texts have fingerprint zero, which links like any other. Rows
    with a null id take part in no link and have a null component; repeated rows are returned as often as they come.
    """
    fps = checkpointed(fingerprints(docs, text_col, "fingerprint", width, keep=[id_col]), 1000)
    classes, edges = simhash_links(fps, id_col)
    roots = connected_components(edges)
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("fp"), F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, (F.col("fingerprint") == F.col("fp")) & F.col(f"`{id_col}`").isNotNull(), "left").select(F.col(f"`{id_col}`"), "fingerprint", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one of the smallest id; rows with a null id all stay.

    Two documents are near copies if their fingerprints link as in ``simhash_groups``, or if their shingles of
    ``words`` words have a Jaccard similarity of ``least`` or more, at whatever distance their fingerprints are.
    """
    fps = checkpointed(fingerprints(docs, text_col, "fingerprint", width, keep=[id_col]), 1000)
    classes, edges = simhash_links(fps, id_col)
    copies = fps.join(classes, F.col("fingerprint") == F.col("fp")).select(F.col("rep").alias("a"), F.col(f"`{id_col}`").alias("b")).where("a <> b")
    links = written(edges.union(copies), "near")
    roots = connected_components(links.union(similar_links(docs, id_col, text_col, words, least, joined=links)))
    gone = roots.where("component <> node").select(F.col("node").alias("gone_"))
    kept = docs.join(gone, docs[id_col] == gone["gone_"], "left_anti")
    return kept.select(*[f"`{c}`" for c in docs.columns])
