"""Benchmark decontamination: n-gram seeds join passages of the texts to items, then Smith-Waterman alignment of words."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import dropped, fresh, text_of, written

WORDS = re.compile(r"\w+")
#: Odd factors of 64 bits, for hashes of grams and for their slots.
ODD, SPREAD = np.uint64(0x1E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

SEEDS = T.StructType().add("item", "string").add("k", "integer").add("code", "long").add("place", "integer").add("slot", "integer").add("level", "integer")
PASSAGES = T.StructType().add("key", "string").add("start", "integer").add("words", "string").add("codes", T.ArrayType(T.LongType())).add("places", T.ArrayType(T.IntegerType()))
MATCHES = T.StructType().add("key", "string").add("item", "string").add("score", "double").add("first_word", "long").add("end_word", "long")


class WordHashes(dict):
    """64-bit hashes of words, kept for the words met so far."""

    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[str], most: int = 200_000) -> np.ndarray:
        if len(self) > most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def gram_codes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k words at each position."""
    m = max(len(hashes) - k + 1, 0)
    out = np.full(m, k, np.uint64)
    for j in range(k):
        out = out * ODD + hashes[j : j + m]
    return out


def slots_of(codes: np.ndarray, bits: int) -> np.ndarray:
    return ((codes * SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def slack(words: int, least: float) -> int:
    """How far beyond an item's own length an alignment of score ``least`` can go: more words put in cost more than that leaves."""
    return int(2 * words * (1 - least)) + 1


def smith_waterman(item: np.ndarray, text: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = 1) -> tuple[int, int, int]:
    """The best local alignment of two number sequences: score, and first and last position (exclusive) in the text.

    One numpy row for each word of the item: a gap within the row is a running maximum after adding its cost. The
    start of the alignment travels along with the score. Number 0 matches nothing.
    """
    n = len(text)
    cost = gap * np.arange(n + 1)
    row, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = row[:-1] + np.where((text == word) & (text > 0), match, mismatch)
        up = row[1:] - gap
        here = np.maximum(0, np.maximum(diagonal, up))
        first = np.where(here == 0, np.arange(1, n + 1), np.where(here == diagonal, start[:-1], start[1:]))
        here, first = np.concatenate(([0], here)), np.concatenate(([0], first))
        lifted = np.maximum.accumulate(here + cost)
        source = np.maximum.accumulate(np.where(here + cost == lifted, np.arange(n + 1), 0))
        row, start = lifted - cost, first[source]
        end = int(row.argmax())
        if row[end] > best[0]:
            best = (int(row[end]), int(start[end]), end)
    return best

def shared_words(item: np.ndarray, text: np.ndarray) -> int:
    """How many words of the item the text has, each as often as in both."""
    words, n = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(words, text), len(words) - 1)
    return int(np.minimum(np.bincount(at[words[at] == text], minlength=len(words)), n).sum())

def align(item: list[str], words: list[str], diagonals: list[int], least: float) -> tuple[float, int, int] | None:
    """Score (1 for a full copy), first and last word (exclusive) of the best alignment of an item in a passage, if it reaches ``least``.

    Each diagonal (place of a gram in the passage less that in the item) gives a stretch to align; stretches that touch
    are one. A stretch holds every alignment of score ``least`` through its gram.
    """
    numbers: dict[str, int] = {}
    code = np.array([numbers.setdefault(w, len(numbers) + 1) for w in item], np.int64)
    x = np.array([numbers.get(w, 0) for w in words], np.int64)
    m, wide, best = len(code), slack(len(code), least), (0.0, 0, 0)
    merged: list[list[int]] = []
    for d in sorted(diagonals):
        a, b = max(0, d - wide), min(len(x), d + m + wide)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        part = x[a:b]
        if m * least > shared_words(code, part):  # too few for that score
            continue
        score, first, end = smith_waterman(code, part)
        best = max(best, (score / (2 * m), -(a + first), a + end))
    return (best[0], -best[1], best[2]) if best[0] >= least else None


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def item_seeds(items: DataFrame, n: int, least: float, bits: int) -> DataFrame:
    """The grams of n words of each item (one gram of all its words, where it has fewer), with place, slot, and reach as a level.

    ``items`` has ``item`` (a key of its text) and ``text``. A reach is how many words around the gram an alignment can
    take; its level is 4 times its logarithm to base 2, rounded up.
    """
    schema = to_arrow_schema(SEEDS)

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORDS.findall(text.lower())
                if words:
                    k, m = min(n, len(words)), len(words)
                    codes = gram_codes(hashes.of(words), k)
                    level = int(np.ceil(4 * np.log2(m + slack(m, least))))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([key] * len(codes)), pa.array(np.full(len(codes), k, np.int32)), pa.array(codes.view(np.int64)),
                        pa.array(np.arange(len(codes), dtype=np.int32)), pa.array(slots_of(codes, bits).astype(np.int32)), pa.array(np.full(len(codes), level, np.int32)),
                    ], schema=schema)

    return items.mapInArrow(run, SEEDS)


def seeded_passages(texts: DataFrame, seeds: DataFrame, bits: int) -> DataFrame:
    """The passages of ``texts`` (``key``, ``text``) around what may be seeds, with the grams in them: the columns of ``PASSAGES``.

    A table of ``2**bits`` levels, a byte each whatever the number of items, tells the tasks which grams may be seeds; the
    join with the seeds sorts out the rest. Passages that touch are one, so none is longer than its text.
    """
    known = seeds.groupBy("slot", "k").agg(F.max("level").alias("level")).toArrow()
    levels = np.zeros(1 << bits, np.uint8)
    np.maximum.at(levels, known["slot"].to_numpy(), known["level"].to_numpy().astype(np.uint8))
    shared = texts.sparkSession.sparkContext.broadcast((levels, sorted(set(known["k"].to_pylist()))))
    schema = to_arrow_schema(PASSAGES)

    def run(batches):
        levels, sizes = shared.value
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = WORDS.findall(text.lower())
                    h = hashes.of(words)
                    found = []
                    for k in sizes:
                        codes = gram_codes(h, k)
                        level = levels[slots_of(codes, bits)]
                        places = np.flatnonzero(level)
                        found.append((places, codes[places].view(np.int64), level[places]))
                    places, codes, level = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
                    if not len(places):
                        continue
                    reach = np.ceil(2 ** (level / 4)).astype(np.int64)
                    first, end = np.maximum(places - reach, 0), np.minimum(places + reach, len(words))
                    order = np.argsort(first, kind="stable")
                    first, end, places, codes = first[order], np.maximum.accumulate(end[order]), places[order], codes[order]
                    cuts = [0, *(np.flatnonzero(first[1:] > end[:-1]) + 1).tolist(), len(first)]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        start = int(first[a])
                        rows.append((key, start, " ".join(words[start : int(end[b - 1])]), codes[a:b], (places[a:b] - start).astype(np.int32)))
                if rows:
                    yield batch_of(rows, schema)

    return texts.mapInArrow(run, PASSAGES)


def matches(texts: DataFrame, items: DataFrame, n: int, least: float, bits: int) -> DataFrame:
    """The best alignment of each text and item that reaches ``least``, in the columns of ``MATCHES``; each different text and item counts once.

    Seeds and grams of passages meet in a Spark join on their hash; grams that are in many texts are split there by Spark
    (skewed partitions), as none may be left out. Hashes only name pairs, which are aligned as words.
    """
    seeds = item_seeds(items, n, least, bits)
    passages = written(seeded_passages(texts, seeds, bits).dropDuplicates(["key", "start"]), "passages")
    grams = passages.select("key", "start", F.explode(F.arrays_zip("codes", "places")).alias("gram")).select("key", "start", F.col("gram.codes").alias("code"), F.col("gram.places").alias("at"))
    pairs = grams.join(seeds.select("item", "code", "place"), "code").groupBy("key", "start", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals"))
    pairs = pairs.join(passages.select("key", "start", "words"), ["key", "start"]).join(items, "item").select("key", "item", "start", "words", "text", "diagonals")
    schema = to_arrow_schema(MATCHES)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for key, item, start, words, text, diagonals in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    if (best := align(WORDS.findall(text.lower()), words.split(" "), diagonals, least)) is not None:
                        rows.append((key, item, best[0], start + best[1], start + best[2]))
                if rows:
                    yield batch_of(rows, schema)

    best = pairs.mapInArrow(run, MATCHES).groupBy("key", "item").agg(F.max(F.struct("score", (-F.col("first_word")).alias("before"), "end_word")).alias("best"))
    out = written(best.select("key", "item", "best.score", (-F.col("best.before")).alias("first_word"), "best.end_word"), "matches")
    dropped(passages)
    return out


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 3, least: float = 0.5, bits: int = 24) -> DataFrame:
    """One row per document and item that it holds a copy of: id, item id, ``score``, ``first_word``, ``end_word``.

    Seeds are all word n-grams of an item: a common one may be all that a partial copy shares with it. Texts with a
    seed are aligned with the item around it; the score is that of the best alignment (match 2, mismatch -1, gap -1)
    divided by that of a full copy. An alignment is found if it holds a run of ``n`` words of its item; one of score over
    0.5 without words put in always does, for the default n. Texts are read once for the passages around seeds, whatever
    the number of items (``bits``: ``seeded_passages``), and once for their ids; only passages and keys of texts are
    shuffled. Null and empty texts and items match nothing; repeated rows are reported as often as they come; empty
    tables give no rows. If both ids have one name, the item's gets an underscore.
    """
    (item_name,) = fresh([id_col], item_id)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), text_of(text_col).alias("text")).withColumn("key", F.sha2("text", 256))
    known = items.select(F.col(f"`{item_id}`").alias("id"), text_of(item_text).alias("text")).withColumn("item", F.sha2("text", 256))
    found = matches(rows.select("key", "text"), known.select("item", "text").dropDuplicates(["item"]), n, least, bits)
    return rows.select("doc", "key").join(found, "key").join(known.select("id", "item"), "item").select(
        F.col("doc").alias(id_col), F.col("id").alias(item_name), "score", "first_word", "end_word"
    )


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 3, least: float = 0.5, bits: int = 24) -> DataFrame:
    """``docs``, in the columns it has, without the documents in which ``find_leaks`` finds an item.

    Null and empty texts stay, as does each of repeated rows without a match; without items all rows stay. Texts with a
    match are known by the SHA-256 of the text; Spark broadcasts these if they are few.
    """
    (key,) = fresh(docs, "key_")
    known = items.select(text_of(item_text).alias("text")).select(F.sha2("text", 256).alias("item"), "text").dropDuplicates(["item"])
    found = matches(docs.select(F.sha2(text_of(text_col), 256).alias("key"), text_of(text_col).alias("text")), known, n, least, bits)
    return docs.withColumn(key, F.sha2(text_of(text_col), 256)).join(found.select(F.col("key").alias(key)).distinct(), key, "left_anti").select(*[f"`{c}`" for c in docs.columns])
