"""Ranked lexical search: a set of items against all documents, as dense matrix products in whole numbers.

Items are the queries. They are dealt to blocks of bounded size, each with its own vocabulary, and a block reads the
texts once: a document becomes its item terms with their counts (a written table), from which Spark counts how many
documents hold a term. Scoring goes over that table: some items with their compact vocabulary are one tile, documents
with their impacts on that vocabulary another, and their product gives all scores of the tile.

Weights and impacts are whole numbers in float64. A product is exact as long as its partial sums stay below 2 ** 53,
so the vocabulary of a tile (and a very large weight) is cut where they might not, and the parts are added as 64-bit integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import slices, written

#: No impact is above this: (SCALE * tf) div (1000 * tf + 8 * m).
IMPACT = 1_000_000
SCALE = 1_000_000_000
#: Weights that are too large for one product are cut into a lower and a higher part at this power of two.
DIGIT = 1 << 24
#: About how many different (item, term) rows a block of items has, items of a tile, documents of a tile, terms of a product.
BLOCK_TERMS, ITEMS, DOCUMENTS, TERMS = 100_000, 64, 512, 4096
#: ASCII letters and digits and all bytes beyond ASCII belong to terms; A-Z become a-z, all else is space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def counted(rows: DataFrame, text_col: str, vocabulary: dict[bytes, int] | None) -> DataFrame:
    """Rows (``id``, ``n``: all terms, ``terms``, ``counts``) of a table ``id``, ``text``; only terms of the vocabulary, as their numbers.

    Without a vocabulary the terms are bytes.
    """
    kind = T.BinaryType() if vocabulary is None else T.IntegerType()
    out = T.StructType([rows.schema["id"]]).add("n", "long").add("terms", T.ArrayType(kind)).add("counts", T.ArrayType(T.IntegerType()))
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 500, 4_000_000):
                n, names, counts = [], [], []
                for text in part.column(text_col).to_pylist():
                    found = terms(text)
                    n.append(len(found))
                    held = Counter(found if vocabulary is None else filter(None, map(vocabulary.get, found)))
                    names.append(list(held.keys()))
                    counts.append(list(held.values()))
                columns = [part.column("id").cast(arrow.field(0).type), pa.array(n, pa.int64()), pa.array(names, arrow.field(2).type), pa.array(counts, arrow.field(3).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return rows.mapInArrow(run, out)


class Tile:
    """Some items over their own vocabulary, as matrices of whole numbers whose products with impacts stay below 2 ** 53."""

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int):
        self.items, row = np.unique(item, return_inverse=True)
        words, column = np.unique(term, return_inverse=True)
        full = np.zeros((len(self.items), len(words)))
        np.add.at(full, (row, column), weight)
        self.column = np.full(size, -1)  # of each word of the block
        self.column[words] = np.arange(len(words))
        self.parts = []  # (first column, weights, power of two that they stand for)
        large = full.max(initial=0) * IMPACT >= 2**53
        for digits, power in [(full % DIGIT, 1), (full // DIGIT, DIGIT)] if large else [(full, 1)]:
            a = 0
            while a < len(words):
                sums = np.cumsum(digits[:, a : a + TERMS], axis=1).max(axis=0)
                b = a + max(1, int(np.searchsorted(sums, 2**53 / IMPACT, side="left")))
                self.parts.append((a, digits[:, a:b], power))
                a = b

    def scores(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, documents: int) -> np.ndarray:
        """Exact scores, items by documents, from the impacts of terms on documents."""
        column = self.column[term]
        total = np.zeros((len(self.items), documents), np.int64)
        for a, weights, power in self.parts:
            mine = (column >= a) & (column < a + weights.shape[1])
            dense = np.zeros((weights.shape[1], documents))
            dense[column[mine] - a, doc[mine]] = impact[mine]
            total += (weights @ dense).astype(np.int64) * power
        return total


class Best:
    """The k best (score, id) of each item so far: higher scores first, of equal scores smaller ids."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score, self.id = np.zeros((items, k), np.int64), np.full((items, k), np.iinfo(np.int64).max)

    def take(self, items: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of a tile, items by documents. Ties with the last place are settled by id, so none is lost."""
        last, held = self.score[items, -1][:, None], self.id[items, -1][:, None]
        row, col = np.nonzero((scores > 0) & ((scores > last) | ((scores == last) & (ids[None, :] < held))))
        rows, again = np.unique(row, return_inverse=True)
        if not len(rows):
            return
        mine = items[rows]
        of = np.concatenate((np.repeat(np.arange(len(rows)), self.k), again))
        score = np.concatenate((self.score[mine].ravel(), scores[row, col]))
        doc = np.concatenate((self.id[mine].ravel(), ids[col]))
        order = np.lexsort((doc, -score, of))
        of, score, doc = of[order], score[order], doc[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        top = place < self.k
        self.score[mine], self.id[mine] = score[top].reshape(-1, self.k), doc[top].reshape(-1, self.k)


def impacts(held: pa.RecordBatch, documents: int, all_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of the batch, term, impact) for every term of the table of ``counted``."""
    lists, counts = held.column("terms"), held.column("counts")
    sizes = np.diff(lists.offsets.to_numpy())
    tf = counts.flatten().to_numpy().astype(np.int64)
    n = [25 + 75 * x * documents // all_terms for x in held.column("n").to_pylist()]
    return np.repeat(np.arange(held.num_rows), sizes), lists.flatten().to_numpy(), SCALE * tf // (1000 * tf + 8 * np.repeat(np.array(n, np.int64), sizes))


def scored(held: DataFrame, item: np.ndarray, term: np.ndarray, weight: np.ndarray, words: int, documents: int, all_terms: int, k: int) -> DataFrame:
    """The ``k`` best documents of each item in each task: (``item``, its number; ``id``, ``score``)."""
    out = T.StructType().add("item", "integer").add("id", "long").add("score", "long")
    arrow = to_arrow_schema(out)
    items = int(item.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = [Tile(item[m], term[m], weight[m], words) for a in range(0, items, ITEMS) if (m := (item >= a) & (item < a + ITEMS)).any()]
        best = Best(items, k)
        for batch in batches:
            for part in slices(batch, "id", DOCUMENTS, 0):
                at, of, impact = impacts(part, documents, all_terms)
                ids = part.column("id").to_numpy()
                for tile in tiles:
                    best.take(tile.items, ids, tile.scores(at, of, impact, part.num_rows))
        of, place = np.nonzero(best.score)
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(best.id[of, place]), pa.array(best.score[of, place])], schema=arrow)

    return held.where(F.col("id").isNotNull() & (F.size("terms") > 0)).select("id", "n", "terms", "counts").mapInArrow(run, out)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, ``rank``, document id, ``score``): the ``k`` best documents with a score above 0 for each item, all if fewer.

    Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased. A term that df of N
    documents with a term hold weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))). A document of n terms, of L in all,
    has m = 25 + (75 n N) div L, and a term that it holds tf times an impact of (10^9 tf) div (1000 tf + 8 m). The score
    is the sum of w times impact over the item's terms, repeats included.

    Equal scores rank by ascending id. Null and empty texts have no term. Ids are whole numbers; rows with a null
    document id count in N, L and df and are not ranked, rows with a null item id are no query. Repeated documents are
    documents of their own; items of the same id are one query of all their texts. Empty tables give no rows.
    Blocks of items hold about ``BLOCK_TERMS`` rows of a term each, or one longer item; each block reads the texts once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    asked = items.where(F.col(f"`{item_col}`").isNotNull()).select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{item_text_col}`").cast("string").alias("text"))
    asked = counted(asked, "text", None).select("id", F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("id", F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("times"))
    asked = written(asked, "items")
    blocks = -(-asked.count() // BLOCK_TERMS)
    found = None
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).orderBy("id", "term").toArrow()
        if not mine.num_rows:
            continue
        names, item = np.unique(mine.column("id").to_pylist(), return_inverse=True)
        words, term = np.unique(np.array(mine.column("term").to_pylist(), object), return_inverse=True)
        held = written(counted(rows, "text", {w: i + 1 for i, w in enumerate(words.tolist())}), "held", 500)
        documents, all_terms = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(words) + 1, np.int64)
        for row in held.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # no more rows than the block has words
            df[row["term"]] = row["count"]
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df[1:].tolist()], np.int64)
        if not documents:
            break
        best = scored(held, item, term + 1, weight[term] * mine.column("times").to_numpy(), len(words) + 1, documents, all_terms, k)
        label = spark.createDataFrame(list(enumerate(names.tolist())), T.StructType().add("item", "integer").add("name_", asked.schema["id"].dataType))
        # the best of some tasks first, then of all
        some = Window.partitionBy("item", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy(F.desc("score"), "id")
        every = Window.partitionBy("item").orderBy(F.desc("score"), "id")
        best = best.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= k).withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)
        best = best.join(F.broadcast(label), "item").select(F.col("name_").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        found = best if found is None else found.union(best)
    if found is None:
        return spark.createDataFrame([], T.StructType().add(item_col, asked.schema["id"].dataType).add("rank", "integer").add(id_col, "long").add("score", "long"))
    return found
