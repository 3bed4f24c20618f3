"""Periodic runs of words: stretches that repeat a shorter stretch at least three times in a row.

Matches at lag d are a diagonal: word i lies on it if it equals word i - d. A run of period d is a long match on its
diagonal. Only few diagonals are ever active. Of each word, the earlier occurrences of the words that end there are
its cells, and only a cell that is on no active diagonal starts one; its match length grows from there word by word,
and where it ends the run is emitted or not, at once.

What bounds the number of cells: a word alone occurs too often, so cells are occurrences of g words, ranked exactly by
doubling (ranks of two neighbouring stretches give the rank of both). Short lags use one g. From there on lags from
2 g to 4 g use g words, and of occurrences at most g / 2 apart, a chain with a smaller period, only the first counts.
Occurrences left are over g / 2 apart, so a word has at most eight cells a level, whatever the text: a run of period d
and three times its length holds a whole period of such words, and one that starts no chain is among them, or the
chain's smaller period would be the run's. So work is in n log n, and constant texts are no special case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import fresh, slices, text_of

#: Words of the texts that are searched at once; a longer text is searched alone.
AT_ONCE = 100_000

RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")
FOUND = T.StructType().add("n_words", "long").add("runs", T.ArrayType(RUN)).add("collapsed", "string")


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """All words as numbers, equal where words of the same text are equal."""
    out, base = np.empty(sum(map(len, texts)), np.int64), 0
    at = 0
    for words in texts:
        seen: dict[bytes, int] = {}
        out[at : at + len(words)] = [seen.setdefault(w, base + len(seen)) for w in words]
        at, base = at + len(words), base + len(seen)
    return out


def repeated(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places the rank of its key, -1 where the key occurs once or the place is not among ``at``."""
    out = np.full(n, -1)
    _, rank, count = np.unique(keys, return_inverse=True, return_counts=True)
    often = count[rank] > 1
    out[at[often]] = rank[often]
    return out


def doubled(rank: np.ndarray, g: int) -> np.ndarray:
    """Ranks of the 2 g words that end at each place, from the ranks of g words."""
    at = np.flatnonzero(rank >= 0)
    at = at[at >= g]
    at = at[rank[at - g] >= 0]
    return repeated(rank[at - g] * (len(rank) + 1) + rank[at], at, len(rank))


def cells(rank: np.ndarray, low: int, high: int, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags, from ``low`` to below ``high``, of equal ranks; of occurrences at most ``chain`` apart the first counts."""
    at = np.flatnonzero(rank >= 0)
    at = at[np.argsort(rank[at], kind="stable")]
    of = rank[at]
    if len(at) and chain:
        first = np.concatenate(([True], (of[1:] != of[:-1]) | (np.diff(at) > chain)))
        at, of = at[first], of[first]
    places, lags = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(1, len(at)):
        lag = at[k:] - at[:-k]
        near = (of[k:] == of[:-k]) & (lag < high)
        if not near.any():
            break
        near &= lag >= low
        places.append(at[k:][near])
        lags.append(lag[near])
    return np.concatenate(places), np.concatenate(lags)


def matched(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words, from ``at`` on forwards (``step`` 1) or backwards (-1), equal the one ``lag`` words before."""
    length, block = 0, 64
    left = len(ids) - at if step > 0 else at - lag + 1
    while length < left:
        n = min(block, left - length)
        a = at + step * length
        low = a if step > 0 else a - n + 1
        other = np.flatnonzero(ids[low : low + n] != ids[low - lag : low - lag + n])
        if len(other):
            return length + int(other[0] if step > 0 else n - 1 - other[-1])
        length, block = length + n, 2 * block
    return length


def find_runs(ids: np.ndarray, longest: int, least: int = 24, times: int = 3) -> np.ndarray:
    """(start, length, period) of all runs of ``ids``, by start and period; no text in it has more than ``longest`` words.

    A run has ``least`` words and ``times`` (3 or more) periods at least, and its period is the smallest it has.
    """
    if times < 3 or least < 1:
        raise ValueError("runs have three periods at least, and one word")
    need = lambda lag: max(least - lag, (times - 1) * lag)  # noqa: E731  words on the diagonal
    fewest = min(need(lag) for lag in range(1, least + 1))
    g, found = 1, []
    rank = repeated(ids, np.arange(len(ids)), len(ids))
    while 2 * g <= fewest:
        rank, g = doubled(rank, g), 2 * g
    low, high, chain = 1, 2 * g, 0
    while times * low <= longest and (rank >= 0).any():
        at, lag = cells(rank, low, high, chain)
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        edges = np.flatnonzero(np.diff(lag, prepend=-1, append=-1)) if len(lag) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True) if len(lag) else ():
            d, mine, j = int(lag[a]), at[a:b], 0
            while j < len(mine):
                i = int(mine[j])
                ahead, back = matched(ids, i, d, 1), matched(ids, i, d, -1)
                if ahead + back - 1 >= need(d):
                    found.append((i - back + 1 - d, ahead + back - 1 + d, d))
                j = int(np.searchsorted(mine, i + ahead))
        if chain:
            rank, g = doubled(rank, g), 2 * g
        low, high, chain = 2 * g, 4 * g, g // 2
    runs = np.array(sorted(found), np.int64).reshape(-1, 3)
    same = np.zeros(len(runs), bool)  # a stretch that was found at multiples of its period
    same[1:] = (np.diff(runs[:, 0]) == 0) & (np.diff(runs[:, 1]) == 0)
    runs = runs[~same]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def searched(texts: list[list[bytes]], least: int, times: int) -> Iterator[tuple[list[dict], bytes]]:
    """Of each text its runs, and its words without what any run repeats after its first period."""
    runs = find_runs(numbered(texts), max(map(len, texts), default=0), least, times)
    starts = np.cumsum([0, *map(len, texts)])
    bounds = np.searchsorted(runs[:, 0], starts)
    for i, words in enumerate(texts):
        mine = runs[bounds[i] : bounds[i + 1]] - [starts[i], 0, 0]
        if len(mine):
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, mine[:, 0] + mine[:, 2], 1)
            np.add.at(depth, mine[:, 0] + mine[:, 1], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
        yield [{"start": s, "length": n, "period": p} for s, n, p in mine.tolist()], b" ".join(words)


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 24,
    times: int = 3,
    rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``runs`` (start, length, period; by start and period), ``collapsed``.

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch of words with smallest period p
    (words p apart are identical), of ``least`` words and ``times`` periods at least, which no neighbouring word extends
    with that period. ``collapsed`` is the text without the words that a run holds after its first period, joined by
    one space. ``rewrite`` gets the id and the words of a text and returns the words to search.

    Null and empty texts have no word and no run. Rows are judged alone: repeated rows and null ids give rows like any
    other, an empty table gives none, and other columns don't matter. A row is one text; memory follows the longest.
    """
    (text,) = fresh([id_col], "text_")
    rows = docs.select(F.col(f"`{id_col}`"), text_of(text_col).alias(text))
    names = fresh([id_col], *FOUND.names)
    out = T.StructType([rows.schema[id_col]] + [T.StructField(n, f.dataType) for n, f in zip(names, FOUND, strict=True)])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1000, 8 * AT_ONCE):
                ids = part.column(id_col).to_pylist() if rewrite else []
                words = [t.as_buffer().to_pybytes().split() for t in part.column(text)]
                if rewrite:
                    words = [rewrite(i, w) for i, w in zip(ids, words, strict=True)]
                found = []
                while len(found) < len(words):  # as many texts at once as have AT_ONCE words
                    at, n = len(found), 0
                    while at < len(words) and (n == 0 or n + len(words[at]) <= AT_ONCE):
                        n, at = n + len(words[at]), at + 1
                    found += searched(words[len(found) : at], least, times)
                columns = [pa.array(map(len, words), pa.int64()), pa.array([r for r, _ in found], arrow.field(2).type), pa.array([c.decode() for _, c in found], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(id_col).cast(arrow.field(0).type), *columns], schema=arrow)

    return rows.mapInArrow(run, out)


def run_digests(found: DataFrame) -> DataFrame:
    """What ``periodic_runs`` found as numbers and digests: the run of most periods (of equal ones the first), SHA-256 of runs and text."""
    more = lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a)
    top = F.when(F.size("runs") > 0, F.aggregate("runs", F.try_element_at("runs", F.lit(1)), more))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    told = found.withColumn("top_", top)
    return told.select(
        *[F.col(f"`{c}`") for c in found.columns if c not in FOUND.names],
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top_.start").alias("start"), F.col("top_.length").alias("length"), F.col("top_.period").alias("period"),
        F.expr("(1000 * top_.length) div top_.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
