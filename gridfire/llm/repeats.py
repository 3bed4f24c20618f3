"""Removal of byte strings that occur twice in a corpus, by ranking sampled suffixes at growing lengths.

A suffix array of every byte would move some hundred bytes for each byte of text. This is the same search on the
suffixes that matter. Of each window of ``length`` bytes, the position of its smallest prefix hash stands for the
window (its anchor); equal windows have equal anchors at equal offsets, and one anchor stands for a run of
neighbouring windows. The hash only picks anchors. Three rounds rank the strings around an anchor, each longer than
those of the round before; the key of a round is the pair of the rank so far and of what was added, and Spark
groups these pairs and makes the next ranks:

* ``length / 4`` bytes from the anchor on. A rank that occurs once is unique, and all windows of that anchor drop out.
* The bytes that up to ``step`` neighbouring windows share. Again unique ranks drop out.
* The whole window: the rank before, and the ``step - 1`` bytes at its sides.

A run of windows whose whole string (and place of the anchor) occurs again is past the threshold and done in the
first round that shows it; one run of each repeated string goes on for those that share its rank only. Bytes are
compared as they are in the last round and at the sides in the second; longer strings by BLAKE2b of 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import dropped, text_of, written
from .rolling import Rolling, U, mix, sliding_min


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


class Scanner:
    """Finds the runs of windows of a buffer in which every window of ``length`` bytes has the same anchor.

    Texts over ``slice_bytes`` are looked at in overlapping slices.
    """

    def __init__(self, length: int, first: int, slice_bytes: int):
        self.length, self.first, self.slice_bytes = length, first, slice_bytes
        self.hash = Rolling(11)

    def runs(self, texts: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """(text, first window, windows, offset of the anchor in the first window, hash from the anchor on) of every run."""
        sizes = np.array([len(t) for t in texts], np.int64)
        if not (sizes >= self.length).any():
            return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U),)
        buffer = np.concatenate(texts)
        ends = np.repeat(np.cumsum(sizes), sizes)
        m = len(buffer) - self.length + 1
        windows = np.flatnonzero(np.arange(self.length, len(buffer) + 1) <= ends[:m])
        fp = mix(self.hash.each(self.hash.sums(buffer), self.first))
        low = U((1 << 24) - 1)
        key = (fp & ~low) | np.arange(len(fp), dtype=U)
        anchor = (sliding_min(key, self.length - self.first + 1)[windows] & low).astype(np.int64)
        new = np.flatnonzero((anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)) + 1
        start, end = np.concatenate(([0], new)), np.concatenate((new, [len(windows)])) - 1
        lo, hi, at = windows[start], windows[end], anchor[start]
        text = np.searchsorted(np.cumsum(sizes), lo, side="right")
        return text, lo - (np.cumsum(sizes) - sizes)[text], hi - lo + 1, at - lo, fp[at]

    def scan(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
        """``runs`` of texts of any length, in buffers of bounded size; the text's number is that in ``texts``."""
        held, ids, base, size = [], [], [], 0

        def flush():
            t, lo, *rest = self.runs(held)
            return (np.array(ids)[t], lo + np.array(base)[t], *rest)

        for i, text in enumerate(texts):
            data = np.frombuffer(text, np.uint8)
            for at in range(0, max(1, len(data) - self.length + 1), self.slice_bytes):
                held.append(data[at : at + self.slice_bytes + self.length - 1])
                ids.append(i)
                base.append(at)
                size += len(held[-1])
                if size >= self.slice_bytes:
                    yield flush()
                    held, ids, base, size = [], [], [], 0
        if held:
            yield flush()


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id``, ``h``, ``text``). Id and hash name a text in all rounds."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id``, ``h``, ``z``): the bytes of each text compressed."""
    rows = plain(docs, id_col, text_col).select("id", "h", "text")
    out = T.StructType([rows.schema["id"], T.StructField("h", T.LongType()), T.StructField("z", T.BinaryType())])
    schema = to_arrow_schema(out)

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                z = [zip_.compress(t.encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id").cast(schema.field("id").type), part.column("h"), pa.array(z, pa.binary())], schema=schema)

    return rows.mapInArrow(run, out)


def unpack(z: bytes | None) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z) if z else b""


def heads(texts: DataFrame, scanner: Scanner) -> DataFrame:
    """``r`` of every run."""
    schema = to_arrow_schema(T.StructType().add("r", "long"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for *_, r in scanner.scan([t.encode() for t in batch.column("text").slice(at, 256).to_pylist()]):
                    yield pa.RecordBatch.from_arrays([pa.array(r.view(np.int64))], schema=schema)

    return texts.select("text").mapInArrow(run, T.StructType().add("r", "long"))


def runs(texts: DataFrame, scanner: Scanner) -> DataFrame:
    """``id``, ``h``, ``lo``, ``n``, ``off``, ``r``, ``d`` of every run; d is the digest of its whole string."""
    out = T.StructType([texts.schema["id"]]).add("h", "long").add("lo", "long").add("n", "integer").add("off", "integer").add("r", "long").add("d", "binary")
    schema, more = to_arrow_schema(out), scanner.length - 1

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held = [t.encode() for t in part.column("text").to_pylist()]
                ids, hashes = part.column("id"), part.column("h")
                for t, lo, n, off, r in scanner.scan(held):
                    d = [digest(held[i][a : a + k + more]) for i, a, k in zip(t.tolist(), lo.tolist(), n.tolist(), strict=True)]
                    pick = pa.array(t)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pick).cast(schema.field("id").type), hashes.take(pick), pa.array(lo), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(r.view(np.int64)), pa.array(d, pa.binary())],
                        schema=schema,
                    )

    return texts.select("id", "h", "text").mapInArrow(run, out)


def pieces(texts: DataFrame, length: int, step: int) -> DataFrame:
    """The runs in column ``ranges`` (lo, n, off, rep) cut where the offset of the anchor is a multiple of ``step``.

    ``node`` is that multiple, ``x`` the offset in the piece's last window, ``core`` the digest of the bytes that all
    windows of a node share, and ``left`` and ``right`` are the piece's bytes at its sides.
    """
    out = T.StructType([texts.schema["id"]]).add("h", "long").add("lo", "long").add("n", "integer").add("node", "integer").add("x", "integer")
    out = out.add("core", "binary").add("left", "binary").add("right", "binary").add("rep", "boolean")
    schema = to_arrow_schema(out)

    def cut(text: bytes, ranges: list[dict]) -> Iterator[tuple]:
        for lo, n, off, rep in {(x["lo"], x["n"], x["off"], x["rep"]) for x in ranges}:
            a = lo + off
            for node in range((off - n + 1) // step, off // step + 1):
                o1, o2 = node * step, node * step + step - 1
                x1, x2 = max(off - n + 1, o1), min(off, o2)
                yield a - x2, x2 - x1 + 1, node, x1, digest(text[a - o1 : a - o2 + length]), text[a - x2 : a - o1], text[a - o2 + length : a - x1 + length], rep

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [(i, *p) for i, (z, ranges) in enumerate(zip(part.column("z").to_pylist(), part.column("ranges").to_pylist(), strict=True)) for p in cut(unpack(z), ranges)]
                if rows:
                    i, *cols = zip(*rows, strict=True)
                    pick = pa.array(i)
                    cols = [pa.array(c, type=f.type) for c, f in zip(cols, list(schema)[2:], strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pick).cast(schema.field("id").type), part.column("h").take(pick), *cols], schema=schema)

    return texts.select("id", "h", "z", "ranges").mapInArrow(run, out)


def with_lists(texts: DataFrame, rows: DataFrame, name: str, how: str) -> DataFrame:
    """``texts`` with the rows of the same text as an array column; a text's rows are bounded by its length."""
    fields = [c for c in rows.columns if c not in ("id", "h")]
    lists = rows.groupBy(F.col("id").alias("id_"), F.col("h").alias("h_")).agg(F.collect_list(F.struct(*fields)).alias(name))
    return texts.join(lists, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), how).drop("id_", "h_")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, slice_bytes: int = 1 << 20) -> DataFrame:
    """(``id``, ``h``, ``lo``, ``n``): n windows from byte ``lo`` on occur elsewhere too.

    Counts by rank and by string combine on the map side, and what comes more than once is a table of its own when
    rows meet it, so that Spark can split hot ranks in the joins. Tables of finished rounds are deleted.
    """
    first, step = max(1, length // 4), max(1, min(16, length // 8))
    texts, scanner = plain(docs, id_col, text_col), Scanner(length, first, slice_bytes)
    n = F.count(F.lit(1)).alias("c")
    often = written(heads(texts, scanner).groupBy("r").agg(n).where("c > 1").select("r"), "ranks")
    active = written(runs(texts, scanner).join(often, "r"), "runs")
    dropped(often)
    one = ["r", "off", "n", "d"]
    strings = written(active.groupBy(*one).agg(n, *[F.first(c).alias(c) for c in ("id", "h", "lo")]), "strings")
    whole = written(active.join(strings.where("c > 1").select(*one), one).select("id", "h", "lo", "n"), "spans")
    dropped(active)
    left = strings.join(strings.where("c = 1").select("r").distinct(), "r", "left_semi").select("id", "h", "lo", "n", "off", (F.col("c") > 1).alias("rep"))
    cut = pieces(with_lists(packed(docs, id_col, text_col), left, "ranges", "inner"), length, step)
    cut = written(cut.withColumn("q", F.monotonically_increasing_id()), "pieces")
    dropped(strings)
    one = ["node", "core", "x", "n", "left", "right"]
    strings = written(cut.groupBy(*one).agg(n, F.min("rep").alias("rep"), F.min("q").alias("q"), *[F.first(c).alias(c) for c in ("id", "h", "lo")]), "strings")
    part = written(cut.where("NOT rep").join(strings.where("c > 1").select(*one), one).select("id", "h", "lo", "n"), "spans")
    dropped(cut)
    ranks = strings.groupBy("node", "core").agg(F.min("q").alias("rank"), n, F.count_if((F.col("c") == 1) & ~F.col("rep")).alias("open")).where("c > 1 AND open > 0").drop("c", "open")
    o1, o2, last = F.col("node") * step, F.col("node") * step + (step - 1), F.col("x") + F.col("n") - 1  # last: the offset in the first window
    ranked = strings.join(ranks, ["node", "core"]).select(
        "rank", "id", "h", "lo", "left", "right", ((F.col("c") > 1) | F.col("rep")).alias("rep"), o1.alias("o1"), o2.alias("o2"), last.alias("last"), F.explode(F.sequence("x", last)).alias("off")
    )
    sides = F.concat(F.substring("left", F.col("last") - F.col("off") + 1, F.col("off") - F.col("o1")), F.substring("right", F.lit(1), F.col("o2") - F.col("off")))
    windows = ranked.select("rank", "off", sides.alias("sides"), "rep", "id", "h", (F.col("lo") + F.col("last") - F.col("off")).alias("lo"))
    again = windows.groupBy("rank", "off", "sides").agg(n).where("c > 1").drop("c")
    single = windows.where("NOT rep").join(again, ["rank", "off", "sides"]).select("id", "h", "lo", F.lit(1).alias("n"))
    found = written(whole.union(part).union(single), "spans")
    for table in (strings, whole, part):
        dropped(table)
    return found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, slice_bytes: int = 1 << 20) -> DataFrame:
    """One row per row of ``docs``: its id, ``kept`` (binary), ``n_bytes``, ``n_removed``, ``n_spans``.

    Texts are UTF-8 bytes, null is empty. A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, in the same text or in another; strings overlap and are judged on the input, and none crosses two
    texts. ``n_spans`` counts maximal runs of removed bytes. Texts shorter than ``length`` stay whole; those over
    ``slice_bytes`` are searched in overlapping slices, with the same result. Repeated rows are copies of each other,
    with an equal id or not; rows with a null id are treated like all others. An empty table gives no rows; other
    columns of ``docs`` don't matter. Kept bytes may be no valid UTF-8, as a string may begin or end within a character.
    """
    spans = repeated_spans(docs, id_col, text_col, length, slice_bytes)
    joined = with_lists(packed(docs, id_col, text_col), spans, "spans", "left")
    out = T.StructType([T.StructField(id_col, joined.schema["id"].dataType)]).add("kept", "binary").add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
    schema = to_arrow_schema(out)

    def cut(text: bytes, spans: list[dict]) -> tuple[bytes, int, int, int]:
        kept, end, runs = [], 0, 0
        for lo, n in sorted((x["lo"], x["n"]) for x in spans):
            if lo > end or not runs:
                kept.append(text[end:lo])
                runs += 1
            end = max(end, lo + n - 1 + length)
        kept = b"".join([*kept, text[end:]])
        return kept, len(text), len(text) - len(kept), runs

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [cut(unpack(z), s or []) for z, s in zip(part.column("z").to_pylist(), part.column("spans").to_pylist(), strict=True)]
                cols = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id").cast(schema.field(0).type), *cols], schema=schema)

    return joined.select("id", "z", "spans").mapInArrow(run, out)


def kept_digest(rows: DataFrame) -> DataFrame:
    """``remove_repeats`` rows with ``kept_sha256`` in place of the bytes."""
    return rows.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
