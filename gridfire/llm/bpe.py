"""Byte-level BPE: encoding by a segment tree over adjacent pair ranks, and decoding."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_batches, text_of

#: Fixed value: how the byte-level pre-tokenizer splits text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a space may belong to what is before it, or to none: white space after a space, at the ends, or of a rarer kind.
ODD = "^ | $|  | \n|[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n") + "]"
#: A word of Latin letters only is one piece.
LETTERS = regex.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*").fullmatch
#: Bytes of the longest words that are merged many at a time.
WIDEST = 64
SPREAD = 0x9E3779B97F4A7C15
#: Bytes of the texts that are worked on together.
BATCH_BYTES = 2 << 20


def byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in vocabulary files: printable ones for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file. About 100,000 small entries, whatever the corpus."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        ids = model["vocab"]
        self.bytes: list[int | None] = [None] * 256
        for letter, b in letters.items():
            self.bytes[b] = ids.get(letter)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: Rank of a pair of ids (first << 32 | second), and the id that a rank's merge makes.
        self.ranks: dict[int, int] = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made: list[int] = [ids[a + b] for a, b in merges]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", []) if t.get("special")}
        tokens = {i: bytes(letters[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        #: The bytes of each token; the last entry is empty.
        self.tokens = pa.array([tokens.get(i, b"") for i in range(max(tokens) + 2)], pa.binary())
        self.byte_ids = np.array([-1 if i is None else i for i in self.bytes], np.int64)
        self.made_ids = np.array(self.made, np.int64)
        #: Pairs and their ranks again, as a hash table with linear probing.
        self.bits = max(4, (8 * len(self.ranks)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        for key, rank in self.ranks.items():
            at = (key * SPREAD & (2**64 - 1)) >> (64 - self.bits)
            while self.keys[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.keys[at], self.values[at] = key, rank

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; -1 where there is none."""
        key = a << 32 | b
        at = ((key.view(np.uint64) * np.uint64(SPREAD)) >> np.uint64(64 - self.bits)).view(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], -1)
        rest = np.nonzero((found != key) & (found >= 0))
        while len(rest[0]):
            at[rest] = (at[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[rest]]
            out[rest] = np.where(found == key[rest], self.values[at[rest]], -1)
            more = (found != key[rest]) & (found >= 0)
            rest = tuple(r[more] for r in rest)
        return out


def merge(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Merges adjacent ids, the leftmost pair of the lowest rank first, until no pair can be merged.

    Leaf i of the segment tree holds rank * n + i of the pair that starts at position i, or ``none``; the root is the
    leftmost lowest-rank pair. A merge changes three leaves at most, each with a logarithmic update.
    """
    n = len(ids)
    if n < 2:
        return ids
    none = 1 << 60
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [none] * (2 * width)
    get = ranks.get
    for i in range(n - 1):
        if (rank := get(ids[i] << 32 | ids[i + 1])) is not None:
            tree[width + i] = rank * n + i
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    while (root := tree[1]) != none:
        rank, i = divmod(root, n)
        j = after[i]
        ids[i], ids[j] = made[rank], -1
        after[i] = e = after[j]
        after[j] = -1
        if e >= 0:
            before[e] = i
        for at in (j, i, before[i]):
            if at < 0 or at == n - 1:
                continue
            e = after[at]
            rank = get(ids[at] << 32 | ids[e]) if e >= 0 else None
            k = width + at
            new = none if rank is None else rank * n + at
            if tree[k] == new:
                continue
            tree[k] = new
            while k > 1:
                a, b = tree[k], tree[k ^ 1]
                k >>= 1
                if b < a:
                    a = b
                if tree[k] == a:
                    break
                tree[k] = a
    return [x for x in ids if x >= 0]


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words in a row, and how many each word has: ``merge`` for many words at once.

    Words of one tree width go together. Row k of the array ``tree`` is the segment tree of word k: leaf i holds rank
    and position of the pair that starts at i, and the root the leftmost lowest rank. Each step merges the root's pair
    of every word that has one and updates the three leaves it changes, with their ancestors.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out: list[np.ndarray | None] = [None] * len(words)
    counts = np.zeros(len(words), np.int64)
    widths = np.where(sizes > WIDEST, 0, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    for k in np.flatnonzero(sizes > WIDEST).tolist():
        out[k] = np.array(merge([i for x in words[k] if (i := v.bytes[x]) is not None], v.ranks, v.made), np.int32)
        counts[k] = len(out[k])
    parts = []
    for width in sorted({*widths.tolist()} - {0}):
        rows = np.flatnonzero(widths == width)
        n, m = sizes[rows], len(rows)
        filled = np.arange(width) < n[:, None]
        ids = np.full((m, width), -1, np.int64)
        ids[filled] = v.byte_ids[np.frombuffer(b"".join([words[k] for k in rows.tolist()]), np.uint8)]
        if (ids[filled] < 0).any():  # a byte without a token: the other bytes close up
            order = np.argsort(ids < 0, axis=1, kind="stable")
            ids = np.take_along_axis(ids, order, axis=1)
            n = (ids >= 0).sum(1)
        ids = merge_rows(ids, n, v)
        held = ids >= 0
        counts[rows] = held.sum(1)
        parts.append((rows, ids[held]))
    flat = np.zeros(counts.sum(), np.int32)
    starts = np.cumsum(counts) - counts
    for rows, got in parts:
        c = counts[rows]
        flat[np.arange(len(got)) + np.repeat(starts[rows] - (np.cumsum(c) - c), c)] = got
    for k in np.flatnonzero(sizes > WIDEST).tolist():
        flat[starts[k] : starts[k] + counts[k]] = out[k]
    return flat, counts


def merge_rows(ids: np.ndarray, n: np.ndarray, v: Vocabulary) -> np.ndarray:
    """One word in each row of ``ids`` (n of them used, -1 after), merged; ids merged into the one before become -1."""
    m, width = ids.shape
    none, low = 1 << 60, width - 1
    bits = max(1, width.bit_length() - 1)
    tree = np.full((m, 2 * width), none, np.int64)
    rank = v.rank_of(ids[:, :-1], ids[:, 1:])
    leaf = (rank << bits) | np.arange(width - 1)
    tree[:, width : 2 * width - 1] = np.where(rank >= 0, leaf, none)
    k = width
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    after = np.broadcast_to(np.arange(1, width + 1), (m, width)).copy()
    after[after >= n[:, None]] = -1
    before = np.broadcast_to(np.arange(-1, width - 1), (m, width)).copy()
    rows = np.flatnonzero(tree[:, 1] != none) if width > 1 else np.zeros(0, np.int64)
    while len(rows):
        root = tree[rows, 1]
        i, made = root & low, v.made_ids[root >> bits]
        j = after[rows, i]
        e, p = after[rows, j], before[rows, i]
        ids[rows, i], ids[rows, j] = made, -1
        after[rows, i] = e
        has_e, has_p = e >= 0, p >= 0
        before[rows[has_e], e[has_e]] = i[has_e]
        right, left = np.full(len(rows), -1, np.int64), np.full(len(rows), -1, np.int64)
        right[has_e] = v.rank_of(made[has_e], ids[rows[has_e], e[has_e]])
        left[has_p] = v.rank_of(ids[rows[has_p], p[has_p]], made[has_p])
        tree[rows, width + j] = none
        tree[rows, width + i] = np.where(right >= 0, right << bits | i, none)
        at = np.where(has_p, p, i)
        tree[rows, width + at] = np.where(has_p, np.where(left >= 0, left << bits | p, none), tree[rows, width + i])
        places = [width + j, width + i, width + at]
        for _ in range(bits):
            places = [x >> 1 for x in places]
            for x in places:
                tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
        rows = rows[tree[rows, 1] != none]
    return ids


class Store:
    """Runs of ids by number."""

    def __init__(self):
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, np.cumsum(sizes) - sizes + len(self.flat)))
        self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, flat))

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered runs in a row, and how many each has."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[numbers] - (ends - sizes), sizes)], sizes


class Encoder:
    """Encodes texts to ids, a batch at a time: Arrow splits the batch and finds its different pieces, and only new ones are worked on.

    Words met before, and what stands between two spaces, come from tables that are emptied at ``table`` entries.
    """

    def __init__(self, vocabulary: Vocabulary, table: int = 300_000):
        self.v, self.table = vocabulary, table
        self.split = regex.compile(PATTERN).findall
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.empty()

    def empty(self) -> None:
        self.words: dict[str, int] = {}
        self.chunks: tuple[dict[str, int], dict[str, int]] = ({}, {})  # at the start of a text, after a space
        self.word_ids, self.chunk_ids = Store(), Store()

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in a row, and how many each has; new words are merged."""
        new = list(dict.fromkeys([w for w in words if w not in self.words]))
        if new:
            first = len(self.word_ids)
            self.word_ids.add(*merge_words([w.encode() for w in new], self.v))
            self.words.update(zip(new, range(first, first + len(new)), strict=True))
        got = self.word_ids.get(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
        for w in new:
            if len(w) > WIDEST:  # rare, and long
                del self.words[w]
        return got

    def numbers(self, chunks: list[str], spaced: bool) -> np.ndarray:
        """The numbers of different chunks in ``chunk_ids``; new ones are split into words."""
        known = self.chunks[spaced]
        got = np.fromiter((known.get(c, -1) for c in chunks), np.int64, len(chunks))
        at = np.flatnonzero(got < 0)
        if len(at):
            new = [chunks[k] for k in at.tolist()]
            space = " " if spaced else ""
            pieces = [[space + c] if c and one else self.split(space + c) for c, one in zip(new, map(LETTERS, new), strict=True)]
            ids, sizes = self.ids_of([w for p in pieces for w in p])
            ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, pieces)])]
            got[at] = np.arange(len(self.chunk_ids), len(self.chunk_ids) + len(new))
            self.chunk_ids.add(ids, np.diff(ends))
            known.update((c, k) for c, k in zip(new, got[at].tolist(), strict=True) if len(c) <= WIDEST)
        return got

    def whole(self, text: str) -> np.ndarray:
        """The ids of one text, with its special tokens."""
        out = []
        for i, part in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                out.append(np.array([self.v.special[part]], np.int32))
            elif part:
                out.append(self.ids_of(self.split(part))[0])
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has.

        Where single spaces and line ends are the only white space, and no line end or space follows a space, what lies
        between two spaces splits alike in any text; so such a chunk can be known as a whole.
        """
        if max(len(self.word_ids), len(self.chunk_ids)) >= self.table or max(len(self.word_ids.flat), len(self.chunk_ids.flat)) >= 16 * self.table:
            self.empty()
        odd = pc.match_substring_regex(texts, ODD)
        for s in self.v.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        odd = odd.to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(texts), np.int64)
        parts: dict[int, np.ndarray] = {}
        for k in np.flatnonzero(odd).tolist():
            parts[k] = self.whole(texts[k].as_py())
            sizes[k] = len(parts[k])
        easy = np.flatnonzero(~odd)
        lists = pc.split_pattern(texts.take(pa.array(easy)), " ")
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        first = np.zeros(ends[-1] if len(ends) else 0, bool)
        first[np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else []] = True
        values, numbers = lists.flatten(), np.zeros(len(first), np.int64)
        for spaced in (False, True):
            some = values.filter(pa.array(first != spaced)).dictionary_encode()
            numbers[first != spaced] = self.numbers(some.dictionary.to_pylist(), spaced)[some.indices.to_numpy()] if len(some) else 0
        flat, counts = self.chunk_ids.get(numbers)
        total = np.concatenate(([0], np.cumsum(counts)))
        sizes[easy] = np.diff(total[np.concatenate(([0], ends)).astype(np.int64)])
        if not parts:
            return flat, sizes
        out, at = np.zeros(sizes.sum(), np.int32), np.cumsum(sizes) - sizes
        own = np.repeat(odd, sizes)
        out[~own] = flat
        for k, ids in parts.items():
            out[at[k] : at[k] + len(ids)] = ids
        return out, sizes


def lists_of(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int32()))


def decoded_bytes(lists: pa.ListArray, v: Vocabulary) -> pa.Array:
    """The bytes of the tokens of each list; null lists and ids without a token give none."""
    ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
    known = (ids >= 0) & (ids < len(v.tokens))
    pieces = v.tokens.take(pa.array(np.where(known, ids, len(v.tokens) - 1)))
    ends = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces), b"")


def _shared(spark: SparkSession, path: str):
    """The vocabulary as a broadcast: the file needs to be on the driver only."""
    return spark.sparkContext.broadcast(Vocabulary(path))


def _texts(docs: DataFrame, text_col: str, keep: list[str] | None) -> tuple[DataFrame, str, list[str]]:
    (text,) = fresh(docs, "text_")
    keep = docs.columns if keep is None else keep
    return docs.withColumn(text, text_of(text_col)).select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])]), text, keep


def bpe_encode(docs: DataFrame, vocabulary: str, text_col: str = "text", name: str = "ids", keep: list[str] | None = None, table: int = 300_000) -> DataFrame:
    """``docs`` with the token ids of the whole text in array column ``name`` (``_name`` if the column is there already).

    The ids are those of the vocabulary's own library without added special tokens; a special token's string within
    a text is that token. Null text counts as empty and has no ids; repeated rows get equal ids; an empty table gives
    no rows. No shuffle; a task's memory holds a slice of texts, or one long text, and bounded tables of known words.
    """
    shared = _shared(docs.sparkSession, vocabulary)
    rows, text, keep = _texts(docs, text_col, keep)
    made: list[Encoder] = []  # of this Python worker

    def run(texts: pa.Array) -> dict:
        if not made:
            made.append(Encoder(shared.value, table))
        return {name: lists_of(*made[0](texts))}

    return map_batches(rows, text, run, T.StructType().add(name, T.ArrayType(T.IntegerType())), keep=keep, rows=4096, most_bytes=BATCH_BYTES, arrow_in=True)


def bpe_decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids", name: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """``rows`` with the text of the token ids in column ``name`` (``_name`` if it is there already), special tokens included.

    Bytes that are no valid UTF-8 become U+FFFD; a null array gives an empty text; ids without a token give nothing.
    """
    shared = _shared(rows.sparkSession, vocabulary)

    def run(lists: pa.ListArray) -> dict:
        return {name: [x.decode("utf-8", "replace") for x in decoded_bytes(lists, shared.value).to_pylist()]}

    return map_batches(rows, ids_col, run, T.StructType().add(name, "string"), keep=keep, rows=256, arrow_in=True)


def bpe_round_trip(docs: DataFrame, vocabulary: str, derive: Callable[[pa.Array, pa.ListArray, list[bytes]], dict], schema: T.StructType, text_col: str = "text", keep: list[str] | None = None, table: int = 300_000) -> DataFrame:
    """``docs`` with columns made from the ids of ``bpe_encode`` and the text of ``bpe_decode`` (as UTF-8), in one pass over the texts.

    ``derive`` gets the texts of a slice, their lists of ids and the decoded bytes, and returns the columns of ``schema``.
    """
    shared = _shared(docs.sparkSession, vocabulary)
    rows, text, keep = _texts(docs, text_col, keep)
    made: list[Encoder] = []

    def run(texts: pa.Array) -> dict:
        if not made:
            made.append(Encoder(shared.value, table))
        ids = lists_of(*made[0](texts))
        return derive(texts, ids, [x.decode("utf-8", "replace").encode() for x in decoded_bytes(ids, shared.value).to_pylist()])

    return map_batches(rows, text, run, schema, keep=keep, rows=4096, most_bytes=BATCH_BYTES, arrow_in=True)


def checked(texts: pa.Array, ids: pa.ListArray, decoded: list[bytes]) -> dict:
    """``n_tokens``, ``ids``, and whether these decode to the text."""
    same = [t.encode() == d for t, d in zip(texts.to_pylist(), decoded, strict=True)]
    return {"n_tokens": ids.value_lengths().cast("int64"), "ids": ids, "round_trip": same}


CHECKED = T.StructType().add("n_tokens", "long").add("ids", T.ArrayType(T.IntegerType())).add("round_trip", "boolean")


def digests(texts: pa.Array, ids: pa.ListArray, decoded: list[bytes]) -> dict:
    """``n_tokens``, SHA-256 of the decimal ids joined by commas, and of the decoded text."""
    n = int(pc.max(ids.values).as_py() or 0) + 1 if len(ids.values) else 1
    decimal = pa.array(map(str, range(n)), pa.string()).take(ids.values)
    joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, decimal), ",")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return {"n_tokens": ids.value_lengths().cast("int64"), "ids_sha256": [sha(x.encode()) for x in joined.to_pylist()], "decoded_sha256": [sha(x) for x in decoded]}


DIGESTS = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
