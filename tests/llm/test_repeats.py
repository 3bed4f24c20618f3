import hashlib
import random

import numpy as np

from gridfire.llm import queries, repeats
from gridfire.llm.rolling import Rolling, sliding_min


def plain(texts, length):
    """Brute force: (bytes, removed, spans, kept) of each text."""
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = b"\1" * length
    return [(len(t), sum(g), len([1 for x in bytes(g).split(b"\0") if x]), bytes(b for b, x in zip(t, g, strict=True) if not x)) for t, g in zip(texts, gone, strict=True)]


def run(spark, texts, length, parts=3, **more):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(parts)
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(docs, length=length, **more).collect()}


def check(spark, texts, length, **more):
    want = plain([(t or "").encode() for t in texts], length)
    got = run(spark, texts, length, **more)
    assert len(got) == len(texts)
    assert [i for i in got if got[i] != want[i]] == []


def test_rolling_hashes():
    data = np.frombuffer(b"abcabcabcabdabcabcabc" * 3, np.uint8)
    one = Rolling(1)
    for h in (2, 5, 13):
        fp = one.each(one.sums(data), h)
        strings = [bytes(data[i : i + h]) for i in range(len(data) - h + 1)]
        assert len(set(zip(fp.tolist(), strings, strict=True))) == len(set(strings)) == len(set(fp.tolist()))
    x = np.random.default_rng(0).integers(0, 99, 57).astype(np.uint64)
    assert sliding_min(x, 7).tolist() == [min(x[i : i + 7]) for i in range(51)]


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") & 1) ^ flip] for i in range(n))


def test_words_that_polynomials_confuse(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2^64 from some length on; they aren't equal."""
    rnd = random.Random(4)
    texts = []
    for n in (128, 200, 1024):
        head = "".join(rnd.choice("cdefgh") for _ in range(max(0, 200 - n) + 20))
        texts += [head + thue_morse(n), head + thue_morse(n, True), "x" + thue_morse(n) + "y" * 90]
    check(spark, texts, 200)
    texts = ["z" * 72 + thue_morse(128), "z" * 72 + thue_morse(128, True)]
    assert all(x[1] == 0 for x in run(spark, texts, 200).values())


def test_runs_of_one_byte(spark):
    check(spark, ["a" * 199, "a" * 200, "b" * 201, "c" * 1500 + "d" + "c" * 300, "ab" * 400, "x" + "e" * 200, "e" * 199 + "x"], 200)


def test_small_alphabet_matches_brute_force(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 30))) for _ in range(40)]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randrange(12))) for _ in range(60)]
    texts += [None, "", "a" * 11, "a" * 12, "a" * 13, "é" * 40, "ab" * 50, texts[3], texts[3], "x" + texts[5] + "y"]
    check(spark, texts, 12)


def test_edited_copies_and_slices(spark):
    rnd = random.Random(8)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(3000))
    texts = [base]
    for _ in range(12):
        t = list(base)
        for _ in range(rnd.randrange(1, 9)):
            at = rnd.randrange(len(t))
            t[at : at + rnd.randrange(3)] = rnd.choice("xyz") * rnd.randrange(3)
        texts.append("".join(t[rnd.randrange(100) :]))
    check(spark, texts, 40)
    check(spark, texts, 40, slice_bytes=500)
    check(spark, texts, 41, slice_bytes=64)


def test_text_over_a_slice(spark):
    """A text longer than a slice of the default size, with copies within it, across the slice's edge and in another text."""
    rnd = random.Random(3)
    base = "".join(rnd.choices("abcdefgh ", k=1_300_000))
    edge = 1 << 20
    texts = [base, "q" + base[edge - 150 : edge + 150] + "r", base[5:300] + "s" + base[1_299_000:]]
    got = run(spark, texts, 200)
    assert got[0][:3] == (1_300_000, 300 + 295 + 1000, 3) and got[1][1:3] == (300, 1) and got[2][1:3] == (1295, 2)


def test_sample_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = plain([(r.text or "").encode() for r in docs], 200)
    got = {r.doc_id: r for r in queries.op9_suffix_dedup(spark, sf_dir).collect()}
    for r, (n, gone, spans, kept) in zip(docs, want, strict=True):
        x = got[r.doc_id]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (n, gone, spans, hashlib.sha256(kept).hexdigest())
    assert sum(x[1] for x in want) > 0


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(300))
    rows = [(1, long, 0), (1, long, 0), (None, "z" + long, 1), (None, "short", 1), (1, "other " * 10, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.remove_repeats(docs, length=200).collect()), key=str)
    assert got == sorted([(1, 300, 300, 1), (1, 300, 300, 1), (None, 301, 300, 1), (None, 5, 0, 0), (1, 60, 0, 0)], key=str)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
