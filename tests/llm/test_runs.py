import hashlib
import random
from zlib import crc32

import numpy as np

from gridfire.llm import queries, runs


def plain_runs(words, least=24, times=3):
    """Every lag on its own; of stretches found at several lags the smallest is the period."""
    n, found = len(words), {}
    for p in range(1, n // times + 1):
        i = p
        while i < n:
            j = i
            while j < n and words[j] == words[j - p]:
                j += 1
            if j - i + p >= max(least, times * p):
                found.setdefault((i - p, j - i + p), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def texts(rnd):
    word = lambda k: [str(rnd.randrange(k)) for _ in range(rnd.randrange(1, 90))]
    yield from ([], ["a"], ["a"] * 23, ["a"] * 24, ["a"] * 5000, ["a", "b"] * 12, ["a", "b"] * 11 + ["a"], ["x"] * 100 + ["y"] * 100 + ["x"] * 100)
    for _ in range(150):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            unit = word(rnd.choice((2, 3, 50)))
            parts += unit * rnd.choice((1, 2, 3, 4, 9)) + unit[: rnd.randrange(len(unit) + 1)]
        if rnd.random() < 0.4:
            parts = parts[:300] * 4  # runs within runs
        for _ in range(rnd.choice((0, 0, 3))):
            parts[rnd.randrange(len(parts))] = "z"
        yield parts[:1500]
    yield [str(bin(i).count("1") % 2) for i in range(1200)]  # Thue-Morse
    a, b = ["a"], ["a", "b"]
    while len(b) < 1200:
        a, b = b, b + a
    yield b  # Fibonacci


def test_runs_match_brute_force():
    rnd = random.Random(5)
    every = list(texts(rnd))
    for t in every:
        for least, times in ((24, 3), (2, 3), (40, 4)):
            got = [tuple(r) for r in runs.find_runs(runs.numbered([[w.encode() for w in t]]), len(t), least, times).tolist()]
            assert got == plain_runs(t, least, times), (t, least, times)
    many = [[w.encode() for w in t] for t in every]
    assert [[(r["start"], r["length"], r["period"]) for r in rs] for rs, _ in runs.searched(many, 24, 3)] == [plain_runs(t) for t in every]


def test_constant_text_is_no_special_case():
    assert runs.find_runs(np.zeros(2_000_000, np.int64), 2_000_000).tolist() == [[0, 2_000_000, 1]]


def told(doc_id, text):
    """The query's row by the contract's words, and brute force."""
    words = (text or "").encode().split()
    h, n = crc32(str(doc_id).encode()), len((text or "").encode().split())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found).encode()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_matches_brute_force(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts(rnd))] + [(900, None), (901, ""), (902, " \t\x0b\n"), (903, "a b\x1c " * 30), (904, "é " * 40)]
    rows += [rows[9], rows[9]]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op11_periodic_runs(spark, str(tmp_path)).collect()))
    assert got == sorted(told(i, t) for i, t in rows)


def test_general_interface(spark):
    docs = spark.createDataFrame([("a", "x " * 30 + "end", 1), (None, "", 2)], "id string, runs string, n_words int")
    rows = {r["id"]: r for r in runs.periodic_runs(docs, "id", "runs").collect()}
    assert rows["a"]["collapsed"] == "x end" and rows["a"]["n_words"] == 31 and rows[None]["runs"] == []
    assert runs.periodic_runs(docs.limit(0), "id", "runs").count() == 0
