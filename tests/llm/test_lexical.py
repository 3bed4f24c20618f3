import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from gridfire.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k=10):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in held)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in plain_terms(text) if c[t])
            if s and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus(rnd, n):
    words = ["Ärger", "ärger", "don", "T", "x1", "été", "a b", "KELVINK", "ź", "\x7f", "_", "日本"] + [f"w{i}" for i in range(40)]
    text = lambda most: rnd.choice(" \n,-'").join(rnd.choice(words) for _ in range(rnd.randrange(most)))
    docs = [(i, text(60)) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(200)]  # ties
    docs += [(5000, None), (5001, ""), (5002, " .-"), (None, "w1 w2 unseen"), (7, docs[7][1])]
    items = [(i, text(25)) for i in range(70)] + [(100, None), (101, "nowhere"), (102, "w3 " * 400)]
    return docs, items


def test_search_matches_brute_force(spark, monkeypatch):
    docs, items = corpus(random.Random(3), 400)
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = plain_search(docs, items)
    rows = lambda df: sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())
    assert rows(lexical.search(a, b)) == want
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 300)  # several blocks
    assert rows(lexical.search(a, b)) == want
    assert rows(lexical.search(a.limit(0), b)) == rows(lexical.search(a, b.limit(0))) == []
    extra = a.selectExpr("doc_id", "text", "1 AS id", "2 AS N", "'x' AS terms", "0 AS score", "0 AS item")
    assert rows(lexical.search(extra, b.selectExpr("item_id", "text", "1 AS id", "2 AS times", "3 AS term"))) == want


def test_products_are_cut_below_2_to_the_53():
    rnd = np.random.default_rng(1)
    item, term = np.repeat(np.arange(3), 50), np.tile(np.arange(50), 3)
    weight = rnd.integers(10**8, 9 * 10**9, 150)
    tile = lexical.Tile(item, term, weight, 50)
    assert len(tile.parts) > 20
    doc, of, impact = np.repeat(np.arange(4), 50), np.tile(np.arange(50), 4), rnd.integers(1, lexical.IMPACT, 200)
    want = [[sum(int(weight[i * 50 + t]) * int(impact[d * 50 + t]) for t in range(50)) for d in range(4)] for i in range(3)]
    assert tile.scores(doc, of, impact, 4).tolist() == want
    heavy = lexical.Tile(np.array([0]), np.array([0]), np.array([12_345_678_901]), 1)
    assert heavy.scores(np.array([0]), np.array([0]), np.array([999_999]), 1).tolist() == [[12_345_678_901 * 999_999]]


def test_query_matches_its_sql(spark, sf_dir):
    got = sorted(map(tuple, queries.op12_lexical_search(spark, sf_dir).select("item_id", "rank", "doc_id", "score").collect()))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert got == sorted(con.execute(f"SELECT item_id, rank, doc_id, score FROM ({queries.ORACLE_SQL['op12_lexical_search']})").fetchall())
