import random

from gridfire.llm import overlap, queries

from .test_jaccard import edited, groups_of


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def links(texts, width=5, percent=80):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    ids = [i for i in sorted(texts) if sets[i]]
    return [(i, j) for k, i in enumerate(ids) for j in ids[:k] if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]


def corpus(rnd):
    text = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    texts = {}
    for n in (4, 5, 9, 12, 30, 60, 200, 700) * 4:
        words = text(n)
        for k in (0, 0, 1, 1, 2, n // 60, n // 45, n // 40):
            texts[len(texts)] = edited(rnd, words, min(k, n))
        for cut in (n * 9 // 10, n * 8 // 10, n * 8 // 10 + 1):
            texts[len(texts)] = " ".join(words[:cut])
    hot = text(120)
    for _ in range(80):  # a group in which some pairs link and many just don't
        texts[len(texts)] = edited(rnd, hot, rnd.randrange(1, 4))
    for _ in range(60):  # a passage that many share and that is most of the text, too little to link
        texts[len(texts)] = " ".join(hot[:60] + text(18))
    chain = text(400)
    for k in range(0, 200, 10):
        texts[len(texts)] = " ".join(chain[k : k + 150])
    texts |= {1000: "a b", 1001: "A  b", 1002: "b a", 1003: "", 1004: None, 1005: " \t", 1006: "a b c d e " * 500, 1007: "a b c d e " * 300, 1008: "É x y z w v", 1009: "é x y z w v"}
    return texts


def test_groups_match_brute_force(spark, monkeypatch):
    texts = corpus(random.Random(4))
    want = groups_of(texts, links(texts))
    rows = [*texts.items(), (None, texts[0]), (3, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS `set`", "0 AS id").repartition(5)
    for limit in (overlap.BROADCAST_IDS, 0):
        monkeypatch.setattr(overlap, "BROADCAST_IDS", limit)
        got = [tuple(r) for r in overlap.jaccard_groups(docs).collect()]
        assert sorted(got, key=str) == sorted([(i, len(shingle_set(t)), want.get(i)) for i, t in rows], key=str)
    assert overlap.jaccard_groups(docs.limit(0)).count() == 0


def test_other_widths_and_shares(spark):
    rnd = random.Random(9)
    texts = {i: edited(rnd, [f"w{k}" for k in range(60)], rnd.randrange(4)) for i in range(40)} | {i: " ".join(f"v{rnd.randrange(9)}" for _ in range(8)) for i in range(50, 90)}
    docs = spark.createDataFrame([(str(i), t) for i, t in texts.items()], "id string, text string")
    sets = {i: {tuple(t.split()[k : k + 2]) for k in range(len(t.split()) - 1)} for i, t in texts.items()}
    pairs = [(i, j) for i in texts for j in texts if j < i and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    groups = groups_of(texts, pairs)
    want = {str(i): min(str(j) for j in texts if groups[j] == groups[i]) for i in texts}
    got = {r["id"]: r["component_id"] for r in overlap.jaccard_groups(docs, "id", width=2, percent=90).collect()}
    assert got == want


def test_query_matches_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").collect()}
    want = groups_of(docs, links(docs))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op13_ngram_join(spark, sf_dir).collect()}
    assert got == {i: (len(shingle_set(t)), want[i]) for i, t in docs.items()}
