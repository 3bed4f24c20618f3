import random

from gridfire.llm import jaccard, simhash

from .test_simhash_bpe import components_of, plain_fingerprint


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups_of(texts, pairs):
    """{id: smallest id of its group} by the pairs."""
    up = {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        up[b] = a
    return {i: find(i) for i in texts}


def similar_pairs(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    ids = sorted(texts)
    return [(i, j) for k, i in enumerate(ids) for j in ids[:k] if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]


def edited(rnd, words, n):
    out = list(words)
    for k in rnd.sample(range(len(out)), n):
        out[k] = f"new{rnd.randrange(10**9)}"
    return " ".join(out)


def test_similar_texts_match_brute_force(spark):
    rnd = random.Random(8)
    text = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    texts = {}
    for n in (12, 60, 200, 700) * 5:
        words = text(n)
        for k in (0, 1, 1, 2, n // 50, n // 30):
            texts[len(texts)] = edited(rnd, words, k)
    hot = text(300)
    for _ in range(60):  # a large group, and as many texts that share most of their words but are no copies
        texts[len(texts)] = edited(rnd, hot, 2)
    for _ in range(60):
        texts[len(texts)] = " ".join(hot[:80] + text(60))
    texts |= {1000: "a b", 1001: "A  b", 1002: "b a", 1003: "", 1004: None}
    docs = spark.createDataFrame([*texts.items(), (None, texts[0])], "doc_id long, text string")
    found = {tuple(sorted((r.a, r.b))) for r in jaccard.similar_links(docs).collect()}
    want = similar_pairs(texts)
    assert found <= {tuple(sorted(p)) for p in want} and groups_of(texts, found) == groups_of(texts, want)
    assert jaccard.similar_links(docs.limit(0)).count() == 0


def test_near_copies_go_at_any_distance(spark):
    """Of the sample's texts, one of each group of Jaccard 0.8 or 2 bits stays; most such pairs are further apart than 2 bits."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").dropDuplicates(["text"])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    pairs = similar_pairs(texts)
    assert any(bin(fps[i] ^ fps[j]).count("1") > 2 for i, j in pairs)
    want = groups_of(texts, [*pairs, *components_of(fps).items()])
    frame = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_copies(frame).collect()} == {i for i, c in want.items() if i == c}


def test_prefix_pairs_miss_no_link(spark):
    """Every link between two labels is a candidate, at all sizes; one label alone makes no candidates."""
    rnd = random.Random(3)
    sets = {}
    for base in (1, 2, 5, 6, 40, 150, 400):
        core = [rnd.randrange(10**12) for _ in range(base)]
        for _ in range(12):
            kept = rnd.sample(core, rnd.randint(max(1, base * 7 // 10), base))
            sets[len(sets)] = list({*kept, *(rnd.randrange(10**12) for _ in range(rnd.randint(0, base // 8)))})
    rows = spark.createDataFrame([*sets.items()], "id long, shingles array<long>")
    labels = {i: i - i % 3 for i in sets}
    want = {(a, b) for b in sets for a in range(b) if 10 * len({*sets[a]} & {*sets[b]}) >= 8 * len({*sets[a]} | {*sets[b]})}
    for names in ({}, labels):
        named = spark.createDataFrame([*names.items()], "node long, component long")
        found = {(r.a, r.b) for r in jaccard.prefix_pairs(rows, named, 0.8).collect()}
        apart = {p for p in want if names.get(p[0], p[0]) != names.get(p[1], p[1])}
        assert apart and apart <= found
    one = spark.createDataFrame([(i, 0) for i in sets], "node long, component long")
    assert jaccard.prefix_pairs(rows, one, 0.8).count() == 0
