import hashlib
import random

import pytest
from xxhash import xxh64_intdigest

from gridfire.llm import bpe, components, queries, simhash


def plain_fingerprint(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(fps):
    """Brute force: {id: component} by comparing all pairs."""
    ids = list(fps)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


def test_fingerprint():
    for text in ("", "  \t", "One", "one TWO", "Ünd ÄB c d É e\x0bf\x1cg", "a b c " * 5000, "".join(random.Random(1).choice("ab c\n") for _ in range(500))):
        assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)
    assert simhash.fingerprint("a b c d e f g", block=2) == simhash.fingerprint("a b c d e f g")


def test_pairs_match_brute_force(spark):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(20)}
    for x in list(fps):
        for _ in range(15):
            y = x
            for _ in range(rnd.choice((1, 2, 3))):
                y ^= 1 << rnd.randrange(64)
            fps.add(y)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    got = simhash.near_pairs(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % 2**64).count("1") <= 2}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3), (1, 0)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 160))
    assert all(got[a] == got[b] <= min(a, b) for a, b in edges if a is not None and a != b)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups(spark, sf_dir):
    rows = queries.op8_simhash(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = components_of(fps)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted((i, f"{fps[i]:016x}", want[i]) for i in texts)


def test_groups_cases(spark):
    rows = [(1, "a b c d", 0), (5, "A b  c d", 0), (2, None, 0), (3, "", 0), (None, "a b c d", 0), (1, "a b c d", 0), (9, "w " * 20_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (5, 1), (2, 2), (3, 2), (None, None), (9, 9)], key=str)
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 1, 2, None, 9], key=str)
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    got = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    got.no_truncation()
    got.no_padding()
    return got


HARD = ["", " ", "  a  b \n\n c\t", "I'll we've 'S it's", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "héé ß 日本語 🙂🙂  x​", "a" * 5000, "ab" * 3001, " " * 999 + "x", "123 4567 1,000.5", "!!!??? ###", "\x00\x01\x7f", "é" * 1000, "don't\r\nstop ", "a\n b", "a \nb", "a\n \nb", "a\n\n b\n", "don't stop, I'll go!\nNow 12 to 3rd x-y", "\na b", " a b", "a b ", "a\u00a0b c", "a\x1cb c d", "a\x85b c", "x\n\ny z\n", "\u3000a \u2003b c"]


def test_bpe_matches_the_library(spark, library):
    rnd = random.Random(3)
    texts = HARD + ["".join(rnd.choice("abcdeé   .,'\n12!<|>endoftx") for _ in range(rnd.randrange(400))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, None)], "doc_id long, text string, ids string")
    out = bpe.bpe_encode(docs, queries.vocabulary_path(), name="tokens", table=50)
    rows = bpe.bpe_decode(out, queries.vocabulary_path(), "tokens").collect()
    assert out.columns == ["doc_id", "text", "ids", "tokens"] and len(rows) == len(texts) + 1
    for r in rows:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.tokens == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert bpe.bpe_encode(docs.limit(0), queries.vocabulary_path()).count() == 0


def test_decode_of_broken_bytes(spark, library):
    lists = [[50256, 220], [94, 95, 96], [157, 98], None, []]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "doc_id long, ids array<int>")
    for r in bpe.bpe_decode(docs, queries.vocabulary_path()).collect():
        assert r.decoded == library.decode(r.ids or [], skip_special_tokens=False)


def test_op7_query(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in queries.op7_bpe(spark, sf_dir).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
