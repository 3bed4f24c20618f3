import random

from gridfire.llm import decontaminate


def test_partial_copies_of_a_common_item(spark):
    """Full copies of an item make its grams common; copies that hold only such grams are found at any table size."""
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(15)]
    apart = item[:8] + [word() for _ in range(7)] + item[8:]  # 15 matches less 7 words put in: 23 of 30
    docs = [(i, " ".join(item)) for i in range(300)] + [(500, " ".join(item[:8])), (501, " ".join(item[5:13])), (502, " ".join(item[:7])), (503, " ".join(apart))]
    docs += [(1000 + i, " ".join(word() for _ in range(20))) for i in range(100)]
    # the end of the item stays rare: only a tenth of the full copies have it
    docs = [(i, " ".join(t.split()[:12])) if i < 270 else (i, t) for i, t in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.find_leaks(frame, items).collect()}
    assert set(got) == {*range(300), 500, 501, 503}
    assert abs(got[500] - 16 / 30) < 1e-9 and abs(got[503] - 23 / 30) < 1e-9
    assert {r.doc_id for r in decontaminate.drop_leaks(frame, items).collect()} == {502, *range(1000, 1100)}
