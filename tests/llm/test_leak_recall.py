import random

from gridfire.llm import decontaminate

from .test_scan_html import plain_alignment


def test_recall_against_full_alignment(spark):
    """Items with random words replaced, dropped, put in and moved, whole or in part: what a full Smith-Waterman of the
    whole text scores at 0.5 or more is found, with the same score."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    items = {i: [word() for _ in range(rnd.randrange(6, 40))] for i in range(12)}
    docs = {}
    for d in range(250):
        words = list(rnd.choice([*items.values()]))
        if rnd.random() < 0.3:
            a = rnd.randrange(len(words) // 2)
            words = words[a : a + len(words) * 2 // 3]
        for _ in range(rnd.randrange(len(words) // 2 + 1)):
            k = rnd.randrange(len(words))
            match rnd.randrange(4):
                case 0:
                    words[k] = word()
                case 1:
                    words.insert(k, word())
                case 2 if len(words) > 3:
                    del words[k]
                case _:
                    words.insert(k, words.pop(rnd.randrange(len(words))))
        docs[d] = [word() for _ in range(rnd.randrange(12))] + words + [word() for _ in range(rnd.randrange(12))]
    numbers = {}
    code = lambda ws: [numbers.setdefault(w, len(numbers) + 1) for w in ws]
    want = {(d, i): s for d, ws in docs.items() for i, item in items.items() if len(set(ws) & set(item)) >= len(item) / 2 and (s := plain_alignment(code(item), code(ws)) / (2 * len(item))) >= 0.5}
    frame = spark.createDataFrame([(d, " ".join(ws)) for d, ws in docs.items()], "doc_id long, text string")
    items_frame = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(frame, items_frame).collect()}
    print(f"recall {len(set(got) & set(want))} of {len(want)}")
    assert set(got) <= set(want) and len(want) > 100
    assert len(set(want) - set(got)) <= 0.02 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_ids_of_one_name(spark):
    docs = spark.createDataFrame([(1, "one two three four five six")], "id long, text string")
    items = spark.createDataFrame([(7, "one two three four five")], "id long, text string")
    rows = decontaminate.find_leaks(docs, items, id_col="id", item_id="id").collect()
    assert [(r["id"], r["_id"]) for r in rows] == [(1, 7)]
