import random

import pytest

from gridfire.llm import decontaminate


@pytest.mark.parametrize(("n", "words"), [(3, 60), (8, 60), (13, 60), (5, 7000), (13, 12)])
def test_any_width_of_grams(spark, n, words):
    """Items of many different words and wide grams: copies with a few edits are found, texts of the same words in another order aren't."""
    rnd = random.Random(n)
    item = [f"w{k}" for k in range(words)]
    other = [f"v{k}" for k in range(words)]
    edited = item[: words // 2] + ["new"] + item[words // 2 + 1 :]
    shuffled = rnd.sample(item, len(item))
    docs = [(1, " ".join(["x"] * 50 + item + ["y"] * 50)), (2, " ".join(edited)), (3, " ".join(shuffled)), (4, " ".join(other)), (5, None)]
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(["q"] + other[1:]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items, n=n).collect()}
    want = {(1, 7), (2, 7), (4, 8)} if n <= words // 2 else {(1, 7)}
    assert want <= set(got) <= want | {(2, 7), (4, 8)} and (3, 7) not in got and got[1, 7] == 1
