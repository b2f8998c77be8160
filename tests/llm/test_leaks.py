"""Edited leaks beside many verbatim ones, against alignment of every document with every item."""

import random

from sparkveil.llm import decontaminate as DC


def seeded(text, item):
    n = DC.SEED_WORDS
    grams = [{tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for w in (text, item)]
    return bool(grams[0] & grams[1])


def test_edited_copies_beside_many_verbatim_leaks(spark):
    rng = random.Random(19)
    items = [[f"i{k}w{j}" for j in range(rng.choice((20, 40)))] for k in range(20)]
    texts = []
    for item in items:
        around = [f"x{rng.randrange(400)}" for _ in range(30)]
        texts += [around + item] * 15 + [[*around[:9], f"n{k}", *item] for k in range(10)]  # copies, and other contexts
        texts += [around + [f"x{rng.randrange(400)}" if rng.random() < 0.2 else w for w in item] for _ in range(4)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.start, r.end) for r in DC.find_leaks(df, bench).collect()}
    expected = {(d, i): DC.align(t, item) for d, t in enumerate(texts) for i, item in [(d // 29, items[d // 29])] if seeded(t, item)}
    assert got == {k: v for k, v in expected.items() if v[0] >= DC.THRESHOLD} and len(got) > 25 * len(items)
