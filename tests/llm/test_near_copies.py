"""The near-duplicate stage of the pipeline against brute force over five-word shingles."""

import random

import pytest

from sparkveil.llm import near_copies as N


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def brute_force(texts):
    """Places that stay: the first of each component of pairs at 0.8 or more."""
    sets, up = [grams(t) for t in texts], list(range(len(texts)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 5 * both >= 4 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i for i in range(len(texts)) if find(i) == i}


def planted(seed):
    """Texts with edited copies on both sides of 0.8, chains of edits, other orders of one vocabulary, and copies."""
    rng = random.Random(seed)
    bag = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(25):
        base = rng.choices(bag, k=rng.randint(60, 250))
        texts.append(" ".join(base))
        for share in (0.005, 0.015, 0.02, 0.025, 0.03, 0.06):
            w = [rng.choice(bag) if rng.random() < share else x for x in base]
            texts.append(" ".join(w))
            if share == 0.02:
                base = w  # the later ones are edits of an edit
        rng.shuffle(base)
        texts.append(" ".join(base))
    texts += [texts[3], texts[3].upper(), None, "", "a b", "a b", "b a"]
    return texts


def test_stage_is_brute_force(spark):
    import corpus_pipeline

    texts = planted(17)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()}
    assert got == brute_force(texts)
    assert corpus_pipeline.near_duplicate_stage(spark, df.limit(0), "").count() == 0


def test_same_words_in_another_order_stay(spark):
    import corpus_pipeline

    rng = random.Random(18)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.sample(base, len(base))) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert corpus_pipeline.near_duplicate_stage(spark, df, "").count() == 10


def test_components_follow_every_link(spark):
    spans = [(k, k + 100) for k in range(0, 60, 10)]  # neighbours at 90 of 110 shingles, others below
    spans += [(500, 600), (512, 612)]  # 88 of 112
    texts = [" ".join(f"w{x}" for x in range(spans[k][0], spans[k][1] + 4)) for k in (5, 0, 6, 3, 1, 7, 4, 2)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    root = {r.row: r.root for r in N.near_copies(rows).collect()}
    assert [min(y for y in root if root[y] == root[x]) for x in range(8)] == [0, 0, 2, 0, 0, 5, 0, 0]


@pytest.mark.parametrize(("bucket", "levels"), [(4, 3), (4, 0), (3, 1)])
def test_large_buckets_are_split(spark, monkeypatch, bucket, levels):
    """Buckets beyond the bound are split by further bands and at last into pairs of blocks, without losing a link."""
    monkeypatch.setattr(N, "BUCKET", bucket)
    monkeypatch.setattr(N, "LEVELS", levels)
    monkeypatch.setattr(N, "SALT", 2)
    rng = random.Random(19)
    bag = [f"w{i}" for i in range(3000)]
    common = rng.choices(bag, k=80)
    texts = []
    for _ in range(12):  # half of every text is common to all: 0.3 to 0.5 between texts, 0.7 to 0.95 between copies
        own = rng.choices(bag, k=60)
        texts += [" ".join(common + [rng.choice(bag) if rng.random() < share else x for x in own]) for share in (0, 0.02, 0.05, 0.1)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    root = {r.row: r.root for r in N.near_copies(rows).collect()}
    stay = {min(y for y in root if root[y] == root[x]) for x in root}
    assert stay == brute_force(texts)
