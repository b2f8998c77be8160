"""The removing stages of the pipeline go by rows, not by doc_id."""

import random


def test_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(21)
    a, b, c, d, item = (" ".join(f"{k}{rng.randrange(90)}" for _ in range(60)) for k in "abcde")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = [(None, a), (None, a), (1, b), (1, b), (2, c), (3, c), (3, d)]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(near, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, a), (1, b), (2, c), (3, d)], key=str)
    leaks = [(None, item), (None, a), (1, item), (1, b), (2, c)]
    got = corpus_pipeline.decontamination_stage(spark, spark.createDataFrame(leaks, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, a), (1, b), (2, c)], key=str)
