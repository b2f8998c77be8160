"""Null and repeated ids, empty and very long texts, empty tables: every operator on documents keeps a row for each row."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkveil.llm import chat_format as C
from sparkveil.llm import decontaminate as DC
from sparkveil.llm import language_id as LI
from sparkveil.llm import packing as P
from sparkveil.llm import pii, quality, simhash, substring_dedup, suffix_dedup
from sparkveil.llm import token_files as TF
from sparkveil.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, rid int, did int, fp string, bucket int, part int, _row int, _lang_pred string, _own_text string, _pii_email string"
LONG = " ".join(f"word{k % 9973} of line {k}." + ("\n" if k % 12 == 0 else "") for k in range(20_000))  # about 400 kB
ROWS = [(1, LONG), (2, None), (None, ""), (None, None), (4, "a"), (5, "twice the same"), (5, "twice the same"), (5, "another text"), (6, "\n \t")]

OPERATORS = {
    "language": lambda d, tmp: LI.predict_languages(d),
    "simhash": lambda d, tmp: simhash.simhash_components(d),
    "tokens": lambda d, tmp: TF.token_documents(d, tokenizer_path("byte_bpe_50k.json"), 2, f"file://{tmp}/t"),
    "bytes": lambda d, tmp: suffix_dedup.remove_repeats(d),
    "pii": lambda d, tmp: pii.find_pii(d),
    "quality": lambda d, tmp: quality.quality(d),
    "packing": lambda d, tmp: P.pack_documents(d, tokenizer_path("word_bpe_49k.json"), 1).filter("piece = 0"),
    "words": lambda d, tmp: substring_dedup.remove_passages(d),
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, 1, "x", 1, 1, 1, "x", "x", "x") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row(spark, tmp_path, name):
    got = OPERATORS[name](frame(spark, ROWS), tmp_path / "a").select("doc_id").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS)
    assert OPERATORS[name](frame(spark, []), tmp_path / "b").count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, key string"
    rows = [(None, None, None, None, "x"), (None, 1, "user", "a", "x"), (3, 1, "assistant", LONG, "x")]
    got = {r.conv_id: r for r in C.formatted_digest(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {None, 3, -7} and got[None].n_turns == 2 and got[3].loss_chars == len(LONG)
    assert [r.conv_id for r in C.formatted_digest(spark.createDataFrame([], schema)).collect()] == [-7]


def test_decontamination(spark):
    item = " ".join(f"i{k}" for k in range(30))
    bench = spark.createDataFrame([(7, item, 1), (None, item, 1), (8, None, 1)], "item_id long, text string, part int")
    rows = [*ROWS, (9, LONG + " " + item), (None, item), (10, item), (10, item)]
    assert sorted((r.doc_id, r.item_id) for r in DC.find_leaks(frame(spark, rows), bench).collect()) == [(9, 7), (10, 7)]


def test_pipeline_stages(spark, tmp_path):
    """Column names that stages use inside, null ids, an empty table."""
    import corpus_pipeline

    spark.createDataFrame([(0, "none of the texts has this item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, ROWS)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        empty = stage(spark, frame(spark, []), str(tmp_path))
        assert empty.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and empty.columns == docs.columns
            assert out.select(F.coalesce("_row", F.lit(0)).alias("x"), "_lang_pred", "_own_text").distinct().collect()[0].asDict() == {"x": 1, "_lang_pred": "x", "_own_text": "x"}, name
