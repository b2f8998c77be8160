"""The anonymisation engine against small cases and sequential models."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import lexicons as L
from sparkveil.functions.regexlib import pattern, replace_with, spans
from sparkveil.operators import detect as D
from sparkveil.operators import models as M
from sparkveil.operators import normalise as N
from sparkveil.operators import resolve as R
from sparkveil.operators import sanitise as S
from sparkveil.operators.records import batch_summary, records
from sparkveil.plans import engine as E


def column(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r[0] for r in df.withColumn("x", make(F.col("text"))).orderBy("i").select("x").collect()]


def test_spans_agree_with_python(spark):
    rng = random.Random(1)
    texts = ["", "a1", *("".join(rng.choice("ab1 é😀.\n") for _ in range(40)) for _ in range(60))]
    for p in (r"a+", r"\w+1", r"[ab]\s", r"\d"):
        got = column(spark, texts, lambda c, p=p: spans(c, pattern(p)))
        assert [[(s.text, s.start, s.end) for s in row] for row in got] == [[(m.group(), m.start(), m.end()) for m in re.finditer(p, t)] for t in texts]


def test_places_of_few_and_many_matches(spark):
    """Places are summed one by one up to FEW parts and in blocks beyond, running numbers in one block or more; all agree."""
    texts = ["\u00eb\U0001f600 K12345678M." * n for n in (1, 2, 15, 16, 17, 31, 32, 33, 64, 65, 130)]
    got = column(spark, texts, lambda c: F.concat(*D.l1(c, types=["AL_NID"])))
    want = [[(m.group(), m.start(), m.end()) for m in re.finditer(L.L1_PATTERNS["AL_NID"][0], t)] for t in texts]
    assert [[(s.text, s.start, s.end) for s in row] for row in got] == want
    assert [[(s.text, s.start, s.end) for s in row] for row in column(spark, texts, lambda c: R.dedupe_contained(F.concat(*D.l1(c, types=["AL_NID"]))))] == want
    plan = spark.createDataFrame([("x",)], "text string").select(F.concat(*D.l1(F.col("text"), types=["AL_NID"])))._jdf.queryExecution().optimizedPlan().toString()
    assert " <= 33" in plan


def test_replace_with(spark):
    assert column(spark, ["ab a", "", "b"], lambda c: replace_with(c, "a", F.upper)) == ["Ab A", "", "b"]


def test_patterns_find_what_python_finds(spark):
    text = "Mail A.b@c.al, +355 69 123 4567, 068-123-4567, linkedin.com/in/x-y, 3 Nëntor 1990, K12345678M AB123456 AL47 2121 1009 0000 0002 3569 tiranë\nFemër\n2 fëmijë Religion: none. single parent Sex: F"
    for patterns in (L.L1_PATTERNS, L.PERSONAL_PATTERNS):
        for kind, ps in patterns.items():
            make = D.l1 if patterns is L.L1_PATTERNS else D.personal
            got = column(spark, [text], lambda c, kind=kind, make=make: F.concat(*make(c, types=[kind])))[0]
            assert [(s.text, s.start, s.end) for s in got] == [(m.group(), m.start(), m.end()) for p in ps for m in re.finditer(p, text, re.I)], kind


def test_broken_emails_are_found_in_one_pass(spark):
    """The same texts as by a search from each word, with matches that follow each other, fail late or hold the mark."""
    rng = random.Random(3)
    texts = ["a b @ c . d e f @ g . h, i", "a @ b", ". a.b@ c .d", "\ufdd0 a @ b . al", *("".join(rng.choice("ab1 @@..-,;:\n\u00eb\u00a0") for _ in range(rng.randint(3, 40))) for _ in range(3000))]

    def fixed(m):
        plain = re.sub(r"\s+", "", m.group())
        return plain if re.search(N.WHOLE_EMAIL, plain, re.I) else m.group()

    assert column(spark, texts, N.fix_emails) == [re.sub(N.BROKEN_EMAIL, fixed, t) for t in texts]
    flat = pattern(N.BROKEN_EMAIL_ONCE)
    find = spark._jvm.java.util.regex.Pattern.compile(flat).matcher("a b " * 50_000 + ":").find
    began = time.perf_counter()
    assert not find() and time.perf_counter() - began < 5  # a search from each word reads 10 billion signs


@pytest.mark.parametrize(
    ("given", "expected"),
    [
        ("E l i o n a", "Eliona"),
        ("A r d i a n   L e s k a", "Ardian   Leska"),
        ("eliona . shk urti @ g mail . com", "eliona.shkurti@gmail.com"),
        ("+ 3 5 5 6 9 1 2 3 4 5 6 7", "+355 69 123 4567"),
        ("04 / 09 / 1996", "04/09/1996"),
        ("068 - 227 - 9810", "068-227-9810"),
        ("B A 1193308", "BA1193308"),
        ("Normal sentence", "Normal sentence"),
    ],
)
def test_normalise(spark, given, expected):
    assert column(spark, [given], N.normalise) == [expected]


def test_damage_flag(spark):
    # one of the five words of the second text is a single letter, more than 8 of 100
    texts = ["E l i o n a  S h k u r t i", "A clean sentence with words.", "Clean sentences hold longer words.", "", "1 2 3 4 5 6 7 8 9 0"]
    assert column(spark, texts, N.is_damaged) == [True, True, False, False, True]


def sequential(spans_):
    by_type = {}
    for s in spans_:
        by_type.setdefault(s[0], []).append(s)
    out = []
    for items in by_type.values():
        kept = []
        for s in sorted(items, key=lambda s: (s[1], s[1] - s[2])):
            if not any(k[1] <= s[1] and k[2] >= s[2] for k in kept):
                kept.append(s)
        out += kept
    final = []
    for s in sorted(out, key=lambda s: (s[1] - s[2], s[1])):
        if all(s[1] >= k[2] or s[2] <= k[1] for k in final):
            final.append(s)
    return final


def test_resolution_agrees_with_a_sequential_model(spark):
    rng = random.Random(7)
    sets = []
    for _ in range(80):
        sets.append([(rng.choice("ABC"), b := rng.randint(0, 40), b + rng.randint(1, 12)) for _ in range(rng.randint(0, 14))])
    df = spark.createDataFrame([(i, [(t, f"{k}", b, e, "x", None) for k, (t, b, e) in enumerate(s)]) for i, s in enumerate(sets)], f"i int, a {D.SPAN}")
    got = df.select("i", R.dedupe_overlapping(R.dedupe_contained(F.col("a"))).alias("a")).orderBy("i").collect()
    assert [[(s.entity_type, s.start, s.end) for s in r.a] for r in got] == [sequential(s) for s in sets]


def documents(spark, texts):
    return spark.createDataFrame([(str(i), f"cv{i}.txt", t, 1.0, None) for i, t in enumerate(texts)], "doc_key string, source_file string, text string, quality double, error string")


def test_tokens_count_from_the_end(spark):
    row = E.anonymise(documents(spark, ["see a@b.com; then c@d.com."])).first()
    assert row.anonymised_text == "see [EMAIL_2]; then [EMAIL_1]."
    assert [(t.token, t.value) for t in row.tokens] == [("[EMAIL_1]", "c@d.com"), ("[EMAIL_2]", "a@b.com")]


def test_header_name_and_restoring(spark):
    df = E.anonymise(documents(spark, ["\n Martin Repa \nwrites to a@b.com", None, ""]))
    rows = df.withColumn("back", R.restore(F.col("anonymised_text"), F.col("tokens"))).orderBy("doc_key").collect()
    assert rows[0].anonymised_text.strip().startswith("[PERSON_1]") and rows[0].back == rows[0].prepared_text
    assert [r.anonymised_text for r in rows[1:]] == ["", ""]


def test_records_and_summary(spark):
    df = records(E.anonymise(documents(spark, ["A@b.com a@B.com +355 69 123 4567 www.linkedin.com/in/x", "nothing here"])))
    one, two = df.orderBy("doc_key").collect()
    import hashlib

    assert one.candidate_fingerprint == hashlib.sha256(b"a@b.coma@b.com+355 69 123 4567").hexdigest()
    assert two.candidate_fingerprint == hashlib.sha256(b"cv1.txt").hexdigest()
    assert one.pii_fields.linkedin == "www.linkedin.com/in/x" and one.by_entity_type["EMAIL"] == 2
    s = batch_summary(df).first()
    assert (s.documents_total, s.documents_processed, s.documents_failed, s.total_pii_detected) == (2, 2, 0, 4)


def sanitised(spark, text, tokens=None):
    df = spark.createDataFrame([(text, tokens or {})], "text string, m map<string,string>")
    return S.sanitise_columns(df, "text", F.col("m"), "out").first().out


@pytest.mark.parametrize(
    ("text", "tokens", "expected"),
    [
        ("works inc[ORG_1]luding", None, "works incincluding"),
        ("used [ORG_1] daily", {"[ORG_1]": "Snowflake "}, "used Snowflake daily"),
        ("at [ORG_1]", {"[ORG_1]": "University of X"}, "at [UNIVERSITY]"),
        ("EDUCATION\nat [ORG_1]", None, "EDUCATION\nat [UNIVERSITY]"),
        ("EDUCATION\nx\nEXPERIENCE\nat [ORG_1]", None, "EDUCATION\nx\nEXPERIENCE\nat [COMPANY]"),
        ("SUMMARY\nTRAINING [ORG_1], [ORG_2]", None, "SUMMARY\nTRAINING [TRAINING_PROVIDER], [COMPANY]"),
        ("[EMAIL_1] in [LOCATION_2], Vienna", None, " in [LOCATION], [LOCATION]"),
        ("Email: [EMAIL_1] end", None, " end"),
        ("Dr. Anna Berg taught Udemy", None, "[PERSON] taught [TRAINING_PROVIDER]"),
        ("– [LOCATION_1], 'S DEGREE", None, "[DATE_RANGE]\nMaster's Degree —"),
        ("a\n\n\n\nb  c \n—\n", None, "a\n\nb c\n\n"),
    ],
)
def test_sanitise(spark, text, tokens, expected):
    assert sanitised(spark, text, tokens) == expected


class Model:
    def predict_entities(self, text, labels, threshold):
        return [{"text": m.group(), "label": "person name", "start": m.start(), "end": m.end(), "score": 0.9} for m in re.finditer("Zed", text)]


def test_model_layer(spark):
    text = ("x" * 90 + "\n") * 30 + "Zed"
    assert [(s["start"], s["entity_type"]) for s in M.model_spans(text, Model(), [], 0.5)] == [(len(text) - 3, "PERSON")]
    pieces = list(M.chunks(text))
    assert pieces[0][1] == 0 and pieces[-1][0].endswith("Zed") and all(text[at : at + len(p)] == p for p, at in pieces)


def test_verifying_model(spark):
    calls = []

    def ask(prompt):
        calls.append(prompt)
        return "broken" if len(calls) == 1 else '{"remaining_pii": [{"text": "Zed", "type": "PERSON"}, {"text": "absent", "type": "ORG"}]}'

    assert [(s["start"], s["end"]) for s in M.verified("a Zed", ask)] == [(2, 5)]
    assert M.verified("a", lambda p: "broken") == []
    df = E.anonymise(documents(spark, ["a@b.com knows Zed"]))
    got = M.merge_verified(M.with_verified_spans(df, lambda p: '{"remaining_pii": [{"text": "Zed", "type": "EMAIL"}]}')).first()
    assert got.anonymised_text == "[EMAIL_1] knows [EMAIL_2]" and got.llm_verify_count == 1


def test_marks_in_texts_and_one_search(spark):
    """A text that has the sign that parts matches keeps its spans; a pattern is searched once and compiled once."""
    from sparkveil.functions.regexlib import MARK

    df = spark.createDataFrame([(f"{MARK}a@b.com{MARK} ë c@d.org",), ("ë a@b.com c@d.org",)], "text string")
    got = [[(s["text"], s["start"], s["end"]) for s in r[0]] for r in df.select(F.concat(*D.l1(F.col("text"), types=["EMAIL"]))).collect()]
    assert got == [[("a@b.com", 1, 8), ("c@d.org", 12, 19)], [("a@b.com", 2, 9), ("c@d.org", 10, 17)]]
    plan = df.select(F.concat(*D.l1(F.col("text"), types=["EMAIL"])))._jdf.queryExecution().analyzed().toString()
    assert "lambda z" not in plan.split("regexp_replace(")[1].split(")")[0] and MARK in plan
