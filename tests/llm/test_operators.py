"""The training-data operators against brute force, round trips and defined cases."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkveil.llm import anchors as AN
from sparkveil.llm import chat_format as C
from sparkveil.llm import decontaminate as DC
from sparkveil.llm import language_id as LI
from sparkveil.llm import packing as P
from sparkveil.llm import pii
from sparkveil.llm import quality as Q
from sparkveil.llm import simhash as SH
from sparkveil.llm import substring_dedup as SB
from sparkveil.llm import suffix_dedup as SX
from sparkveil.llm import token_files as TF
from sparkveil.llm.components import connected_components
from sparkveil.llm.queries import tokenizer_path
from sparkveil.llm.word_tokens import WordEncoder

#: Extra columns whose names clash with what operators use inside.
SCHEMA = "doc_id long, text string, rid int, fp string, root int, found int, score string, spans int, akey int"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, "x", 1, 1, "s", 1, 1) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def words(rng, n, bag=("a", "b", "cé", "d", "ee", "f\n", "gg", "h")):
    return " ".join(rng.choice(bag) for _ in range(n))


ODD = [None, "", " ", "\n", "x", "a" * 5000, "x y " * 300]


def test_chat(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\b \\\\<|im_start|>x<\\|im_end|>", "[[INST]<<s>>", "\\", None, "", "<|im_sep|>\n\n"]
    rows = [(i // 3, i % 3, ["user", "assistant", "system", None, "a<|im_sep|>"][i % 5], texts[i % 7], 1) for i in range(60)]
    rows += [(99, 0, "user", "tie", 1), (99, 0, "user", "tie", 1)]
    got = {r.conv_id: r for r in C.formatted_digest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key int")).collect()}
    by = {}
    for c, t, r, x, _ in [*rows, (-7, 0, "user", C.SPECIAL, 1), (-7, 1, "assistant", C.SPECIAL, 1)]:
        by.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}], "x": 1},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "i", "input": "z", "output": "o"},
        {"prompt": "p", "completion": "c"},
        {"unknown": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, j string")
    got = {}
    for r in C.turns_of(df, "id", record=F.parse_json("j")).orderBy("key", "sub").collect():
        got.setdefault(r.key, []).append((r.role, r.text))
    assert got == {0: [("user", "hi"), ("assistant", "")], 1: [("user", "q"), ("assistant", "a")], 2: [("user", "i\nz"), ("assistant", "o")], 3: [("user", "p"), ("assistant", "c")]}


def test_language(spark):
    rng = random.Random(2)
    vocab = {"aa": ["lo", "mira", "casa", "sol"], "bb": ["the", "house", "sun", "with"], "cc": ["дом", "солнце", "вода", "мир"]}
    texts, langs = [], []
    for k in range(120):
        lang = sorted(vocab)[k % 3]
        texts.append(words(rng, 30, vocab[lang]))
        langs.append(lang)
    texts += [None, "", "123 !!", words(rng, 25, vocab["aa"]) + " " + words(rng, 20, vocab["cc"])]
    langs += [None, "aa", None, None]
    df = spark.createDataFrame([(i, t, g, 0.5, "x") for i, (t, g) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string, score double, lang_pred string")
    got = {r.doc_id: r for r in LI.predict_languages(df).collect()}
    assert len(got) == len(texts)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert np.mean([got[i].lang_pred == langs[i] for i in range(120)]) == 1
    assert [got[i].lang_pred for i in (120, 121, 122)] == ["und"] * 3 and got[123].n_language_spans == 2
    empty = LI.predict_languages(df.limit(0))
    assert empty.count() == 0


def best_path(scores, switch):
    n, k = scores.shape
    if n == 0:
        return 0.0
    here = scores[0].astype(float)
    for row in scores[1:]:
        here = row + np.maximum(here, here.max() - switch)
    return here.max()


def test_viterbi_is_optimal():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        for _ in range(30):
            s = -rng.exponential(3, (n, 3)).astype(np.float32)
            path = LI.viterbi(s, 4.0)
            got = float(s[np.arange(n), path].sum()) - 4.0 * int((np.diff(path) != 0).sum())
            assert got == pytest.approx(best_path(s, 4.0), abs=1e-3)


def simhash(text, n=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("long", [4096, 3])
def test_simhash(spark, monkeypatch, long):
    monkeypatch.setattr(SH, "LIST", long)
    rng = random.Random(4)
    base = words(rng, 400, [f"w{i}" for i in range(300)])
    texts = [*ODD, *ODD]
    for k in range(60):
        w = base.split()
        w[rng.randrange(len(w))] = f"new{k}"
        texts.append(" ".join(w))
    got = {r.doc_id: r for r in SH.simhash_components(docs(spark, texts)).collect()}
    fps = [simhash(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert [got[i].component_id for i in range(len(texts))] == roots(len(texts), pairs)
    assert SH.simhash_components(docs(spark, [])).count() == 0


def test_long_lists_link_as_short_ones_do():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 16, 700, dtype=np.uint64) << np.uint64(24))
    u, v = (fps[x] for x in SH.links(fps, 2))
    i, j = np.triu_indices(len(fps), 1)
    ok = SH.bits(fps[i] ^ fps[j]) <= 2
    assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == sorted(zip(fps[i[ok]].tolist(), fps[j[ok]].tolist(), strict=True))


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(50)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "u long, v long").repartition(7)).collect()}
    expected = roots(200, pairs)
    assert all(got.get(i, i) == expected[i] for i in range(200))


def test_decontamination(spark):
    rng = random.Random(8)
    bag = [f"t{i}" for i in range(500)]
    items = [words(rng, 30, bag) for _ in range(12)]
    edited = items[1].split()
    edited[7], edited[20] = "other", "changed"
    texts = [words(rng, 200, bag) + " " + items[0].upper() + " " + words(rng, 50, bag), words(rng, 40, bag) + " " + " ".join(edited), words(rng, 300, bag), None, "", *[items[2]] * 40]
    texts += ["before a Short item, after", "another text of this item stands here too"]
    more = [(12, None), (13, "short item"), (14, "?!"), (13, "another text of this item"), (13, "short item")]  # one item of several texts
    bench = spark.createDataFrame([(i, t, 1) for i, t in [*enumerate(items), *more]], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r for r in DC.find_leaks(docs(spark, texts), bench).collect()}
    assert set(got) == {(0, 0), (1, 1), *((i, 2) for i in range(5, 45)), (45, 13), (46, 13)}
    assert (got[45, 13].start, got[45, 13].end) == (2, 4) and (got[46, 13].start, got[46, 13].end) == (0, 5)
    assert (got[0, 0].score, got[0, 0].start, got[0, 0].end) == (1.0, 200, 230) and 0.8 < got[1, 1].score < 1
    assert DC.find_leaks(docs(spark, []), bench).count() == 0 and DC.find_leaks(docs(spark, texts), bench.limit(0)).count() == 0


def test_smith_waterman_against_a_table():
    rng = np.random.default_rng(9)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 25)), rng.integers(0, 5, rng.integers(1, 15))
        h = np.zeros((len(b) + 1, len(a) + 1), int)
        for j in range(1, len(b) + 1):
            for i in range(1, len(a) + 1):
                h[j, i] = max(0, h[j - 1, i - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[j - 1, i] - 1, h[j, i - 1] - 1)
        assert DC.smith_waterman(a, b)[0] == h.max()


@pytest.mark.parametrize(("name", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_word_encoder(name, spaces):
    rng = random.Random(10)
    texts = ["", " a", "a ", "a  b", "\n", "a\nb", "a\n\nb", "a \nb", "a b", "x 's", "it's. I'll", "<|endoftext|> x", "é é. b", "1. 2,", " 　x", "A.\n B", "İstanbul İ.", "a\x1cb"]
    texts += ["".join(rng.choice("ab.,' \n\té1!<") for _ in range(30)) for _ in range(500)]
    e = WordEncoder(tokenizer_path(name), spaces)
    assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def ids_of(name, text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids, end]


def test_token_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(TF, "FRAME_BYTES", 64)
    texts = ["second", None, "", "Some longer text, to span frames. " * 30, "dup", "dup"]
    numbers = [5, 1, 2, 3, 9, 9]
    got = TF.token_documents(docs(spark, texts, numbers), tokenizer_path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/t").orderBy("start").collect()
    at = 0
    for (i, t), r in zip(sorted(zip(numbers, texts, strict=True), key=lambda x: (x[0], x[1] or "")), got, strict=True):
        ids = ids_of("byte_bpe_50k.json", t, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    path = next((tmp_path / "t").glob("part-*"))
    data = bytearray(path.read_bytes())
    data[5] ^= 0xFF
    path.write_bytes(data)
    with pytest.raises(Exception), open(path, "rb") as f:  # noqa: B017, PT011
        TF.FrameReader(f, len(data)).document(0)
    assert TF.token_documents(docs(spark, []), tokenizer_path("byte_bpe_50k.json"), 2, f"file://{tmp_path}/e").count() == 0


def test_packing(spark):
    texts = ["word " * 9000, None, "", "a b c", "a b c"]
    got = P.pack_documents(docs(spark, texts), tokenizer_path("word_bpe_49k.json"), 1).toPandas()
    for i, t in enumerate(texts):
        ids = ids_of("word_bpe_49k.json", t, 1)
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.length.tolist() == [len(ids[k : k + 4096]) for k in range(0, len(ids), 4096)]
        assert mine.ids_crc32.tolist() == [zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()) for k in range(0, len(ids), 4096)]
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 4096
    assert P.pack_documents(docs(spark, []), tokenizer_path("word_bpe_49k.json"), 1).count() == 0


def test_bin_completion():
    rng = np.random.default_rng(11)
    # best-fit decreasing needs three bins here, two are enough
    assert len(P.best_fit_decreasing([6, 5, 5, 4], 10)) == 2 and len(P.bin_completion([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], 60)) == 3
    for _ in range(200):
        sizes = sorted(rng.integers(1, 60, rng.integers(0, 14)).tolist(), reverse=True)
        bins = P.bin_completion(sizes, 60)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 60 for b in bins)
        assert len(bins) <= len(P.best_fit_decreasing(sizes, 60))


def removed_bytes(texts, w=400):
    first = {}
    for t in texts:
        b = (t or "").encode()
        for k in range(len(b) - w + 1):
            first[b[k : k + w]] = first.get(b[k : k + w], 0) + 1
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - w + 1):
            if first[b[k : k + w]] > 1:
                gone[k : k + w] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), len(b) - len(kept), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(AN, "SHARD_CONTEXTS", hot)
    rng = random.Random(12)
    make = lambda n: "".join(rng.choice("ab cdefé ijk\n") for _ in range(n))
    shared = [make(700), make(410), make(390), make(500)]
    texts = [None, "", "a" * 900, *(make(rng.randint(0, 500)) + rng.choice(shared)[rng.randint(0, 40) :] + make(rng.randint(0, 200)) + rng.choice(shared) for _ in range(24))]
    texts += texts[5:7]
    got = {r.doc_id: r for r in SX.remove_repeats(docs(spark, texts)).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, len(got[i].spans), bytes(got[i].kept)) for i in range(len(texts))] == removed_bytes(texts)
    assert SX.remove_repeats(docs(spark, [])).count() == 0


def removed_words(ids, texts, w=50):
    split = [(t or "").encode().split() for t in texts]
    first = {}
    for i, x in zip(ids, split, strict=True):
        for k in range(len(x) - w + 1):
            h = tuple(x[k : k + w])
            first[h] = min(first.get(h, i), i)
    out = []
    for i, x in zip(ids, split, strict=True):
        gone = [False] * len(x)
        for k in range(len(x) - w + 1):
            if first[tuple(x[k : k + w])] < i:
                gone[k : k + w] = [True] * w
        out.append((len(x), sum(gone), b" ".join(a for a, g in zip(x, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [1000, 2])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(AN, "SHARD_CONTEXTS", hot)
    rng = random.Random(13)
    shared = [words(rng, n) for n in (70, 51, 49, 50, 200)]
    texts = [None, "", "a " * 300, *(words(rng, rng.randint(0, 60)) + " " + rng.choice(shared) + " " + words(rng, rng.randint(0, 30)) + " " + rng.choice(shared) for _ in range(30))]
    texts += texts[5:7]
    rng.shuffle(texts)
    got = {r.doc_id: r for r in SB.remove_passages(docs(spark, texts)).collect()}
    assert [(got[i].n_words, got[i].n_removed, bytes(got[i].kept)) for i in range(len(texts))] == removed_words(range(len(texts)), texts)
    assert SB.remove_passages(docs(spark, [])).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(14)
    s = rng.integers(0, 37, 500)
    tree = SB.WaveletMatrix(s, 37)
    c, at = rng.integers(0, 37, 300), rng.integers(0, 501, 300)
    assert tree.rank(c, at).tolist() == [int((s[:k] == x).sum()) for x, k in zip(c, at, strict=True)]


def luhn(s):
    return sum(v - 9 if v > 9 else v for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(s)))) % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def test_pii(spark):
    rng = random.Random(15)
    texts = [None, "", "+" * 50, "a@b.c@d.e-f._x@y.z", "1.2.3.4.5.6.7.8", "0001.2.3.255", "é 4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (555) 010-9999.", "9" * 20000, "a" * 20000 + "@"]
    texts += ["".join(rng.choice("0123456789..@@-- +ab()é4") for _ in range(80)) for _ in range(300)]
    got = {r.doc_id: r.spans for r in pii.find_pii(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        expected = [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, t or "") if ok(m.group())]
        assert [(s.kind, s.start, s.end) for s in got[i] if s.kind in pii.BASE] == expected
    more = docs(spark, ["IBAN DE89 3704 0044 0532 0130 00 ok DE89 3704 0044 0532 0130 01", "SSN: 123-45-6789", "part 123-45-6789", "mail a@b.cd now"])
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    kept = [f'token = "{key}" x', f"checksum {key}", "a token " + "w" * 30, "IBAN DE89 3704 0044 0532 0130 00 BANK", f"keys: api key {key}, {key}"]
    out = pii.find_pii(docs(spark, kept)).select(pii.redact(F.col("text"), F.col("spans"))).collect()
    assert [r[0] for r in out] == ['token = "[SECRET]" x', kept[1], kept[2], "IBAN [IBAN] BANK", "keys: api key [SECRET], " + key]
    rows = pii.find_pii(more).withColumn("out", pii.redact(F.col("text"), F.col("spans"))).orderBy("doc_id").collect()
    assert [r.out for r in rows][1:] == ["SSN: [SSN]", "part 123-45-6789", "mail [EMAIL] now"] and rows[0].out.startswith("IBAN [IBAN] ok DE89")


def test_quality(spark):
    clean = "This is a plain sentence with enough words in it to be kept by every rule there is, and more.\nAnother line follows here."
    texts = [None, "", clean, clean + "\nHome | About | Contact\nAll rights reserved.", "Home | About | Contact | Login\n" * 12, "BUY!! NOW!! IT!! IS!! " * 10, "same words again and again in it " * 20, clean + "\n" + clean]
    got = {r.doc_id: r for r in Q.quality(docs(spark, texts)).collect()}
    assert [got[i].kept for i in range(len(texts))] == [False, False, True, True, False, False, False, False]
    assert got[3].cleaned == clean and got[3].n_failed_lines == 2 and got[7].n_dup_lines == 2
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        places = {}
        for k in range(len(w) - 7):
            places.setdefault(tuple(w[k : k + 8]), []).append(k)
        covered = {j for v in places.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(covered))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(16)
    bag = ["the", "house", "sun", "with", "water", "stone", "river", "green", "light", "paper"]
    item = words(rng, 25, [f"q{i}" for i in range(60)])
    texts = [words(rng, 120, bag) for _ in range(40)]
    texts += [texts[0], texts[1] + " write to a@b.com now", words(rng, 60, bag) + " " + item, None, "123"]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs_ = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = stage(spark, docs_, str(tmp_path)).cache()
        assert docs_.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {r.doc_id: r.text for r in docs_.collect()}
    assert set(range(40)) <= set(kept) and not {40, 42, 43, 44} & set(kept)
    assert 41 not in kept or "[EMAIL]" in kept[41]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(kept)
