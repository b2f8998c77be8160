"""Language identification: script ranges narrow candidates, Viterbi over per-word scores labels spans.

Training counts hashed character n-grams (with word edges), whole words and scripts per
language over a bounded sample of the labelled rows; the model is a table of
(2**16 + scripts) x languages numbers, whatever the corpus holds.  A word's score for a
language is the log likelihood of its n-grams; languages in which the word's script hardly
occurs are no candidates.  A path through the words pays ``SWITCH`` at each change of
language; the best path (Viterbi) gives the spans.  Where no stretch of words gains more
than a switch costs, the best path has a single label, which is decided by prefix sums
without running the recursion.

Defined cases: null text, or a text without a letter, is ``und`` with score 0 and no spans; a
text of letters always gets a learned language; with no training rows every text is ``und``;
ties go to the language that sorts first; rows with the same doc_id, null or not, keep a row each;
a text may be as long as a row can be, its words are looked up together; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Rolling, map_batches, materialise

BUCKETS = 1 << 16
#: Labelled rows of each language that training may use on average (the documented bound of the sample).
TRAIN_ROWS = 4000
#: Languages that a model may have, a quarter of a megabyte each: more labels are an error, none is left out.
MAX_LANGUAGES = 512
SWITCH = 12.0
#: Words whose scores a task keeps: bounds its memory, not the result.
CACHE_WORDS = 150_000
#: First code point of each Unicode range that counts as one script.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Other Indic"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1400, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"), (0x30000, "Other"),
]
STARTS = [s for s, _ in SCRIPTS]
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_NUMBERS = np.array([NAMES.index(n) for _, n in SCRIPTS])


_ALPHA: list[np.ndarray] = []


def alpha() -> np.ndarray:
    """Which code points are letters."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


def scripts_of(code_points: np.ndarray) -> np.ndarray:
    return SCRIPT_NUMBERS[np.searchsorted(STARTS, code_points, "right") - 1]


class Letters:
    """The letters of a list of words, lower case, in one array: each word between the edges 2 and 3."""

    def __init__(self, words: list[str]) -> None:
        # Words hold no control 2 or 3 after this; an edge pair without letters is a word without any.
        joined = "\x03\x02".join([w.replace("\x02", "").replace("\x03", "") for w in words] if any("\x02" in w or "\x03" in w for w in words) else words)
        points = np.frombuffer(f"\x02{joined}\x03".lower().encode("utf-32-le", "replace"), "<u4")
        letter = alpha()[points]
        keep = letter | (points == 2) | (points == 3)
        self.points, letter = points[keep].astype(np.uint64), letter[keep]
        self.word = np.cumsum(self.points == 2) - 1
        self.letter = letter
        self.count = np.bincount(self.word[letter], minlength=len(words))

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(bucket, word) of the n-grams of 1 to 4 signs, by n, and of the whole words; words ascend."""
        p, word = self.points, self.word
        some = self.count[word] > 0
        h = p
        for n in range(1, 5):
            if n > 1:
                h = h[:-1] * np.uint64(0x100000001B3) ^ p[n - 1 :]
            ok = some[: len(h)] & (word[: len(h)] == word[n - 1 :])
            yield self._bucket(h[ok] + np.uint64(n << 40)), word[: len(h)][ok]
        edge = np.flatnonzero(p == 2)
        ok = self.count > 0
        ends = np.concatenate([edge[1:], [len(p)]])
        yield self._bucket(Rolling(p).spans(edge[ok], ends[ok])), np.flatnonzero(ok)

    @staticmethod
    def _bucket(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        """counts: (BUCKETS + scripts) x languages."""
        self.languages = languages
        grams, scripts = counts[:BUCKETS] + 0.05, counts[BUCKETS:] + 0.0
        self.table = np.log(grams / grams.sum(0)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0), 1)
        self.allowed = share >= 0.01


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from rows with text and lang; a language with more rows than the bound gives a hashed sample of about that many."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.lit(float(train_rows)) / F.col("n") * 1_000_000).alias("keep")))
    if (languages := share.count()) > MAX_LANGUAGES:
        raise ValueError(f"{languages} labels, a model holds {MAX_LANGUAGES}")
    # a row for each language, their number is checked: texts are sampled where they are read
    sample = rows.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("sample")), F.lit(1_000_000)) < F.col("keep")).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(text.split())
            for lang, found in words.items():
                if not found:
                    continue
                sums = total.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                letters = Letters([*found])
                weight = np.fromiter(found.values(), np.int64, len(found))
                for bucket, word in letters.grams():
                    sums[:BUCKETS] += np.bincount(bucket, weights=weight[word], minlength=BUCKETS).astype(np.int64)
                scripts = scripts_of(letters.points[letters.letter])
                sums[BUCKETS:] += np.bincount(scripts, weights=weight[letters.word[letters.letter]], minlength=len(NAMES)).astype(np.int64)
        for lang, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(sums[at])], schema=schema)

    found = map_batches(sample, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((BUCKETS + len(NAMES), len(languages)))
    counts[found["bucket"].to_numpy(), found["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(int)] = found["n"].to_numpy()
    return Model(languages, counts)


class Scorer:
    def __init__(self, model: Model) -> None:
        self.model, self.n = model, len(model.languages)
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, self.n), np.float32)
        self.letters = np.zeros(1 << 12, np.int32)

    def _score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, letters) of each word; the best language of a word scores 0."""
        letters = Letters(words)
        out = np.zeros((len(words), self.n), np.float32)
        if not self.n:
            return out, letters.count
        for bucket, word in letters.grams():
            if len(word):
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                out[word[first]] += np.add.reduceat(self.model.table[bucket], first, axis=0)
        # The script of most letters narrows the candidates.
        at = letters.word[letters.letter]
        by = np.bincount(at * len(NAMES) + scripts_of(letters.points[letters.letter]), minlength=len(words) * len(NAMES)).reshape(len(words), len(NAMES))
        ok = self.model.allowed[by.argmax(1)]
        narrow = ok.any(1) & ~ok.all(1) & (letters.count > 0)
        if narrow.any():
            low = np.where(ok[narrow], out[narrow], np.inf).min(1, keepdims=True) - 20
            out[narrow] = np.where(ok[narrow], out[narrow], low)
        return out - out.max(1, keepdims=True), letters.count

    def look_up(self, words: list[str]) -> None:
        seen = set(words)
        new = [*seen.difference(self.cache)]
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = [*seen]
        begin = len(self.cache)
        need = begin + len(new)
        if need > len(self.letters):
            size = 1 << need.bit_length()
            self.rows, self.letters = np.resize(self.rows, (size, self.n)), np.resize(self.letters, size)
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            at = begin + k
            self.rows[at : at + len(part)], self.letters[at : at + len(part)] = self._score(part)
        self.cache.update(zip(new, range(begin, need), strict=True))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The label of each word on the best path."""
    n, k = scores.shape
    if n == 0:
        return np.zeros(0, np.int64)
    sums = scores.sum(0, dtype=np.float64)
    best = int(sums.argmax())
    gain = np.cumsum(scores - scores[:, best : best + 1], 0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(gain, 0), 0)
    low = np.vstack([np.zeros((1, k)), low[:-1]])
    # Stretches of other labels beside the best one pay a switch each, so none may gain more than that;
    # a path without the best label pays one switch at least, or is a single label and no better.
    others = scores - scores[:, best : best + 1]
    others[:, best] = -np.inf
    if (gain - low).max() <= switch and (k == 1 or others.max(1).sum() <= switch):
        return np.full(n, best, np.int64)
    back = np.zeros((n, k), np.int64)
    here = scores[0].tolist()
    labels = range(k)
    for t, row in enumerate(scores[1:].tolist(), 1):
        top = max(labels, key=here.__getitem__)
        jump = here[top] - switch
        for x in labels:
            if jump > here[x]:
                back[t, x], row[x] = top, row[x] + jump
            else:
                back[t, x], row[x] = x, row[x] + here[x]
        here = row
    out = np.zeros(n, np.int64)
    at = max(labels, key=here.__getitem__)
    for t in range(n - 1, -1, -1):
        out[t] = at
        at = back[t, at]
    return out


OUT = "lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def label_rows(df: DataFrame, model: Model, text_col: str = "text", prefix: str = "_lang_") -> DataFrame:
    """Adds to every row the language of most letters (``pred``), its share of them (``score``) and runs of words by language (``spans``), names under a prefix."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
    fields = [pa.field(f"{prefix}pred", pa.string()), pa.field(f"{prefix}score", pa.float64()), pa.field(f"{prefix}spans", pa.list_(span))]
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.table, model.allowed))  # a fixed size for each language
    at_text = df.columns.index(text_col)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.languages, own.table, own.allowed = shared.value
        scorer = Scorer(own)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cut = [(t or "").split() for t in part.column(at_text).to_pylist()]
                scorer.look_up([w for words in cut for w in words])
                preds, shares, spans = [], [], []
                for words in cut:
                    k = np.fromiter(map(scorer.cache.__getitem__, words), np.int64, len(words))
                    letters = scorer.letters[k]
                    total = int(letters.sum())
                    if not total or not scorer.n:
                        preds.append("und")
                        shares.append(0.0)
                        spans.append([])
                        continue
                    path = viterbi(scorer.rows[k])
                    by = np.bincount(path, weights=letters, minlength=scorer.n)
                    top = int(by.argmax())
                    preds.append(own.languages[top])
                    shares.append(float(by[top] / total))
                    edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                    spans.append([{"start": s, "end": e, "lang": own.languages[path[s]]} for s, e in zip(edges, edges[1:], strict=False)])
                more = [pa.array(c, f.type) for c, f in zip((preds, shares, spans), fields, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], schema=pa.schema([*part.schema, *fields]))

    added = ", ".join(prefix + c for c in OUT.replace("lang_pred", "pred").split(", ", 2))
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(added).fields])
    return map_batches(df, label, schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, spans) of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return label_rows(rows, model).select("doc_id", F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score"), F.col("_lang_spans").alias("spans"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def predict_languages(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Learn from the labelled documents that are not held out and label every document."""
    model = train(docs.filter(~F.coalesce(held_out(), F.lit(False))), train_rows)
    got = identify(docs, model)
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_language_spans"))
