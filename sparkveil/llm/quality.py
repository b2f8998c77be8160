"""Quality rules, line first: lines that fail punctuation, navigation or boilerplate rules go, then documents that lose too much.

Counts (whole text, words as runs of non-white-space): word_chars, n_symbols, n_dup_lines,
n_repeat_words.  A document fails at once if it has few words or mostly repeats itself
(``base_failed``); else it is kept unless cleaning takes more than ``MAX_LOST`` of its word
characters or nothing is left.

A line of words fails if

* punctuation: more than ``MAX_MARKS`` exclamation and question marks or ``MAX_SYMBOLS`` symbols
  (``#*$%&<>``) for each word, or it is
  short (under ``SHORT`` words) and ends without a mark of ``TERMINAL``;
* navigation: it is a row of short entries between two or more separators, or at most three
  words one of which is a navigation word, without an end mark;
* boilerplate: it holds one of the ``BOILERPLATE`` phrases.

Words are runs between ASCII white space everywhere, whatever the length of a line.

Defined cases: null text has no words, so it fails; equal lines are counted from the second on;
rows with the same doc_id, null or not, keep a row each; a text may be as long as a row can be, the
work grows with its length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Rolling, map_batches, text_rows

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MAX_LOST, MAX_MARKS, MAX_SYMBOLS, SHORT = 0.5, 0.5, 0.2, 4
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
TERMINAL = tuple(".!?…\"'”’»):;。！？")
#: Phrases and words of page furniture.
BOILERPLATE = re.compile(
    r"all rights reserved|cookie(?:s)? policy|use(?:s)? cookies|privacy policy|terms of (?:use|service)|terms and conditions|enable javascript|"
    r"lorem ipsum|click here|sign up for|subscribe to|log in to|powered by|copyright ©|© ?[0-9]{4}|share on facebook|follow us on|back to top|skip to (?:main )?content",
    re.IGNORECASE,
)
NAVIGATION_WORDS = frozenset("home menu login logout register search contact about next previous prev back sitemap faq help share print subscribe archive".split())
SEPARATORS = re.compile(r"[\x20\x09-\x0D][|>»›•·/][\x20\x09-\x0D]|[\x20\x09-\x0D]?[|»›•][\x20\x09-\x0D]?")


def line_fails(line: str, words: list[bytes]) -> str | None:
    """The rule that a line fails, if any; words are those of the line, in UTF-8."""
    n = len(words)
    if sum(map(line.count, "!?")) > MAX_MARKS * n + 1:
        return "punctuation"
    if sum(map(line.count, SYMBOLS)) - line.count("|") > MAX_SYMBOLS * n:
        return "symbols"
    ended = words[-1].decode().endswith(TERMINAL)
    if any(x in line for x in "|>»›•·/"):
        cells = SEPARATORS.split(line.strip(SPACES))
        if len(cells) >= 3 and n <= 4 * len(cells):
            return "navigation"
    if n <= 3 and not ended and any(w.decode().lower().strip(":|>") in NAVIGATION_WORDS for w in words):
        return "navigation"
    if BOILERPLATE.search(line):
        return "boilerplate"
    if n < SHORT and not ended:
        return "punctuation"
    return None


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows of consecutive words that are found twice or more."""
    if len(words) < window:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    h = Rolling(ids * np.uint64(2) + np.uint64(1)).windows(window)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(h), np.int64)
    hit[order[1:][same]] = 1
    hit[order[:-1][same]] = 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[: len(h)] += hit
    edge[window : window + len(h)] -= hit
    return int((np.cumsum(edge) > 0).sum())


def judge(text: str) -> tuple[int, int, int, int, int, bool, bool, int, str]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines, cleaned)."""
    words = text.encode("utf-8", "replace").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dups = failed = lost = 0
    left: list[str] = []
    for line in text.split("\n"):
        own = line.encode("utf-8", "replace").split()
        if not own:
            left.append(line)
            continue
        if line in seen:
            dups += 1
        seen.add(line)
        if line_fails(line, own):
            failed += 1
            lost += len(line) - sum(map(line.count, SPACES))
        else:
            left.append(line)
    repeats = repeat_words(words)
    base_failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    kept = not base_failed and lost <= MAX_LOST * word_chars
    return n, word_chars, symbols, dups, repeats, base_failed, kept, failed, "\n".join(left)


COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, cleaned string"


def quality(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document, and its text without the lines that failed."""
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.string()]
    schema = pa.schema([("doc_id", pa.int64()), *zip([c.split()[0] for c in COLUMNS.split(", ")[1:]], kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(texts), 500):
                got = [judge(t or "") for t in texts.slice(at, 500).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 500), *(pa.array([g[i] for g in got], k) for i, k in enumerate(kinds))], schema=schema)

    return map_batches(text_rows(docs), run, COLUMNS)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SPACE = r"[\x20\x09-\x0D]"
#: The same counts and verdict in DuckDB.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT r, doc_id, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_words, length(regexp_replace(t, {_q(_SPACE)}, '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
u AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
k AS (SELECT r, i, CASE WHEN lead(word, {WINDOW - 1}) OVER o IS NOT NULL THEN array_to_string(list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING), ' ') END AS key FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, CASE WHEN key IS NOT NULL AND count(*) OVER (PARTITION BY r, key) > 1 THEN 1 ELSE 0 END AS hit FROM k),
v AS (SELECT r, max(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS covered FROM h),
p AS (SELECT r, sum(covered) AS n_repeat_words FROM v GROUP BY r),
l AS (SELECT r, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS inner_line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
m AS (SELECT r, line, len(ws) AS n, list_contains([{", ".join(map(_q, TERMINAL))}], right(ws[-1], 1)) AS ended, len(list_filter(ws, lambda w: list_contains([{", ".join(map(_q, sorted(NAVIGATION_WORDS)))}], trim(lower(w), ':|>')))) > 0 AS nav,
  length(regexp_replace(line, '[^!?]', '', 'g')) AS marks, length(regexp_replace(line, '[^#*$%&<>]', '', 'g')) AS symbols,
  len(string_split_regex(inner_line, {_q(SEPARATORS.pattern)})) AS cells, regexp_matches(line, {_q("(?i)" + BOILERPLATE.pattern)}) AS boiler, length(regexp_replace(line, {_q(_SPACE)}, '', 'g')) AS chars FROM l WHERE len(ws) > 0),
f AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, sum(CASE WHEN marks > {MAX_MARKS} * n + 1 OR symbols > {MAX_SYMBOLS} * n OR (cells >= 3 AND n <= 4 * cells) OR (n <= 3 AND NOT ended AND nav) OR boiler OR (n < {SHORT} AND NOT ended) THEN chars ELSE 0 END) AS lost FROM m GROUP BY r),
x AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost FROM c LEFT JOIN p USING (r) LEFT JOIN f USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND lost <= {MAX_LOST} * word_chars AS kept FROM x
"""
