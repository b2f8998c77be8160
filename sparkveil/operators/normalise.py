"""Repair of damaged texts (NRM-1 to NRM-8): text column to text column, SQL functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Options
from ..functions.regexlib import MARK, gated, let, pattern, replace_with

# The shapes that are repaired.
BROKEN_EMAIL = r"[\w][\w\s.\-]*?\s*@\s*[\w][\w\s\-]*?\s*\.\s*[\w][\w\s\-]*?(?:\s*\.\s*[\w]+)*(?=[\s,;]|$)"
#: BROKEN_EMAIL as its second group, found in one pass: the signs before @ and before the first dot have no choice, and where the first word
#: of a run of such signs (or of what a match left of it) begins no match, no other word of the run does.  The first group is what goes before.
BROKEN_EMAIL_ONCE = r"(?:\G|(?<![\w\s.\-]))([\s.\-]*+)(\w[\w\s.\-]*+@\s*+\w[\w\s\-]*+\.\s*+\w[\w\s\-]*?(?:\s*\.\s*[\w]+)*(?=[\s,;]|$))"
WHOLE_EMAIL = r"^[\w.\-]+@[\w.\-]+\.[a-z]{2,}$"
BROKEN_URLS = [r"linked\s*in\s*\.\s*com\s*/\s*in\s*/\s*[\w\s\-]+", r"git\s*hub\s*\.\s*com\s*/\s*[\w\s\-/]+"]
LETTER = "[A-Za-zÇËçëÄä]"
SPACED_LETTERS = rf"\b(?:{LETTER}\s+){{2,}}{LETTER}\b"
#: Digit rewrites in order; the first three merge spaces to the fixpoint in one pass each.
DIGIT_REWRITES = [
    (r"\+\s+(?=\d)", "+"),
    (r"(?<=\d) (?=\d)", ""),
    (r"(?<=\d)\s{2,3}(?=\d)", ""),
    (r"\+355\s*\(\s*0\s*\)\s*", "+355 "),
    (r"\+355(\d{2})(\d{3})(\d{4})\b", "+355 $1 $2 $3"),
    (r"\b(0[6-9]\d)(\d{3})(\d{4})\b", "$1 $2 $3"),
    (r"(\d{1,4})\s*/\s*(\d{1,4})\s*/\s*(\d{1,4})", "$1/$2/$3"),
    (r"\b([A-Z])\s*(\d{6,9})\s*([A-Z])\b", "$1$2$3"),
    (r"\b([A-Z])\s+([A-Z])\s+(\d{6,9})\b", "$1$2$3"),
    (r"\b([A-Z]{2})\s+(\d{6,9})\b", "$1$2"),
    (r"(\d)\s*-\s*(\d)", "$1-$2"),
]
PREPROCESS = [
    (r"(\w)\s*\n?\s*@\s*\n?\s*(\w)", "$1@$2"),
    (r"(linkedin\.com|github\.com)/\s*\n\s*(\w)", "$1/$2"),
    (r"\(\s*(\+\d{1,4})\s*\)", "$1"),
]


def _rewrite(text: Column, steps) -> Column:
    return reduce(lambda col, step: F.regexp_replace(col, pattern(step[0]), step[1]), steps, text)


def is_damaged(text: Column, options: Options = Options()) -> Column:
    """NRM-1: many single letters, or many pairs of digits split by a space, in the sample."""
    sample = F.substring(text, 1, options.ocr_sample)
    tokens = F.filter(F.split(sample, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")
    singles = F.size(F.filter(tokens, lambda t: t.rlike(r"\A\p{L}\z")))
    lines = F.size(F.split(sample, "\n", -1))
    pairs = F.regexp_count(sample, F.lit(pattern(r"\d \d")))
    return F.when(F.size(tokens) == 0, False).otherwise((singles / F.size(tokens) > options.ocr_letter_share) | (pairs / lines > options.ocr_digit_pairs_per_line))


def fix_emails(text: Column) -> Column:
    """NRM-2."""

    def whole(m: Column) -> Column:
        plain = F.regexp_replace(m, r"(?U)\s+", "")
        return F.when(plain.rlike(pattern(WHOLE_EMAIL, ignore_case=True)), plain).otherwise(m)

    def fixed(t: Column) -> Column:
        cut = F.split(F.regexp_replace(t, pattern(BROKEN_EMAIL_ONCE), f"$1{MARK}$2{MARK}"), MARK, -1)
        once = F.array_join(F.transform(cut, lambda q, i: F.when(i % 2 == 1, whole(q)).otherwise(q)), "")
        return F.when(t.contains(MARK), replace_with(t, pattern(BROKEN_EMAIL), whole)).otherwise(once)

    return let(text, lambda t: F.when(t.contains("@"), fixed(t)).otherwise(t))


def fix_urls(text: Column) -> Column:
    """NRM-3: white space goes from the whole match, which reaches to the next other sign."""
    return reduce(lambda col, p: replace_with(col, pattern(p, ignore_case=True), lambda m: F.regexp_replace(m, r"(?U)\s+", "")), BROKEN_URLS, text)


def merge_digits(text: Column) -> Column:
    """NRM-4a to 4i."""
    return _rewrite(text, DIGIT_REWRITES)


def merge_letters(text: Column) -> Column:
    """NRM-5: only single spaces between letters vanish; wider gaps stay as word bounds."""
    return replace_with(text, pattern(SPACED_LETTERS), lambda m: F.regexp_replace(m, rf"(?<={LETTER}) (?={LETTER})", ""))


def normalise(text: Column) -> Column:
    """NRM-6, as a single expression; the engine applies the passes as successive columns."""
    return merge_letters(merge_digits(fix_urls(fix_emails(text))))


PASSES = (fix_emails, fix_urls, merge_digits, merge_letters)


def preprocess(text: Column) -> Column:
    """NRM-8."""
    gates = (lambda t: t.contains("@"), lambda t: t.rlike(r"\.com/\P{Graph}"), lambda t: t.rlike(r"\(\P{Graph}*\+"))
    return reduce(lambda t, x: gated(t, x[0], lambda v: _rewrite(v, [x[1]])), zip(gates, PREPROCESS, strict=True), text)
