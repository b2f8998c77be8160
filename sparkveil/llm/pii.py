"""Personal data in texts, with SQL functions only.

Regular expressions propose spans, validators confirm them (Luhn for cards, modulo 97 for
IBANs, ranges for addresses, digit counts for phones), and words near a candidate adjust its
score.  The base kinds (email, ip, card, phone) always count; the method adds the kinds
``iban`` (modulo 97 decides; where groups of capitals follow, the longest valid start counts), ``ssn``
and ``secret`` (keys and tokens: a long run of letters and digits), bare patterns that count only
with a context word within ``NEAR`` characters before them.

Spans count code points, the end exclusive.  Patterns are possessive or start at a run's edge,
so no text makes them backtrack far.  ``\\G`` lets a match begin where the last one ended.

Defined cases: null text is empty and has no spans; kinds are searched independently, so spans
of different kinds may overlap; rows with the same doc_id keep a row each; other columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regexlib import let, running, spliced
from .common import free_prefix, text_rows

NEAR = 40
THRESHOLD = 0.5

#: kind -> pattern (Java), in the order of the result.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+",
}
BASE = ("email", "ip", "card", "phone")
#: Cheap tests that a text must pass for a kind's pattern to be run at all.
GATES = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "secret": r"(?i)(?:token|secret|key|passw|credential|bearer)"}
#: kind -> (prior of a validated candidate, context words, what a near context word adds).
SCORES = {
    "email": (1.0, "", 0.0),
    "ip": (1.0, "", 0.0),
    "card": (1.0, "", 0.0),
    "phone": (1.0, "", 0.0),
    "iban": (0.8, r"iban|account|konto|cuenta|compte|bank", 0.2),
    "ssn": (0.3, r"ssn|social security|sozialversicherung|seguridad social|sécurité sociale|tax id|social", 0.5),
    "secret": (0.3, r"token|secret|api[ _-]?key|access[ _-]?key|private[ _-]?key|passw|credential|bearer", 0.5),
}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""
    d = F.split(F.reverse(digits(value)), "")
    total = F.aggregate(
        F.transform(d, lambda x, i: F.when(x == "", 0).otherwise(F.when(i % 2 == 0, x.cast("int")).otherwise(F.pmod(x.cast("int") * 2 - 1, F.lit(9)) + F.when(x == "0", -8).otherwise(1)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def mod97(value: Column) -> Column:
    """Whether a value without spaces is a valid IBAN: letters become 10 to 35, the number read from the fifth sign on leaves 1."""
    plain = F.regexp_replace(value, r"\x20", "")
    turned = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    rest = F.aggregate(turned, F.lit(0), lambda a, x: F.when(x == "", a).when(x.between("0", "9"), (a * 10 + x.cast("int")) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97))
    return (rest == 1) & F.length(plain).between(15, 34)


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.length(F.regexp_replace(x, "^0+(?=.)", "")).between(1, 3) & (F.regexp_replace(x, "^0+(?=.)", "").try_cast("int") <= 255))
    if kind == "card":
        # the length is tested first, so that Luhn runs on few candidates
        return F.when(F.length(digits(value)).between(16, 19), luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    if kind == "iban":
        return mod97(value)
    if kind == "secret":  # letters and digits mixed, as no word or number has them
        return (F.length(F.regexp_replace(value, r"[^0-9]", "")) >= 4) & (F.length(F.regexp_replace(value, r"[^A-Za-z]", "")) >= 4)
    return F.lit(True)


def shortened(kind: str, value: Column) -> Column:
    """The part of a candidate that counts: of an IBAN the longest valid start in whole groups, if the whole is none."""
    if kind != "iban":
        return value
    groups = F.split(value, r"\x20")
    starts = let(groups, lambda g: F.transform(F.sequence(F.size(g), F.lit(1)), lambda n: F.array_join(F.slice(g, F.lit(1), n), " ")))
    return F.coalesce(F.try_element_at(F.filter(starts, mod97), F.lit(1)), value)


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, score>> of the confirmed spans of a kind, in order of start."""
    pattern, (prior, words, gain) = F.lit(PATTERNS[kind]), SCORES[kind]
    kind_type = "array<struct<kind:string,start:int,end:int,score:double>>"

    def placed(p: Column) -> Column:
        """The confirmed ones of matches (m, after the text g and the match last) with their places."""
        at = running(F.transform(p, lambda y: F.length(y["g"]) + F.length(y["m"])))
        whole = F.zip_with(p, at, lambda y, n: F.struct(shortened(kind, y["m"]).alias("m"), F.concat(y["last"], y["g"]).alias("ahead"), (n + F.length(y["g"])).cast("int").alias("start")))
        return F.transform(
            F.filter(whole, lambda y: valid(kind, y["m"])),
            lambda y: F.struct(y["start"].alias("start"), (y["start"] + F.length(y["m"])).alias("end"), (F.lower(F.right(y["ahead"], F.lit(NEAR))) if words else F.lit("")).alias("before")),
        )

    def located(x: Column) -> Column:
        """Candidates with their places: the texts between matches give the offsets."""
        last = F.concat(F.array(F.lit("")), x["m"])  # context may reach over the match before
        pairs = F.zip_with(x["m"], F.slice(x["g"], 1, F.size(x["m"])), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        return let(F.zip_with(pairs, F.slice(last, 1, F.size(x["m"])), lambda y, b: F.struct(y["m"].alias("m"), y["g"].alias("g"), b.alias("last"))), placed)

    def scored(s: Column) -> Column:
        score = F.lit(prior) if not words else F.lit(prior) + F.when(s["before"].rlike(words), gain).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, PATTERNS[kind], -1).alias("g"))
    found = F.transform(let(both, located), scored)
    if words:
        found = F.filter(found, lambda s: s["score"] >= THRESHOLD)
    return F.when(text.rlike(GATES[kind]), found.cast(kind_type)).otherwise(F.array().cast(kind_type))


def find_pii_columns(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the spans of all kinds in a text column (not null), by kind as listed, then start; other columns stay."""
    # one kind a projection: each refers to the text only
    own = free_prefix(df, "_pii_")
    parts = reduce(lambda frame, kind: frame.withColumn(own + kind, spans_of(F.col(text), kind)), PATTERNS, df)
    return parts.withColumn(out, F.concat(*(F.col(own + k) for k in PATTERNS))).drop(*(own + k for k in PATTERNS))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans) of every document."""
    rows = text_rows(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return find_pii_columns(rows, "text", "spans")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(text: Column, spans: Column) -> Column:
    """The text with each stretch of spans replaced by ``[KIND]`` of its first span; overlapping spans become one."""

    def stretches(whole: Column, k: Column) -> Column:
        reach = running(F.transform(k, lambda x: x["end"]), maximum=True)
        firsts = F.zip_with(k, reach, lambda x, m: F.when(x["start"] >= m, F.struct(m.cast("int").alias("at"), x["start"].alias("start"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("put"))))
        return spliced(whole, F.filter(firsts, lambda x: x.isNotNull()), F.array_max(F.transform(k, lambda x: x["end"])))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return let(F.struct(text.alias("text"), ordered.alias("spans")), lambda x: F.when(F.size(x["spans"]) == 0, x["text"]).otherwise(stretches(x["text"], x["spans"])))
