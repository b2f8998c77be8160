"""The sanitiser (SAN-1 to SAN-14): masked text and token map to text for readers, SQL functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.regexlib import alternation, gated, holds, let, pattern, replace_with, strip

TOKEN = rf"\[(?:{'|'.join(L.TOKEN_TYPES)})_\d+\]"
LABEL = r"\[(?:COMPANY|UNIVERSITY|TRAINING_PROVIDER|LOCATION|URL)\]"

# Shapes of education lines and of what is cleaned up, in order.
MASTERS = (r"^([ \t]*)([–—-]+[ \t]*)?\[LOCATION\][^'A-Za-z\n]*'S DEGREE", "$1[DATE_RANGE]\n$1Master's Degree —")
BACHELOR = (r"^([ \t]*)([–—-]+[ \t]*)?\[LOCATION\][^\n]*?\bBACHELOR DEGREE\b", "$1[DATE_RANGE]\n$1Bachelor Degree —")
DATE_LINE = (r"^[ \t]*[–—-]+[ \t]*\[LOCATION\]\s*,\s*\[LOCATION\]\s*$", "[DATE_RANGE]")
DATE_UNIVERSITY_LINE = (r"^[ \t]*[–—-]+[ \t]*\[LOCATION\]\s*,?\s*\[UNIVERSITY\]\s*$", "[DATE_RANGE]\n[UNIVERSITY]")
INSTITUTION = (r"\bUniversiteti\s+Europian\s+i\b[^,\[\n\)]*(?:,\s*\[LOCATION\])?", "[UNIVERSITY]")
GRADUATED = (r"\(graduated at [^\)\n]+\)", "")
OWN_LINE = (r"((?:Master'?s|Bachelor) Degree\s*[^\n]+?)\s*,?\s*\[UNIVERSITY\](?:\s*,\s*\[LOCATION\])?", "$1\n[UNIVERSITY]")
HIGH_SCHOOL = r"[“”\"]?Qemal Stafa[“”\"]?\s*(?:High(?:\s+School)?)?"
QUOTED_LABEL = r"[\"“”‘’](\[(?:UNIVERSITY|COMPANY|TRAINING_PROVIDER|LOCATION|URL|PERSON)\])[\"“”‘’]?"
TITLED_PERSON = r"\b(?:Prof\.?[^\S\n]+)?Dr\.?[^\S\n]+[A-Z][a-zA-Z]+(?:[^\S\n]+[A-Z][a-zA-Z]+)+\b"
BARE_ADDRESS = r"^[ \t]*Address\s*:?\s*$"
CLEANUP = [(r"^[ \t]+$", ""), (r"^[ \t]*[–—-]+[ \t]*$", ""), (BARE_ADDRESS, ""), (r"[ \t]+$", ""), (r"\n{3,}", "\n\n"), (r"  +", " ")]


def _sub(text: Column, p: str, to: str, **flags) -> Column:
    return F.regexp_replace(text, pattern(p, **flags), to)


def field_labels(text: Column) -> Column:
    """SAN-1."""
    words = ("birth", "phone", "email", "mail", "mobile")
    return reduce(lambda t, x: gated(t, lambda v: holds(v, [x[1]]), lambda v: _sub(v, x[0], "", ignore_case=True)), zip(L.FIELD_LABELS, words, strict=True), text)


def repair_words(text: Column) -> Column:
    """SAN-2 (SAN-3 never changes a text): a token and the rest of a word become the word."""
    words = "|".join(sorted(L.SUFFIX_REPAIR, key=len, reverse=True))
    table = F.create_map(*(F.lit(x) for pair in L.SUFFIX_REPAIR.items() for x in pair))
    return gated(text, lambda t: t.contains("["), lambda t: _repaired(t, words, table))


def _repaired(text: Column, words: str, table: Column) -> Column:
    return replace_with(text, TOKEN + rf"(?:{words})(?![a-z])", lambda m: F.element_at(table, F.regexp_extract(m, r"\]([a-z]+)$", 1)))


def _holds(low: Column, words: list[str]) -> Column:
    return low.rlike(alternation(words))


def by_name(original: Column) -> Column:
    """SAN-5: a tool's own name, nothing for junk, or the kind of organisation."""
    low = strip(F.lower(original))
    return (
        F.when(low.isin(*L.TECH_TOOLS), strip(original))
        .when((low == "") | original.contains("\n") | (F.length(low) < 2), "")
        .when(_holds(low, L.UNIVERSITY_WORDS), "[UNIVERSITY]")
        .when(_holds(low, L.TRAINING_WORDS), "[TRAINING_PROVIDER]")
        .otherwise("[COMPANY]")
    )


def by_section(header: Column) -> Column:
    """SAN-6: the kind of organisation by the nearest header before it."""
    low = F.lower(header)
    return F.when(low.isin(*L.EDUCATION_SECTIONS), "[UNIVERSITY]").when(low.isin(*L.TRAINING_SECTIONS), "[TRAINING_PROVIDER]").otherwise("[COMPANY]")


def replace_tokens(text: Column, token_map: Column) -> Column:
    """SAN-4 to SAN-6.  The nearest header is carried along the organisations' tokens as they come."""
    return gated(text, lambda t: t.contains("["), lambda t: _replaced(t, token_map))


def _replaced(text: Column, token_map: Column) -> Column:
    plain = _sub(text, rf"\[(?:{'|'.join(t for t in L.REMOVED_TYPES)})_\d+\]", "")
    marks = _sub(_sub(plain, r"\[URL_\d+\]", "[URL]"), r"\[LOCATION_\d+\]", "[LOCATION]")
    org = r"\[ORG_\d+\]"
    line = pattern(rf"^[ \t]*({L.SECTION_HEADER})[ \t]*$", ignore_case=True, multiline=True)

    def joined(x: Column) -> Column:
        """Gaps are those of the masked text, so that headers are seen as they stood there."""

        def step(a: Column, y: Column) -> Column:
            before = F.concat(a["tail"], y["g"])
            partial = F.substring_index(before, "\n", -1)
            # A header is a whole line; the line that the token stands on counts for this token only.
            passed = F.regexp_extract_all(F.left(before, F.length(before) - F.length(partial)), F.lit(line), F.lit(1))
            header = F.when(F.size(passed) > 0, F.element_at(passed, -1)).otherwise(a["header"])
            own = F.regexp_extract(partial, line, 1)
            named = F.try_element_at(token_map, y["m"])
            label = F.when(named.isNotNull(), by_name(named)).otherwise(by_section(F.when(own != "", own).otherwise(header)))
            return F.struct(header.alias("header"), F.concat(partial, y["m"]).alias("tail"), F.concat(a["out"], F.array(label)).alias("out"))

        start = F.struct(F.lit("").alias("header"), F.lit("").alias("tail"), F.array().cast("array<string>").alias("out"))
        pairs = F.arrays_zip(x["m"].alias("m"), F.slice(x["g"], 1, F.size(x["m"])).alias("g"))
        return F.aggregate(pairs, start, step)["out"]

    def labelled(x: Column) -> Column:
        labels = joined(x)
        gaps = F.split(marks, org, -1)
        return F.array_join(F.flatten(F.zip_with(gaps, labels, lambda g, t: F.array(g, F.coalesce(t, F.lit(""))))), "")

    both = F.struct(F.regexp_extract_all(text, F.lit(org), F.lit(0)).alias("m"), F.split(text, org, -1).alias("g"))
    return F.when(text.rlike(org), let(both, labelled)).otherwise(marks)


def label_fragments(text: Column) -> Column:
    """SAN-7."""
    fixed = lambda t: F.regexp_replace(F.regexp_replace(t, LABEL + r"red(?![a-z0-9])", "shared"), LABEL + r"([a-z][a-z0-9]*)", "$1")
    return gated(text, lambda t: t.contains("]"), fixed)


def explicit_addresses(text: Column) -> Column:
    """SAN-8."""
    return gated(text, lambda t: t.contains("Address"), _addresses)


def _addresses(text: Column) -> Column:
    return _sub(_sub(text, r"\bAddress\s+(?!\[ADDRESS_REDACTED\])([A-Z0-9\[][^\n]{5,})", "Address [ADDRESS_REDACTED]", multiline=True), BARE_ADDRESS, "", multiline=True)


def explicit_places(text: Column) -> Column:
    """SAN-9."""
    first = "[" + "".join(sorted({c[0] for c in L.PLACES})) + "]"
    return gated(text, lambda t: t.rlike(rf"(?={first}){alternation(L.PLACES)}"), lambda t: _sub(t, rf"\b{alternation(L.PLACES)}\b", "[LOCATION]"))


def employers(text: Column) -> Column:
    """SAN-10."""
    return gated(text, lambda t: holds(t, [e.lower() for e in L.EMPLOYERS]), lambda t: _sub(t, rf"\b{alternation(L.EMPLOYERS, longest_first=False)}\b", "[COMPANY]", ignore_case=True))


def named_persons(text: Column) -> Column:
    """SAN-11."""
    titled = gated(text, lambda t: t.contains("Dr"), lambda t: _sub(t, TITLED_PERSON, "[PERSON]"))
    return reduce(lambda t, n: gated(t, lambda v: holds(v, [n.lower()]), lambda v: _sub(v, rf"\b{alternation([n])}\b", "[PERSON]", ignore_case=True)), L.PERSONS, titled)


def training(text: Column) -> Column:
    """SAN-12."""
    text = gated(text, lambda t: holds(t, [w.lower() for w in L.TRAINING_PLATFORMS]), lambda t: _sub(t, rf"\b{alternation(L.TRAINING_PLATFORMS)}\b", "[TRAINING_PROVIDER]", ignore_case=True))
    text = gated(text, lambda t: holds(t, ["qemal stafa"]), lambda t: _sub(t, HIGH_SCHOOL, "[UNIVERSITY]", ignore_case=True))
    return gated(text, lambda t: t.contains("["), lambda t: _sub(t, QUOTED_LABEL, "$1"))


def education_lines(text: Column) -> Column:
    """SAN-13."""
    lines = {"ignore_case": True, "multiline": True}
    steps = [
        (["[location]"], MASTERS, lines), (["[location]"], BACHELOR, lines), (["—"], (r"—\s*-\s*", "— "), {}), (["profile:"], (r"\s*-\s*PROFILE:\s*", ", "), {"ignore_case": True}),
        (["[location]"], DATE_LINE, {"multiline": True}), (["[location]"], DATE_UNIVERSITY_LINE, {"multiline": True}),
        (["europian"], INSTITUTION, {"ignore_case": True}), (["(graduated at"], GRADUATED, {"ignore_case": True}), (["[university]"], OWN_LINE, {"ignore_case": True}),
    ]
    return reduce(lambda t, s: gated(t, lambda v: holds(v, s[0]), lambda v: _sub(v, *s[1], **s[2])), steps, text)


def cleanup(text: Column) -> Column:
    """SAN-14."""
    return reduce(lambda t, s: _sub(t, *s, multiline=True), CLEANUP, text)


#: The steps in order; the token step also takes the map of tokens.
STEPS = (field_labels, repair_words, replace_tokens, label_fragments, explicit_addresses, explicit_places, employers, named_persons, training, education_lines, cleanup)


def sanitise_columns(df, text: str, token_map: Column, out: str):
    """Adds the sanitised text, step after step, so that no expression grows with the number of steps."""
    df = df.withColumn(out, F.col(text))
    for step in STEPS:
        df = df.withColumn(out, step(F.col(out), token_map) if step is replace_tokens else step(F.col(out)))
    return df
