"""Detection (DET-1 to DET-18): a text column to arrays of spans, SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Options
from ..functions import lexicons as L
from ..functions.regexlib import ODD_CASE, alternation, ascii_sql, holds_sql, pattern, quoted, spans_sql, strip, tests_sql

SPAN = "array<struct<entity_type:string,text:string,start:int,end:int,layer:string,confidence:double>>"


STRIP = r"regexp_replace(v, '(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+\\z', '')"


def name_of(text: Column | str) -> str:
    """The name of a text column."""
    return text if isinstance(text, str) else text._jc.toString()


def _made(layer: str, confidence: float | None) -> str:
    score = "cast(null as double)" if confidence is None else f"cast({confidence} as double)"
    return f"named_struct('entity_type', z.t, 'text', {{r}}, 'start', {{b}}, 'end', {{e}}, 'layer', '{layer}', 'confidence', {score})"


def found(text: Column | str, p: str, entity_type: str, layer: str, confidence: float | None, gate: str = "true", **more) -> Column:
    """Matches of a pattern as spans of a type and layer."""
    return F.expr(spans_sql(name_of(text), [(p, entity_type, gate)], _made(layer, confidence), SPAN, **more))


def found_by(text: Column | str, rows: list[tuple[str, str, str]], layer: str, confidence: float | None, **more) -> Column:
    """Spans of many patterns, pattern after pattern, by a table of (pattern, type, cheap test of the lower-case text l).

    The plan holds the places of matches once, whatever the number of patterns, and the lower case is made once.
    """
    spans = spans_sql(name_of(text), rows, _made(layer, confidence), SPAN, **more)
    odd = f"not ({ascii_sql('l')}) and l rlike {quoted(ODD_CASE)}"
    return F.expr(f"flatten(transform(array(lower({name_of(text)})), l -> flatten(transform(array({odd}), odd -> {spans}))))")


def words_sql(words: list[str], ends: str, between: str = "") -> str:
    """Whether a lower-case text ``w`` has one of some words, which signs of ``ends`` may follow, between white space or signs of ``between``."""
    sign = rf"[^\s\x1c-\x1f{between}]"
    first = "".join(sorted({w[0] for w in words}))
    return f"w rlike {quoted(rf'(?U)(?=[{first}])(?<!{sign}){alternation(words)}{ends}*(?!{sign})')}"


def by_patterns(text: Column, patterns: dict[str, list[str]], layer: str, types=None) -> list[Column]:
    """The spans of all patterns, in order."""
    quick = r"(?=\d)"  # a word bound costs more than a look at the sign that must follow
    rows = [(pattern(quick * p.startswith(r"\b\d") + p, ignore_case=True), t, tests_sql(*gate)) for t, ps in patterns.items() if types is None or t in types for p, gate in zip(ps, L.GATES[t], strict=True)]
    return [found_by(text, rows, layer, 0.99)]


def l1(text: Column, options: Options = Options(), types=None) -> list[Column]:
    """DET-1 to DET-7."""
    patterns = L.L1_PATTERNS | ({"IBAN": [L.STRICT_IBAN]} if options.strict_iban else {})
    return by_patterns(text, patterns, "L1_pattern", types)


def personal(text: Column, types=None) -> list[Column]:
    """DET-14 to DET-17."""
    return by_patterns(text, L.PERSONAL_PATTERNS, "L3_personal", types)


def locations(text: Column) -> Column:
    """DET-8."""
    first = "[" + "".join(sorted({c[0] for c in L.CITIES})) + "]"
    return found(text, pattern(rf"(?={first})\b{alternation(L.CITIES)}\b"), "LOCATION", "L2_ner", None)


def addresses(text: Column) -> Column:
    """DET-9: the reported value is stripped, the span is the match."""
    return found(text, pattern(L.ADDRESS, ignore_case=True), "ADDRESS", "L2_ner", None, value=STRIP, gate=holds_sql(name_of(text), [], r"rr(?:uga|\.)?[\s\P{ASCII}]"))


def persons(text: Column) -> Column:
    """DET-10: title-case names one of whose tokens is a known first or last name."""
    named = words_sql([*L.FIRST_NAMES, *L.LAST_NAMES], "'", r"\-")
    gate = f"{name_of(text)} rlike " + quoted(r"(?U)[a-zçëä']\s+[A-ZÇËÄ][a-zçëä']")
    return found(text, pattern(r"(?=[A-ZÇËÄ])" + L.PERSON_NAME), "PERSON", "L2_ner", None, keep=f"exists(array(lower(r)), w -> {named})", gate=gate)


def organisations_by_suffix(text: Column, options: Options = Options()) -> list[Column]:
    """DET-11; a suffix may end inside a word unless ``strict_suffix`` asks for its end."""
    end = r"(?!\w)" if options.strict_suffix else ""
    rows = [(pattern(L.ORG_BEFORE_SUFFIX + s + end, ignore_case=True), "ORG", tests_sql([], rf"[\s\x1c-\x1f\P{{ASCII}}]{s.lower()}")) for s in L.ORG_SUFFIXES]
    return [found_by(text, rows, "L2_ner", None, value=STRIP)]


def organisations_by_keyword(text: Column) -> Column:
    """DET-12."""
    address = " or ".join(f"contains(w, {quoted(w)})" for w in L.ADDRESS_WORDS)
    first = "".join(sorted({w[0] for w in L.ORG_KEYWORDS}))
    gate = holds_sql(name_of(text), [], rf"(?=[{first}])(?<![a-z]){alternation(L.ORG_KEYWORDS)}(?![a-z])")
    return found(text, pattern("(?=[A-Z])" + L.TITLE_PHRASE), "ORG", "L2_ner", None, keep=f"exists(array(lower(r)), w -> {words_sql(L.ORG_KEYWORDS, '[.,]')} and not ({address}))", gate=gate)


def education(text: Column) -> list[Column]:
    """DET-13: values over eight signs, right-trimmed of separators."""
    value = f"regexp_replace({STRIP}, {quoted('[,|—-]+$')}, '')"
    rows = [(pattern(L.EDUCATION.format(keyword=k), ignore_case=True), "ORG", tests_sql([k])) for k in L.EDUCATION_KEYWORDS]
    return [found_by(text, rows, "L2_ner", None, value=value, keep="length(r) > 8")]


def heuristic(text: Column, options: Options = Options()) -> list[Column]:
    """DET-8 to DET-13 in order of emission."""
    return [locations(text), addresses(text), persons(text), *organisations_by_suffix(text, options), organisations_by_keyword(text), *education(text)]


def header_name(text: Column, existing: Column) -> Column:
    """DET-18: the first line with a sign, if it reads as a name and no span holds it."""
    head = F.regexp_extract(text, r"(?Ud)\A([\s\x1c-\x1f]*)", 1)
    rest = F.substr(text, F.length(head) + 1)
    line = strip(F.regexp_extract(rest, r"\A([^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*)", 1))
    tokens = F.split(line, r"(?U)[\s\x1c-\x1f]+")
    # The name is looked for from the start of the text, so an earlier equal string would win; none can be before the first sign.
    start, end = F.length(head), F.length(head) + F.length(line)
    ok = (line != "") & F.size(tokens).between(2, 4) & F.forall(tokens, lambda t: t.rlike(L.HEADER_TOKEN)) & ~F.exists(existing, lambda s: (s["start"] <= start) & (s["end"] >= end))
    span = F.array(F.struct(F.lit("PERSON").alias("entity_type"), line.alias("text"), start.alias("start"), end.alias("end"), F.lit("L0_header").alias("layer"), F.lit(None).cast("double").alias("confidence")))
    return F.when(ok, span.cast(SPAN)).otherwise(F.array().cast(SPAN))
