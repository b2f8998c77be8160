"""DuckDB SQL of the whole detection chain over the made CVs: prepared text, spans of every layer with offsets, resolution, tokens, masking.

Patterns are those of the lexicons; what RE2 cannot say (a match that looks ahead or behind) is
written with a group for the reported text.  The made CVs are ASCII.
"""

from __future__ import annotations

from ..functions import lexicons as L
from ..functions.regexlib import alternation
from ..operators import normalise as N
from ..operators import sanitise as S
from .synthetic import CVS, MASKED


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def subs(column: str, steps: list[tuple[str, str]]) -> str:
    for p, to in steps:
        column = f"regexp_replace({column}, {q(p)}, {q(to)}, 'g')"
    return column


TRIM = "trim({}, ' ' || chr(9) || chr(10))"


def recognisers() -> list[tuple[str, str, str, float | None, int, str, str]]:
    """(type, layer, pattern, confidence, group of the span, reported text of v, condition on the reported text r), in order of emission."""
    names = "[" + ", ".join(map(q, [*L.FIRST_NAMES, *L.LAST_NAMES])) + "]"
    words = "[" + ", ".join(map(q, L.ORG_KEYWORDS)) + "]"
    out = [(t, "L1_pattern", "(?i)" + p, 0.99, 0, "v", "true") for t, ps in L.L1_PATTERNS.items() for p in ps]
    out.append(("LOCATION", "L2_ner", rf"\b{alternation([c for c in L.CITIES if c.isascii()])}\b".replace("\\-", "-"), None, 0, "v", "true"))
    out.append(("ADDRESS", "L2_ner", "(?i)" + L.ADDRESS, None, 0, TRIM.format("v"), "true"))
    out.append(("PERSON", "L2_ner", L.PERSON_NAME, None, 0, "v", f"len(list_filter(string_split_regex(lower(r), '[\\s-]'), lambda t: list_contains({names}, rtrim(t, '''')))) > 0"))
    out += [("ORG", "L2_ner", "(?i)" + L.ORG_BEFORE_SUFFIX + s, None, 0, TRIM.format("v"), "true") for s in L.ORG_SUFFIXES]
    out.append(("ORG", "L2_ner", L.TITLE_PHRASE, None, 0, "v", f"len(list_filter(string_split_regex(lower(r), '\\s+'), lambda t: list_contains({words}, rtrim(t, '.,')))) > 0 AND NOT contains(lower(r), 'rruga') AND NOT contains(lower(r), 'pall.') AND NOT contains(lower(r), 'pallati')"))
    for k in L.EDUCATION_KEYWORDS:
        p = L.EDUCATION.format(keyword=k)
        body, ahead = p[: p.index("(?=")], p[p.index("(?=") + 3 : -1]
        out.append(("ORG", "L2_ner", f"(?i)({body}){ahead}", None, 1, f"rtrim({TRIM.format('v')}, ',|—-')", "length(r) > 8"))
    for t, ps in L.PERSONAL_PATTERNS.items():
        for p in ps:
            line = p.startswith("(?<=")
            out.append((t, "L3_personal", "(?i)\\n(Male|Female|Mashkull|Femer)\\s*\\n" if line else "(?i)" + p, 0.99, 1 if line else 0, "v", "true"))
    return out


def candidates(source: str) -> str:
    """(cv_id, pat, k, entity_type, layer, confidence, text, b, e) of every pattern; source has cv_id and text."""
    parts = []
    for number, (kind, layer, p, confidence, group, value, keep) in enumerate(recognisers()):
        lead = "position(v IN w) - 1" if group else "0"
        lists = f"SELECT cv_id, regexp_extract_all(text, {q(p)}, 0) AS ws, regexp_extract_all(text, {q(p)}, {group}) AS vs, string_split_regex(text, {q(p)}) AS gs FROM {source}"
        each = f"SELECT cv_id, gs, ws, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS w, unnest(vs) AS v FROM ({lists})"
        at = "list_sum(list_transform(gs[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ws[1:k-1], lambda m: length(m))), 0)"
        score = "NULL" if confidence is None else confidence
        parts.append(
            f"SELECT cv_id, {number} AS pat, k, {q(kind)} AS entity_type, {q(layer)} AS layer, CAST({score} AS DOUBLE) AS confidence, r AS text, b, b + length(v) AS e "
            f"FROM (SELECT *, {value} AS r, CAST({at} + {lead} AS BIGINT) AS b FROM ({each})) WHERE {keep}"
        )
    return " UNION ALL ".join(parts)


def detections() -> str:
    """CTEs that end in ``prepared`` (cv_id, text) and ``found``: the resolved spans (cv_id, pos, entity_type, layer, confidence, text, b, e, token) and their tokens."""
    name = "[A-Z][a-zA-Z''\\-]+"
    prepared = subs("text", [(p, t.replace("$", "\\")) for p, t in N.PREPROCESS])
    return f"""
cvs AS ({CVS}), prepared AS (SELECT cv_id, {prepared} AS text FROM cvs),
c AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY pat, k) AS i FROM ({candidates("prepared")})),
t AS (SELECT *, first_value(i) OVER (PARTITION BY cv_id, entity_type ORDER BY i) AS tpos FROM c),
m AS (SELECT *, max(e) OVER (PARTITION BY cv_id, entity_type ORDER BY b, e DESC, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM t),
s1 AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY tpos, b, e DESC, i) AS pos FROM m WHERE reach IS NULL OR reach < e),
h AS (SELECT cv_id, string_split(text, chr(10))[1] AS line FROM prepared),
s2 AS (SELECT cv_id, pos, entity_type, layer, confidence, text, b, e FROM s1 UNION ALL
  SELECT cv_id, 1000000, 'PERSON', 'L0_header', NULL, line, 0, length(line) FROM h WHERE regexp_full_match(line, '{name}( {name}){{1,3}}')
  AND NOT EXISTS (SELECT 1 FROM s1 WHERE s1.cv_id = h.cv_id AND s1.b <= 0 AND s1.e >= length(h.line))),
o AS (SELECT *, row_number() OVER (PARTITION BY cv_id ORDER BY b - e, b, pos) AS r FROM s2),
g AS (SELECT cv_id, r, true AS kept, [{{'b': b, 'e': e}}] AS got FROM o WHERE r = 1 UNION ALL
  SELECT o.cv_id, o.r, len(list_filter(g.got, lambda x: o.b < x.e AND o.e > x.b)) = 0,
  CASE WHEN len(list_filter(g.got, lambda x: o.b < x.e AND o.e > x.b)) = 0 THEN list_append(g.got, {{'b': o.b, 'e': o.e}}) ELSE g.got END FROM g JOIN o ON o.cv_id = g.cv_id AND o.r = g.r + 1),
n AS (SELECT o.*, '[' || entity_type || '_' || row_number() OVER (PARTITION BY o.cv_id, entity_type ORDER BY b DESC, o.r) || ']' AS own, row_number() OVER (PARTITION BY o.cv_id ORDER BY b DESC, o.r) AS turn FROM o JOIN g ON o.cv_id = g.cv_id AND o.r = g.r AND g.kept),
found AS (SELECT *, first_value(own) OVER (PARTITION BY cv_id, text ORDER BY turn) AS token, coalesce(confidence, CASE layer WHEN 'L1_pattern' THEN 0.99 ELSE 0.75 END) AS score FROM n)
"""


def chain_sql() -> dict[str, str]:
    """By query of the catalog."""
    base = f"WITH RECURSIVE {detections()}"
    source = "'cvs/' || p.cv_id"
    people = "list(trim(text, ' ') ORDER BY r) FILTER (entity_type = '{}')"
    return {
        "detections_cvs": f"{base} SELECT CAST(cv_id AS VARCHAR) AS doc_key, entity_type, text, CAST(b AS INT) AS start, CAST(e AS INT) AS \"end\", layer, score AS confidence, token AS token_replacement FROM found",
        "counts_by_layer": f"{base} SELECT layer, count(*) AS n, count(*) FILTER (score < 0.85) AS n_low FROM found GROUP BY layer",
        "mask_cvs": f"""{base}, x AS (SELECT cv_id, turn, b, e, own, coalesce(lag(e) OVER (PARTITION BY cv_id ORDER BY b), 0) AS last FROM n),
y AS (SELECT x.cv_id, string_agg(substr(p.text, CAST(last + 1 AS BIGINT), CAST(b - last AS BIGINT)) || own, '' ORDER BY b) AS head, max(e) AS tail FROM x JOIN prepared p USING (cv_id) GROUP BY x.cv_id)
SELECT CAST(p.cv_id AS VARCHAR) AS doc_key, coalesce(head, '') || substr(p.text, CAST(coalesce(tail, 0) + 1 AS BIGINT)) AS anonymised_text FROM prepared p LEFT JOIN y USING (cv_id)""",
        "fingerprint_cvs": f"""{base}, x AS (SELECT cv_id, {people.format("PERSON")} AS names, {people.format("EMAIL")} AS emails, {people.format("PHONE")} AS phones, list(trim(text, ' ') ORDER BY r) FILTER (entity_type = 'URL' AND contains(lower(text), 'linkedin')) AS links FROM found GROUP BY cv_id),
d AS (SELECT cv_id, names, links, list_filter(emails, lambda m, i: list_position(emails, m) = i) AS emails, list_filter(phones, lambda m, i: list_position(phones, m) = i) AS phones FROM x)
SELECT CAST(p.cv_id AS VARCHAR) AS doc_key, sha256(CASE WHEN coalesce(len(emails), 0) + coalesce(len(phones), 0) = 0 THEN {source} ELSE coalesce(array_to_string(list_sort(list_transform(emails, lambda m: lower(m))), ''), '') || coalesce(array_to_string(list_sort(phones), ''), '') END) AS candidate_fingerprint,
regexp_replace(names[1], '\\s+', ' ', 'g') AS full_name, links[1] AS linkedin, coalesce(array_to_string(emails, ','), '') AS emails, coalesce(array_to_string(phones, ','), '') AS phones FROM prepared p LEFT JOIN d USING (cv_id)""",
        "summary_cvs": f"""{base}, w AS (SELECT cv_id, list_filter(string_split_regex(substr(text, 1, 2000), '\\s+'), lambda x: x <> '') AS ws, substr(text, 1, 2000) AS s FROM cvs),
f AS (SELECT cv_id, len(list_filter(ws, lambda x: regexp_full_match(x, '[A-Za-z]'))) / len(ws) > 0.08 OR len(regexp_extract_all(s, '\\d \\d')) / (length(s) - length(replace(s, chr(10), '')) + 1) > 4.0 AS damaged FROM w),
z AS (SELECT count(*) AS total, count(*) FILTER (score < 0.85) AS low FROM found)
SELECT '' AS batch_id, '1.0.0' AS pipeline_version, '00000000' AS config_hash, count(*) AS documents_total, count(*) AS documents_processed, CAST(0 AS BIGINT) AS documents_failed, CAST(1.0 AS DOUBLE) AS average_extraction_quality,
count(*) FILTER (damaged) AS ocr_damaged_count, CAST((SELECT low FROM z) AS BIGINT) AS low_confidence_review_required, CAST((SELECT total FROM z) AS BIGINT) AS total_pii_detected FROM f""",
        "sanitise_all": sanitised_sql(),
        "sanitise_org_by_section": section_sql(),
        "detect_education": f"WITH cvs AS ({CVS}) SELECT cv_id, entity_type, text FROM ({candidates('cvs')}) WHERE pat BETWEEN {_education()[0]} AND {_education()[1]}",
    }


def recall_sql() -> str:
    """Truth of the made CVs against the spans of the e-mail and city patterns: contained either way, or 70 of 100 words of the expected item contained."""
    return f"""
WITH cvs AS ({CVS}), found AS (SELECT cv_id, entity_type, lower(trim(text, ' ' || chr(10))) AS f FROM ({candidates("cvs")}) WHERE entity_type IN ('EMAIL', 'LOCATION')),
truth AS (SELECT c_custkey AS cv_id, 'EMAIL' AS category, 'user' || c_custkey || '@mail' || c_custkey % 10 || '.com' AS expected FROM customer
  UNION ALL SELECT c_custkey, 'LOCATION', CASE c_custkey % 3 WHEN 0 THEN 'Durres' WHEN 1 THEN 'Oslo' ELSE 'Shkoder' END FROM customer),
t AS (SELECT *, lower(expected) AS x, list_filter(string_split_regex(lower(expected), '\\W+'), lambda w: w <> '') AS ws FROM truth),
j AS (SELECT t.category, t.cv_id, bool_or(f IS NOT NULL AND (contains(f, x) OR contains(x, f) OR len(list_filter(ws, lambda w: contains(f, w))) >= 0.7 * len(ws))) AS hit FROM t LEFT JOIN found ON found.cv_id = t.cv_id AND found.entity_type = t.category GROUP BY t.category, t.cv_id)
SELECT category, count(*) AS expected_items, count(*) FILTER (hit) AS found_items, round(count(*) FILTER (hit) / count(*), 4) AS recall FROM j GROUP BY GROUPING SETS ((category), ())
"""


def _steps(column: str, steps: list[tuple[str, str, str]]) -> str:
    """Successive rewrites (flags, pattern, replacement with $ groups)."""
    return subs(column, [(f"(?{flags})" + p if flags else p, to.replace("$", "\\")) for flags, p, to in steps])


def _section(text: str) -> str:
    """The header line of a text that has one, lower case."""
    return f"lower(regexp_extract({text}, {q('(?im)^[ ' + chr(92) + 't]*(' + L.SECTION_HEADER + ')[ ' + chr(92) + 't]*$')}, 1))"


def _label() -> str:
    """The kind of organisation below a header h."""
    education, courses = (", ".join(map(q, words)) for words in (L.EDUCATION_SECTIONS, L.TRAINING_SECTIONS))
    return f"CASE WHEN h IN ({education}) THEN '[UNIVERSITY]' WHEN h IN ({courses}) THEN '[TRAINING_PROVIDER]' ELSE '[COMPANY]' END"


def section_sql() -> str:
    return f"WITH m AS ({MASKED}), t AS (SELECT cv_id, {_section('text')} AS h FROM m) SELECT cv_id, {_label()} AS label FROM t"


def sanitised_sql() -> str:
    """The sanitiser over the made masked texts: an organisation's label follows from the header line before it."""
    labels = subs("text", [("(?i)" + p, "") for p in L.FIELD_LABELS])
    repaired = labels
    for old, new in sorted(L.SUFFIX_REPAIR.items(), key=lambda x: -len(x[0])):
        repaired = f"regexp_replace({repaired}, {q(S.TOKEN + old + '([^a-z]|$)')}, {q(new + chr(92) + '1')}, 'g')"
    tokens = subs("a", [(rf"\[(?:{'|'.join(L.REMOVED_TYPES)})_\d+\]", ""), (r"\[URL_\d+\]", "[URL]"), (r"\[LOCATION_\d+\]", "[LOCATION]")])
    after = [
        ("", S.LABEL + r"red([^a-z0-9]|$)", "shared$1"), ("", S.LABEL + r"([a-z][a-z0-9]*)", "$1"),
        ("m", r"\bAddress\s+([A-Z0-9\[][^\n]{5,})", "Address [ADDRESS_REDACTED]"), ("m", S.BARE_ADDRESS, ""),
        ("", rf"\b{alternation(L.PLACES)}\b", "[LOCATION]"), ("i", rf"\b{alternation(L.EMPLOYERS, longest_first=False)}\b", "[COMPANY]"),
        ("", S.TITLED_PERSON.replace(r"[^\S\n]", "[ \\t]"), "[PERSON]"), *(("i", rf"\b{alternation([n])}\b", "[PERSON]") for n in L.PERSONS),
        ("i", rf"\b{alternation(L.TRAINING_PLATFORMS)}\b", "[TRAINING_PROVIDER]"), ("i", S.HIGH_SCHOOL, "[UNIVERSITY]"), ("", S.QUOTED_LABEL, "$1"),
        ("im", *S.MASTERS), ("im", *S.BACHELOR), ("", r"—\s*-\s*", "— "), ("i", r"\s*-\s*PROFILE:\s*", ", "), ("m", *S.DATE_LINE), ("m", *S.DATE_UNIVERSITY_LINE),
        ("i", *S.INSTITUTION), ("i", *S.GRADUATED), ("i", *S.OWN_LINE), *(("m", *c) for c in S.CLEANUP),
    ]
    return f"""
WITH m AS ({MASKED}), r AS (SELECT cv_id, {repaired} AS a FROM m),
t AS (SELECT cv_id, {tokens} AS b, {_section("a")} AS h FROM r),
o AS (SELECT cv_id, regexp_replace(b, '\\[ORG_\\d+\\]', {_label()}, 'g') AS c FROM t)
SELECT cv_id, {_steps("c", after)} AS sanitised FROM o
"""


def _education() -> tuple[int, int]:
    """Numbers of the first and the last education pattern."""
    numbers = [k for k, r in enumerate(recognisers()) if r[4] == 1 and r[1] == "L2_ner"]
    return numbers[0], numbers[-1]
