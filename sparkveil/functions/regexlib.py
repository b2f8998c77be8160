"""Regular expressions with offsets, as column expressions.

``spans`` gives matches with code-point offsets, ``replace_with`` rewrites each match by an
expression; both combine the matches with the texts between them, so no Python runs.  Patterns
are Java's; ``pattern()`` adds the flags under which they agree with Unicode-aware matching and
a ``$`` that knows only line feeds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = "array<struct<text:string,start:int,end:int>>"


def pattern(p: str, ignore_case: bool = False, multiline: bool = False) -> str:
    return f"(?Ud{'i' if ignore_case else ''}{'m' if multiline else ''}){p}"


def literal(s: str) -> str:
    """A string as a pattern that matches itself."""
    return "".join("\\" + c if c in "\\|[]()<>/.*+?^${}-&" else c for c in s)


def alternation(words, longest_first: bool = True) -> str:
    ordered = sorted(words, key=lambda w: (-len(w), w)) if longest_first else list(words)
    return "(?:" + "|".join(map(literal, ordered)) + ")"


#: Entries of an array that are folded together; a fold copies what it has gathered at each step.
BLOCK = 64
#: Parts of a text up to which the places of its matches are summed one by one, without the blocks of a longer fold.
FEW = 33


def running_sql(numbers: str, op: str, first: str) -> str:
    """For each entry of an array of bigint, op (over x and y) of the entries before it, from first on: in blocks, so the work grows with the array."""
    kind = "cast(array() as array<bigint>)"
    fold = "aggregate({of}, named_struct('x', {start}, 'got', " + kind + "), (s, y) -> named_struct('x', {op}, 'got', concat(s.got, array(s.x))))"
    step = op.replace("x", "s.x")
    within = fold.format(of="p.b", start="p.f", op=step) + ".got"
    blocks = f"transform(sequence(0, (size(n) - 1) div {BLOCK}), k -> slice(n, k * {BLOCK} + 1, {BLOCK}))"
    whole = f"transform(bs, b -> aggregate(b, cast({first} as bigint), (x, y) -> {op}))"
    starts = fold.format(of=whole, start=f"cast({first} as bigint)", op=step) + ".got"
    body = f"flatten(transform(array({blocks}), bs -> flatten(transform(zip_with(bs, {starts}, (b, f) -> named_struct('b', b, 'f', f)), p -> {within}))))"
    return f"flatten(transform(array({numbers}), n -> if(size(n) = 0, {kind}, {body})))"


def running(numbers: Column, maximum: bool = False) -> Column:
    """For each entry of an array of whole numbers the sum, or the maximum (0 at least), of the entries before it."""
    return let(numbers.cast("array<bigint>"), lambda n: _running(n, maximum))


def _running(n: Column, maximum: bool) -> Column:
    def op(x: Column, y: Column) -> Column:
        return F.greatest(x, y) if maximum else x + y

    none, zero = F.array().cast("array<bigint>"), F.lit(0).cast("bigint")

    def fold(numbers: Column, start: Column) -> Column:
        return F.aggregate(numbers, F.struct(start.alias("x"), none.alias("got")), lambda s, y: F.struct(op(s["x"], y).alias("x"), F.concat(s["got"], F.array(s["x"])).alias("got")))["got"]

    def joined(blocks: Column) -> Column:
        starts = fold(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), zero)
        return F.flatten(F.zip_with(blocks, starts, fold))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")), lambda k: F.slice(n, k * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(n) == 0, none).when(F.size(n) <= BLOCK, fold(n, zero)).otherwise(let(blocks, joined))


def spliced(text: Column, parts: Column, tail: Column) -> Column:
    """The stretches of a text before each part (struct<at, start, put>, in order: from ``at`` to ``start``), each followed by the part's ``put``, then the text from ``tail`` on.

    A stretch is found by counting from a text's start, so each block of parts cuts a text of its own.
    """

    def block(whole: Column, b: Column) -> Column:
        at, end = b[0]["at"], F.element_at(b, -1)["start"]
        own = F.substr(whole, at + 1, end - at)
        return let(own, lambda t: F.array_join(F.transform(b, lambda x: F.concat(F.substr(t, x["at"] - at + 1, x["start"] - x["at"]), x["put"])), ""))

    def joined(whole: Column, p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda k: let(F.slice(p, k * BLOCK + 1, F.lit(BLOCK)), lambda b: block(whole, b)))
        return F.when(F.size(p) == 0, "").otherwise(F.array_join(blocks, ""))

    return let(text, lambda whole: F.concat(let(parts, lambda p: joined(whole, p)), F.substr(whole, tail + 1)))


def strip(col: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Signs that fold to ASCII letters when case is ignored; a text that has one passes every gate.
ODD_CASE = "[\u017f\u212a\u0131]|i\u0307"


def holds(text: Column, words: list[str] = (), regex: str | None = None) -> Column:
    """A cheap test that a text must pass before an expensive pattern is tried: any of some lower-case strings, or a plain pattern, in its lower case."""

    def tested(low: Column) -> Column:
        return reduce(lambda a, b: a | b, [*(low.contains(w) for w in words), *([low.rlike(regex)] if regex else []), low.rlike(ODD_CASE)])

    return let(F.lower(text), tested)


def quoted(s: str) -> str:
    """A string as a SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def ascii_sql(text: str) -> str:
    """Whether a text has ASCII signs only."""
    return f"length({text}) = octet_length({text})"


def tests_sql(words: list[str] = (), regex: str | None = None) -> str:
    """The test of ``holds`` as SQL over a lower-case text ``l``; ``odd`` says whether it has a sign of ODD_CASE."""
    return " or ".join([f"contains(l, {quoted(w)})" for w in words] + ([f"l rlike {quoted(regex)}"] if regex else []) + ["odd"])


def holds_sql(text: str, words: list[str] = (), regex: str | None = None) -> str:
    """``holds`` as SQL over a column."""
    return f"exists(array(lower({text})), l -> exists(array(not ({ascii_sql('l')}) and l rlike {quoted(ODD_CASE)}), odd -> {tests_sql(words, regex)}))"


#: A sign that is no character; it parts matches from the texts between them.
MARK = "\ufdd0"


def parts_sql(text: str, p: str) -> str:
    """A text cut before and after each match of a pattern, so that every second part is a match.

    One search marks the matches; a text that has the mark is searched twice.  The pattern is a literal, so it is compiled once.
    """
    marked = f"split(regexp_replace({text}, {quoted(p)}, '{MARK}$0{MARK}'), '{MARK}', -1)"
    searched = f"flatten(zip_with(split({text}, {quoted(p)}, -1), regexp_extract_all({text}, {quoted(p)}, 0), (g, m) -> if(m is null, array(g), array(g, m))))"
    return f"if(contains({text}, '{MARK}'), {searched}, {marked})"


def spans_sql(text: str, rows: list[tuple[str, str, str]], made: str, kind: str, value: str = "v", keep: str = "true") -> str:
    """``spans`` of many patterns, pattern after pattern, as SQL over a column; rows are (pattern, type, cheap test that a text with a match passes).

    made is the struct of a span (of array type kind) by its type ``z.t`` and, to be put in, its text ``{r}``,
    ``{b}`` and ``{e}``; value maps a match ``v`` to the reported text ``r``, keep filters by ``r``.
    A plan is quicker to build as text than operation by operation.
    """
    if value == "v" and keep == "true":  # the plain case needs no lambda beside the span's own
        values, r = "{placed}", "y.m"
    else:
        values, r = f"filter(transform({{placed}}, y -> named_struct('m', y.m, 'at', y.at, 'r', transform(array(y.m), v -> {value})[0])), y -> exists(array(y.r), r -> {keep}))", "y.r"
    span = made.format(r=r, b="cast(y.at as int)", e="cast(y.at as int) + length(y.m)")
    cut = [f"named_struct('t', '{t}', 's', if({test}, {parts_sql(text, p)}, cast(array() as array<string>)))" for p, t, test in rows]
    table = f"filter(array({', '.join(cut)}), z -> size(z.s) > 1)"
    few = "transform(sequence(1, size(z.s) div 2), k -> named_struct('m', z.s[2 * k - 1], 'at', aggregate(slice(n, 1, 2 * k - 1), 0L, (x, y) -> x + y)))"
    many = f"filter(transform(zip_with(z.s, {running_sql('n', 'x + y', '0')}, (q, at) -> named_struct('m', q, 'at', at)), (q, i) -> if(i % 2 = 1, q, null)), q -> q is not null)"
    placed = f"flatten(transform(array(transform(z.s, q -> cast(length(q) as bigint))), n -> if(size(n) <= {FEW}, {few}, {many})))"
    return f"flatten(transform({table}, z -> cast(transform({values.replace('{placed}', placed)}, y -> {span}) as {kind})))"


def gated(text: Column, gate: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """A rewrite of texts that pass a cheap test; the text is evaluated once, so rewrites may be nested."""
    return let(text, lambda t: F.when(gate(t), value(t)).otherwise(t))


def spans(text: Column, p: str, keep: Callable[[Column], Column] | None = None, value: Callable[[Column], Column] | None = None, gate: Column | None = None) -> Column:
    """array<struct<text, start, end>> of the matches of a pattern, offsets in code points, the end exclusive.

    value maps a match to the reported text (the span stays that of the match); keep filters by
    it; gate is a cheaper test that every text with a match passes.
    """
    value = value or (lambda m: m)
    none = F.array().cast(MATCH)

    def one(y: Column) -> Column:
        start = (y["at"] + F.length(y["g"])).cast("int")
        return F.struct(value(y["m"]).alias("text"), start.alias("start"), (start + F.length(y["m"])).alias("end"))

    def placed(y: Column) -> Column:
        at = running(F.transform(y, lambda q: F.length(q["m"]) + F.length(q["g"])))
        got = F.transform(F.zip_with(y, at, lambda q, n: F.struct(q["m"].alias("m"), q["g"].alias("g"), n.alias("at"))), one)
        return got if keep is None else F.filter(got, lambda x: keep(x["text"]))

    def located(m: Column) -> Column:
        # the texts between matches give the offsets; they are cut only where there are matches
        pairs = F.zip_with(m, F.slice(F.split(text, p, -1), 1, F.size(m)), lambda a, g: F.struct(a.alias("m"), g.alias("g")))
        return F.when(F.size(m) == 0, none).otherwise(let(pairs, placed).cast(MATCH))

    found = let(F.regexp_extract_all(text, F.lit(p), F.lit(0)), located)
    return found if gate is None else F.when(gate, found).otherwise(none)


def replace_with(text: Column, p: str, fn: Callable[[Column], Column]) -> Column:
    """The text with each match of a pattern rewritten by an expression."""

    def joined(x: Column) -> Column:
        return F.array_join(F.flatten(F.zip_with(x["g"], F.transform(x["m"], fn), lambda s, m: F.array(s, F.coalesce(m, F.lit(""))))), "")

    def rewritten(t: Column) -> Column:
        both = F.struct(F.regexp_extract_all(t, F.lit(p), F.lit(0)).alias("m"), F.split(t, p, -1).alias("g"))
        return F.when(t.rlike(p), let(both, joined)).otherwise(t)

    return let(text, rewritten)


def exploded(rows: DataFrame, array: Column | str, name: str, *columns: str) -> DataFrame:
    """Some columns with a row for each entry of an array; entries are never null.

    From a plain explode Spark infers a filter on the array and pushes it towards the source, with all that
    the array is made of: detection would run again, and before the table is spread over the cores.
    """
    return rows.select(*columns, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
