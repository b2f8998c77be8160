"""Span sets (SPN-0 to SPN-3) and masking (MSK-1 to MSK-4), array to array within a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.regexlib import let, replace_with, running, spliced
from .detect import SPAN

TOKENS = "array<struct<token:string,value:string,start:int,end:int>>"


def union_layers(*layers: Column) -> Column:
    """SPN-0: layers in order."""
    return F.concat(*layers)


def dedupe_contained(found: Column) -> Column:
    """SPN-1: of each type, spans within an earlier kept one go; types in order of first emission.

    In order of start, then longest, a kept span holds the next iff the largest end so far
    reaches its end, so a running maximum stands for the kept list; the type counts above the end,
    so the maximum begins anew with each type.
    """

    def run(a: Column) -> Column:
        return let(F.array_distinct(F.transform(a, lambda s: s["entity_type"])), lambda types: ordered(a, types))

    def ordered(a: Column, types: Column) -> Column:
        keyed = F.transform(a, lambda s, i: F.struct(F.array_position(types, s["entity_type"]).alias("t"), s["start"].alias("b"), (s["start"] - s["end"]).alias("n"), i.alias("i"), s.alias("s")))
        return let(F.array_sort(keyed), kept)

    def kept(k: Column) -> Column:
        reach = F.transform(k, lambda x: F.shiftleft(x["t"].cast("bigint"), 32) + x["s"]["end"])
        marked = F.zip_with(k, F.zip_with(reach, running(reach, maximum=True), lambda r, m: r > m), lambda x, keep: F.struct(x["s"].alias("s"), keep.alias("keep")))
        return F.transform(F.filter(marked, lambda x: x["keep"]), lambda x: x["s"])

    return let(found, run).cast(SPAN)


def _widest_first(keyed: Column) -> Column:
    """The spans of structs that sort widest first, without those that overlap one before that stays."""
    return F.aggregate(
        F.array_sort(keyed),
        F.filter(keyed, lambda k: F.lit(False)),
        lambda stay, k: F.when(F.exists(stay, lambda o: (k["s"]["start"] < o["s"]["end"]) & (k["s"]["end"] > o["s"]["start"])), stay).otherwise(F.concat(stay, F.array(k))),
    )


def dedupe_overlapping(found: Column) -> Column:
    """SPN-2: widest first, then earliest; a span that overlaps a kept one goes.  The result is in that order.

    Only spans of one stretch without a gap can meet, so each stretch is decided for itself.
    """

    def run(a: Column) -> Column:
        keyed = F.transform(a, lambda s, i: F.struct((s["start"] - s["end"]).alias("n"), s["start"].alias("b"), i.alias("i"), s.alias("s")))
        return let(F.array_sort(keyed, lambda x, y: F.when(x["b"] < y["b"], -1).when(x["b"] > y["b"], 1).otherwise(0)), stretches)

    def stretches(k: Column) -> Column:
        reach = running(F.transform(k, lambda x: x["s"]["end"].cast("bigint")), maximum=True)
        # 1-based places at which a stretch begins
        begins = F.filter(F.zip_with(F.sequence(F.lit(1), F.size(k)), F.zip_with(k, reach, lambda x, m: x["b"] >= m), lambda i, new: F.when(new | (i == 1), i)), lambda i: i.isNotNull())
        return let(begins, lambda at: decided(k, at))

    def decided(k: Column, at: Column) -> Column:
        ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(k) + 1))
        parts = F.zip_with(at, ends, lambda s, e: F.slice(k, s, e - s))
        stay = F.flatten(F.transform(parts, lambda x: F.when(F.size(x) == 1, x).otherwise(_widest_first(x))))
        return F.transform(F.array_sort(stay), lambda x: x["s"])

    return let(found, lambda a: F.when(F.size(a) < 2, a).otherwise(run(a))).cast(SPAN)


def assign_tokens(kept: Column) -> Column:
    """MSK-1: from the end of the text, a counter for each type; the last span of a type is number 1."""

    def run(a: Column) -> Column:
        # by type, then from the end: a span's number is its distance from the first of its type
        return let(F.array_sort(F.transform(a, lambda s, i: F.struct(s["entity_type"].alias("t"), (-s["start"]).alias("b"), i.alias("i"), s.alias("s")))), numbered)

    def numbered(all_: Column) -> Column:
        firsts = let(F.transform(all_, lambda k: k["t"]), lambda t: F.transform(F.array_distinct(t), lambda x: F.struct(x, F.array_position(t, x))))
        return let(F.map_from_entries(firsts), lambda of: named(all_, of))

    def named(all_: Column, firsts: Column) -> Column:
        made = F.transform(
            all_,
            lambda k, i: F.struct(
                k["b"].alias("b"),
                k["i"].alias("i"),
                F.struct(
                    F.concat(F.lit("["), k["t"], F.lit("_"), (i + 2 - F.element_at(firsts, k["t"])).cast("string"), F.lit("]")).alias("token"),
                    k["s"]["text"].alias("value"), k["s"]["start"].alias("start"), k["s"]["end"].alias("end"),
                ).alias("x"),
            ),
        )
        return F.transform(F.array_sort(made), lambda x: x["x"])

    return let(kept, lambda a: F.when(F.size(a) == 0, F.array().cast(TOKENS)).otherwise(run(a).cast(TOKENS)))


def splice(text: Column, tokens: Column) -> Column:
    """MSK-2: the text with each span replaced by its token; tokens are in descending order of start."""

    def run(whole: Column, t: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(t, lambda x: x["end"]))
        parts = F.zip_with(t, F.slice(before, F.lit(1), F.size(t)), lambda x, at: F.struct(at.alias("at"), x["start"].alias("start"), x["token"].alias("put")))
        return spliced(whole, parts, F.element_at(t, -1)["end"])

    return let(F.struct(text.alias("text"), F.reverse(tokens).alias("tokens")), lambda x: F.when(F.size(x["tokens"]) == 0, x["text"]).otherwise(run(x["text"], x["tokens"])))


def restore(masked: Column, tokens: Column) -> Column:
    """MSK-4: tokens back to their values."""
    values = F.map_from_entries(F.transform(tokens, lambda t: F.struct(t["token"], t["value"])))
    return replace_with(masked, r"\[[A-Z_]+_\d+\]", lambda m: F.coalesce(F.try_element_at(values, m), m))
