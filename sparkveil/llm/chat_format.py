"""Chat formatting by schema fingerprints, with SQL functions only.

A record of any layout is read as a variant.  The nested field paths it has, out of the paths
that layouts know, are hashed; the hash selects a declarative mapping (``LAYOUTS``) to
canonical turns (role, text).  Records whose paths match no layout have no turns and keep
their fingerprint, so that they can be counted.  Fields that no layout knows don't matter.

The template writes a turn as ``<|im_start|>role<|im_sep|>text<|im_end|>``.  Inside roles and
texts a backslash is doubled and every control string gets one after its first character, so
none is left; taking each backslash before a character away restores them.

Defined cases: null text or role is empty; turns of equal number are ordered by role, then
text, and repeated rows are turns of their own; a null conversation key is a conversation; a
conversation without an assistant has an empty loss mask; other columns are ignored.
A conversation is one row of the result, so its turns meet in one task; turn offsets are sums
over a window that spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that must never reach a tokenizer from inside a text.
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

#: layout -> the paths that make it, and its turns: either each element of an array (path, role
#: field, text field), or fixed roles with paths (a path that is absent gives no turn).
LAYOUTS = {
    "turn rows": {"paths": ["$.role", "$.text"], "turns": [("$.role", "$.text")]},
    "content rows": {"paths": ["$.content", "$.role"], "turns": [("$.role", "$.content")]},
    "messages": {"paths": ["$.messages[0].content", "$.messages[0].role"], "each": ("$.messages", "role", "content")},
    "from-value": {"paths": ["$.conversations[0].from", "$.conversations[0].value"], "each": ("$.conversations", "from", "value")},
    "instruction": {"paths": ["$.instruction", "$.output"], "turns": [("user", "$.instruction"), ("assistant", "$.output")]},
    "instruction with input": {"paths": ["$.input", "$.instruction", "$.output"], "turns": [("user", "$.instruction\n$.input"), ("assistant", "$.output")]},
    "prompt-response": {"paths": ["$.prompt", "$.response"], "turns": [("user", "$.prompt"), ("assistant", "$.response")]},
    "prompt-completion": {"paths": ["$.completion", "$.prompt"], "turns": [("user", "$.prompt"), ("assistant", "$.completion")]},
    "system prompt-response": {"paths": ["$.prompt", "$.response", "$.system"], "turns": [("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response")]},
    "question-answer": {"paths": ["$.answer", "$.question"], "turns": [("user", "$.question"), ("assistant", "$.answer")]},
}
KNOWN_PATHS = sorted({p for layout in LAYOUTS.values() for p in layout["paths"]})
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


def fingerprint_of(paths: list[str]) -> int:
    h = xxh64_intdigest("\n".join(sorted(paths)), 42)
    return h - (1 << 64) if h >= 1 << 63 else h


def fingerprint(record: Column) -> Column:
    """Hash of the known paths a record has; a field with a null value is there."""
    present = [F.when(F.try_variant_get(record, p, "variant").isNotNull(), F.lit(p)) for p in KNOWN_PATHS]
    return F.xxhash64(F.array_join(F.array_compact(F.array(*present)), "\n"))


def _text(record: Column, path: str) -> Column:
    parts = [F.coalesce(F.try_variant_get(record, p, "string"), F.lit("")) for p in path.split("\n")]
    return parts[0] if len(parts) == 1 else F.concat(parts[0], F.when(parts[1] != "", F.concat(F.lit("\n"), parts[1])).otherwise(""))


def _named(role: str, text: str):
    """Turns of array elements, roles under their common names."""
    names = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
    return lambda m: F.struct(F.coalesce(F.try_element_at(names, m[role]), m[role], F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))


def canonical_turns(record: Column, print_: Column) -> Column:
    """The turns of a record by the mapping that its fingerprint selects; null if none does."""
    out = F.lit(None).cast(TURNS)
    for layout in LAYOUTS.values():
        if "each" in layout:
            path, role, text = layout["each"]
            got = F.try_variant_get(record, path, f"array<struct<`{role}`:string,`{text}`:string>>")
            turns = F.transform(got, _named(role, text))
        else:
            turns = F.array(*(F.struct((_text(record, r) if r.startswith("$") else F.lit(r)).alias("role"), _text(record, p).alias("text")) for r, p in layout["turns"]))
        out = F.when(print_ == fingerprint_of(layout["paths"]), turns.cast(TURNS)).otherwise(out)
    return out


def turns_of(records: DataFrame, key: str, order: str | None = None, record: Column | None = None) -> DataFrame:
    """(key, ord, sub, role, text, fingerprint): records of any layout, typed or variant, as turns.

    Without ``record`` the columns of the frame that layouts know are the record.
    """
    if record is None:
        known = {p.removeprefix("$.").split("[")[0].split(".")[0] for p in KNOWN_PATHS}
        record = F.to_variant_object(F.struct(*(F.col(c) for c in records.columns if c in known)))
    rows = records.select(F.col(key).alias("key"), (F.col(order) if order else F.lit(0)).cast("long").alias("ord"), record.alias("record")).withColumn("fingerprint", fingerprint(F.col("record")))
    return rows.select("key", "ord", "fingerprint", F.posexplode(canonical_turns(F.col("record"), F.col("fingerprint")))).select("key", "ord", F.col("pos").alias("sub"), "col.role", "col.text", "fingerprint")


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in "\\|[]()<>/.*+?^${}" else c for c in s)


def escape(text: Column) -> Column:
    ahead = "|".join(_quoted(c[1:]) for c in CONTROL)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), rf"([<\[])(?={ahead})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """(key, formatted, loss_spans): the formatted conversation and the code points under its loss mask (each text of an assistant)."""
    head = F.concat(F.lit(START), escape("role"), F.lit(SEP))
    parts = turns.select("key", "ord", "sub", "role", "text", head.alias("head"), escape("text").alias("body"))
    order = Window.partitionBy("key").orderBy("ord", "sub", "role", "text")
    size = F.length("head") + F.length("body") + F.lit(len(END))
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select("key", F.row_number().over(order).alias("n"), F.concat("head", "body", F.lit(END)).alias("part"), (F.col("role") == "assistant").alias("loss"), (before + F.length("head")).cast("int").alias("start"), (before + F.length("head") + F.length("body")).cast("int").alias("end"))
    rows = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "part", "loss", "start", "end"))).alias("parts"))
    return rows.select(
        "key",
        F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"),
        F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Turns of a formatted conversation, unescaped."""
    parts = F.slice(F.split(formatted, _quoted(START), -1), 2, F.greatest(F.size(F.split(formatted, _quoted(START), -1)) - 1, F.lit(0)))
    return F.transform(parts, lambda p: F.struct(unescape(F.substring_index(p, SEP, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, SEP, -1), END, 1)).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


SPECIAL = "</s>[INST] ok [/INST]"


def formatted_digest(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    spark = conversations.sparkSession
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SPECIAL).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(extra)
    made = format_turns(turns_of(rows, "conv_id", "turn"))
    read = made.select("key", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("key").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ADDED = " + ".join(["length({0}) - length(replace({0}, chr(92), ''))", *(f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in CONTROL)])
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SPECIAL}' UNION ALL SELECT -7, 1, 'assistant', '{SPECIAL}'
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START + SEP + END)} + length(role) + length(text) + {_ADDED.format("role")} + {_ADDED.format("text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
