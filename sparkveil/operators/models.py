"""Model layers (DET-19 to DET-24): the only Python boundaries of detection, each behind a small protocol."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.regexlib import let
from ..session import attach
from .detect import SPAN
from .resolve import TOKENS

# Size of a chunk, and what chunks share, in signs.
CHUNK, OVERLAP = 1000, 150


class Predictor(Protocol):
    def predict_entities(self, text: str, labels: list[str], threshold: float) -> list[dict]:
        """Entities with text, label, start, end and score."""


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[str, int]]:
    """DET-20: pieces that end at the last line feed of their second half, where there is one."""
    at = 0
    while at < len(text):
        end = at + size
        if end >= len(text):
            yield text[at:], at
            return
        feed = text.rfind("\n", at + size // 2, end)
        end = end if feed < 0 else feed + 1
        yield text[at:end], at
        at = end - overlap


def model_spans(text: str, model: Predictor, labels: list[str], threshold: float) -> list[dict]:
    """DET-19: spans of a text, once each; those over a line's end are dropped."""
    parts = [(text, 0)] if len(text) <= CHUNK else chunks(text)
    seen: dict[tuple, dict] = {}
    for part, offset in parts:
        for e in model.predict_entities(part, labels, threshold=threshold):
            if "\n" not in e["text"]:
                kind = L.MODEL_LABELS.get(e["label"].lower(), e["label"].upper())
                span = {"entity_type": kind, "text": e["text"], "start": e["start"] + offset, "end": e["end"] + offset, "layer": "L2_gliner", "confidence": float(e["score"])}
                if len(text) <= CHUNK:
                    seen[len(seen),] = span
                else:
                    seen.setdefault((span["text"], span["start"], span["end"]), span)
    return list(seen.values())


def model_path(explicit: str | None, model_id: str) -> str:
    """DET-22: a folder given, or named by the environment, if it holds a model; else the hub's name."""
    for p in (explicit, os.getenv("GLINER_MODEL_PATH")):
        if p:
            has = any((Path(p) / name).exists() for name in ("config.json", "gliner_config.json"))
            return p if has else model_id
    return model_id


_LOADED: dict[str, object] = {}


def hub_model(name: str) -> Callable[[], Predictor | None]:
    """A loader that keeps one model in each worker; none where the library or model is missing."""

    def load() -> Predictor | None:
        if name not in _LOADED:
            try:
                from gliner import GLiNER

                _LOADED[name] = GLiNER.from_pretrained(name)
            except Exception:
                _LOADED[name] = None
        return _LOADED[name]

    return load


def with_model_spans(df: DataFrame, text: str, load: Callable[[], Predictor | None], labels: list[str] | None = None, threshold: float = 0.5, out: str = "model_spans") -> DataFrame:
    """Adds a model's spans; without a model they are empty (the heuristic layer still runs)."""
    attach(df.sparkSession)
    labels = labels or sorted(L.MODEL_LABELS)
    span = pa.struct([("entity_type", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.string()), ("confidence", pa.float64())])
    schema = df.withColumn(out, F.array().cast(SPAN)).schema
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            found = [model_spans(t or "", model, labels, threshold) if model else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(span))], schema=pa.schema([*batch.schema, pa.field(out, pa.list_(span))]))

    return df.mapInArrow(run, schema)


# What the verifying model is asked and the confidence of its answers.
PROMPT = (
    "Find personal data that is left in the text. Tokens such as [PERSON_1] are anonymised already; leave them.\n"
    'Return only JSON: {"remaining_pii": [{"text": "<exact substring>", "type": "<PERSON|EMAIL|PHONE|ADDRESS|ORG|ID_NUMBER|URL|DOB|LOCATION>"}]}\n\nTEXT:\n<<<\n%TEXT%\n>>>'
)
VERIFIED = 0.85


def ollama_client(url: str, model: str, timeout: int = 60) -> Callable[[str], str]:
    def ask(prompt: str) -> str:
        import requests

        reply = requests.post(f"{url}/api/generate", json={"model": model, "prompt": prompt, "stream": False, "format": "json"}, timeout=timeout)
        reply.raise_for_status()
        return reply.json().get("response", "{}")

    return ask


def verified(text: str, ask: Callable[[str], str], attempts: int = 2) -> list[dict]:
    """DET-23: items the model names, each at its first place; none after two failures."""
    for _ in range(attempts):
        try:
            items = [(i["text"], i["type"]) for i in json.loads(ask(PROMPT.replace("%TEXT%", text)))["remaining_pii"]]
        except Exception:
            continue
        return [{"entity_type": t, "text": s, "start": at, "end": at + len(s), "layer": "L3_llm_verify", "confidence": VERIFIED} for s, t in items if (at := text.find(s)) >= 0]
    return []


def with_verified_spans(df: DataFrame, ask: Callable[[str], str], text: str = "anonymised_text", out: str = "llm_spans") -> DataFrame:
    """Adds what a verifying model finds in masked texts; offsets are in the masked text."""


    attach(df.sparkSession)
    span = pa.struct([("entity_type", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.string()), ("confidence", pa.float64())])
    schema = df.withColumn(out, F.array().cast(SPAN)).schema
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [verified(t or "", ask) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(span))], schema=pa.schema([*batch.schema, pa.field(out, pa.list_(span))]))

    return df.mapInArrow(run, schema)


def merge_verified(df: DataFrame, spans: str = "llm_spans") -> DataFrame:
    """DET-24: numbers go on from each type's last; replaced from the end; the spans keep the masked text's offsets."""

    def taken(tokens: Column, kind: Column) -> Column:
        numbers = F.transform(F.filter(tokens, lambda t: F.regexp_replace(t["token"], r"^\[|_\d+\]$", "") == kind), lambda t: F.regexp_extract(t["token"], r"_(\d+)\]$", 1).cast("int"))
        return F.coalesce(F.array_max(numbers), F.lit(0))

    ordered = F.array_sort(F.transform(spans, lambda s, i: F.struct((-s["start"]).alias("b"), i.alias("i"), s.alias("s"))))

    def step(a: Column, k: Column) -> Column:
        s = k["s"]
        token = F.concat(F.lit("["), s["entity_type"], F.lit("_"), (taken(a["tokens"], s["entity_type"]) + 1).cast("string"), F.lit("]"))
        one = F.struct(token.alias("token"), s["text"].alias("value"), s["start"].alias("start"), s["end"].alias("end"))
        return F.struct(
            F.concat(F.substr(a["text"], F.lit(1), s["start"]), token, F.substr(a["text"], s["end"] + 1)).alias("text"),
            F.concat(a["tokens"], F.array(one)).cast(TOKENS).alias("tokens"),
        )

    done = let(ordered, lambda x: F.aggregate(x, F.struct(F.col("anonymised_text").alias("text"), F.col("tokens").cast(TOKENS).alias("tokens")), step))
    return (
        df.withColumn("_done", done)
        .withColumns({"anonymised_text": F.col("_done.text"), "tokens": F.col("_done.tokens"), "detections": F.concat("detections", spans), "llm_verify_count": F.size(spans)})
        .drop("_done", spans)
    )
