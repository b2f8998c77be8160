"""Engine options; defaults give the standard behaviour, the others are opt-in."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, fields
from pathlib import Path

VERSION = "1.0.0"


@dataclass(frozen=True)
class Options:
    normalise: str = "auto"  # auto, always or never
    confidence_threshold: float = 0.85
    ocr_letter_share: float = 0.08
    ocr_digit_pairs_per_line: float = 4.0
    ocr_sample: int = 2000
    minimum_quality: float = 0.0  # documents below it fail at extraction; 0 keeps all
    strict_iban: bool = False
    strict_suffix: bool = False  # legal suffixes must end at a word's end

    @classmethod
    def load(cls, path: str | None) -> Options:
        """Options of a YAML file (``options:`` or the top level); defaults if there is none."""
        if path is None or not Path(path).exists():
            return cls()
        import yaml

        data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        data = data.get("options", data)
        return cls(**{f.name: data[f.name] for f in fields(cls) if f.name in data})


def config_hash(path: str | None) -> str:
    if path is None or not Path(path).exists():
        return "00000000"
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()[:16]
