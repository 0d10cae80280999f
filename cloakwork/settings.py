"""Settings that change results, as one immutable value."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Settings:
    """Defaults of a run. dpi: of rendered pages. hash_bits: for picture hashes of templates."""

    fill: tuple[int, int, int] = (0, 0, 0)
    padding: int = 4
    min_confidence: float | None = 0.60
    handwriting_min_area: int = 500
    include_text: bool = False
    dpi: int = 300
    skip_visual_for_structured: bool = False
    hash_bits: int = 10

    def changed(self, **values: Any) -> Settings:
        return dataclasses.replace(self, **values)


def merged(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Nested settings with others laid over them; neither is changed."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def read(path: str, overrides: dict[str, Any] | None = None) -> Settings:
    """Settings from a JSON file, or from a YAML file where a YAML library is installed."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            nested = json.load(f)
        else:
            try:
                import yaml
            except ImportError as missing:
                raise ValueError(f"{path}: no YAML library is installed, use JSON") from missing
            nested = yaml.safe_load(f)
    return load(nested or {}, overrides)


def load(nested: dict[str, Any] | None = None, overrides: dict[str, Any] | None = None) -> Settings:
    """Settings from sections of a parsed file; unknown keys are ignored."""
    flat: dict[str, Any] = {}
    for section in merged(nested or {}, overrides or {}).values():
        flat |= section if isinstance(section, dict) else {}
    names = {
        "fill_color": "fill", "fill_padding_px": "padding", "min_confidence": "min_confidence", "handwriting_min_area": "handwriting_min_area",
        "include_text": "include_text", "ocr_dpi": "dpi", "skip_visual_for_structured_pdfs": "skip_visual_for_structured", "perceptual_hash_threshold": "hash_bits",
    }
    known = {names[k]: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in names}
    return Settings(**known)
