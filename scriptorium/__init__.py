"""A PySpark-native engine for recovering and structuring scholarly text."""

from __future__ import annotations

__version__ = "0.2.0"
_FROM = {
    "decode_text": "operators.decode", "decode_tokens": "operators.decode", "decode_distinct": "operators.decode", "ranked": "operators.detect", "scores": "operators.detect", "best": "operators.detect",
    "runs": "operators.fonts", "census": "operators.fonts", "table_of": "operators.fonts", "classify": "operators.layers", "has_legacy_greek": "operators.layers", "decode_pages": "operators.sinks",
    "encodings": "functions.keytables", "keymap": "functions.keytables", "is_greek": "functions.text", "register": "functions.sql",
}
__all__ = [*_FROM]


def __getattr__(name: str):
    import importlib

    if name not in _FROM:
        raise AttributeError(name)
    return getattr(importlib.import_module(f"{__name__}.{_FROM[name]}"), name)
