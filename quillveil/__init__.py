"""Masking of personal data in tables of texts, and its reversal, on Spark. ``register`` adds the functions to Spark SQL.

Names are looked up when they are used, so that a worker that imports one module doesn't load all.
"""

from __future__ import annotations

import importlib

_PLACES = {
    "process": "operators.document", "anonymize_deterministic": "operators.masking", "anonymize_manual": "operators.masking", "anonymize_with": "operators.masking", "restored": "operators.masking",
    "Rule": "operators.recognizers", "found": "operators.recognizers", "with_rules": "operators.recognizers", "register": "operators.registry",
}
__all__ = list(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(name)
    return getattr(importlib.import_module(f".{_PLACES[name]}", __name__), name)
