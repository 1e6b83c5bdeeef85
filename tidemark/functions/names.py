"""Canonical column names."""

from __future__ import annotations

import re
import unicodedata


def canonical_name(name: str) -> str:
    """Trimmed, lower snake case, every run of other characters one underscore; accents fold, other letters stay."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name.strip()) if not unicodedata.combining(c))
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", unicodedata.normalize("NFC", plain))
    return re.sub(r"[\W_]+", "_", words.lower()).strip("_") or "col"


def canonical_names(names: list[str]) -> list[str]:
    """Canonical names in order; a repeated name gets the first free suffix ``_2``, ``_3`` …"""
    taken: set[str] = set()
    result = []
    for name in map(canonical_name, names):
        candidate, n = name, 1
        while candidate in taken:
            n += 1
            candidate = f"{name}_{n}"
        taken.add(candidate)
        result.append(candidate)
    return result
