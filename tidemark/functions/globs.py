"""Case-sensitive shell globs as Java regular expressions for ``rlike``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_regex(glob: str) -> str:
    """``*`` any run, ``?`` one character, ``[seq]`` / ``[!seq]`` a set, everything else literal."""
    out, rest = [], glob
    while rest:
        char, rest = rest[0], rest[1:]
        closing = rest.find("]", 2 if rest[:1] == "!" else 1) if char == "[" else -1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif closing > 0:
            members, rest = rest[:closing], rest[closing + 1 :]
            negated = members.startswith("!")
            body = re.sub(r"([\\\[\]^&])", r"\\\1", members[1:] if negated else members)
            out.append(f"[{'^' if negated else ''}{body}]")
        else:
            out.append(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", char))
    return f"(?s)^{''.join(out)}\\z"


def matches_any(column: Column, globs: list[str]) -> Column:
    """True when the value matches at least one glob; false for an empty list."""
    hit = F.lit(False)
    for glob in globs:
        hit = hit | column.rlike(glob_to_regex(glob))
    return hit
