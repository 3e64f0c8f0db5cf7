"""Options from outside, as bounded values."""

from __future__ import annotations

import math

TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def trimmed(value: object, most: int = 4096) -> str | None:
    """A string without white space around it, cut; None for others and blank ones."""
    text = value.strip() if isinstance(value, str) else ""
    return text[:most] or None


def boolean(value: object, fallback: bool = False) -> bool:
    word = value.strip().lower() if isinstance(value, str) else value
    return word if isinstance(word, bool) else True if word in TRUE else False if word in FALSE else fallback


def number(value: object, least: float = -math.inf, most: float = math.inf) -> float | None:
    """A finite number, or one written in a string, between the bounds; None for others."""
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        return None
    try:
        found = float(value)
    except ValueError:
        return None
    return min(most, max(least, found)) if math.isfinite(found) else None


def integer(value: object, least: int, most: int, fallback: int | None = None) -> int | None:
    found = number(value)
    return fallback if found is None else min(most, max(least, math.trunc(found)))


def strings(value: object, most: int = 64, longest: int = 256) -> list[str] | None:
    """The strings of a list that aren't blank, at most so many; None for anything else."""
    return [s for x in value if (s := trimmed(x, longest))][:most] if isinstance(value, list) else None


def port(value: object, fallback: int) -> int:
    return integer(value, 1, 65_535, fallback)
