"""Numerals for the line parsers."""

from __future__ import annotations

import re

_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def roman_value(text: str) -> int | None:
    """The value of a roman numeral; None if it is none."""
    low = text.strip().lower()
    if not low or not re.fullmatch(r"m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})", low):
        return None
    digits = [_VALUES[c] for c in low]
    return sum(-a if a < b else a for a, b in zip(digits, [*digits[1:], 0], strict=True))
