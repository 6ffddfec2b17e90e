"""Texts as arrays of symbols of a small alphabet, for the string kernels."""

from __future__ import annotations

import numpy as np

#: Symbols: 0 what separates words, 1-26 letters, 27-57 letters beyond ASCII, 58 digits, 59-63 other signs.
SYMBOLS, BITS = 64, 6


def _table() -> np.ndarray:
    """Code points below 0x10000 -> symbol, upper case as lower case."""
    out = np.zeros(1 << 16, np.uint8)
    for p in range(1 << 16):
        if 0xD800 <= p < 0xE000:
            continue
        c = chr(p)
        low = c.lower()[:1]
        if "a" <= low <= "z" and low.isascii():
            out[p] = ord(low) - 96
        elif c.isdigit():
            out[p] = 58
        elif c.isalpha():
            out[p] = 27 + ord(low) % 31
        elif not c.isspace() and c.isprintable() and c not in ".,;:!?":
            out[p] = 59 + p % 5
    return out


_SYMBOL: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """A symbol (uint8) for each code point."""
    if not _SYMBOL:
        _SYMBOL.append(_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _SYMBOL[0][points & 0xFFFF if len(points) and points.max() > 0xFFFF else points]
