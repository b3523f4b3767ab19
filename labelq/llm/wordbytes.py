"""Words of lower-cased ASCII letters, digits and all characters beyond ASCII, found on UTF-8 bytes.

One byte table lower-cases A-Z and turns every other ASCII character into a space.  It keeps lengths, so a
place in the normalised bytes is the same place in the original ones.
"""

from __future__ import annotations

import numpy as np

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 32 for b in range(256))


def normalised(text: str | None) -> bytes:
    """The bytes of ``text`` under TABLE; lone surrogates, which UTF-8 has no form for, count as word characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE)


def words(text: str | None) -> list[bytes]:
    return normalised(text).split()


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of every word of normalised ``data``."""
    solid = np.frombuffer(b" " + data + b" ", np.uint8) != 32
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    return edges[::2], edges[1::2]


def character_places(text: str, places: np.ndarray) -> np.ndarray:
    """Code point offsets of byte offsets of ``text``."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    starts = np.flatnonzero((raw & 0xC0) != 0x80)
    return np.searchsorted(starts, places, "left")
