"""Neighbouring characters of a batch of texts, as arrays of code points."""

from __future__ import annotations

import numpy as np


def char_pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first and second code point of every pair of neighbours.
    Texts are framed by code point 0, so one of n characters has n + 1 pairs."""
    codes = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le"), dtype="<u4").astype(np.int64)
    pairs = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return np.repeat(np.arange(len(texts)), pairs), codes[:-1], codes[1:]
