"""Runs of letters in byte arrays, and hashes of parts of them (runs inside tasks)."""

from __future__ import annotations

import numpy as np

from addrloom.llm.arrowtext import word_bounds

SMALL = np.arange(256, dtype=np.uint8)
SMALL[ord("A") : ord("Z") + 1] += 32
# a letter's byte: a-z, A-Z, or any byte of a character beyond ASCII
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_VALUES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def letter_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes with A-Z made small, and start, end and row of every run of letters."""
    return SMALL[data], *word_bounds(IS_LETTER[data], at)


def powers(base: int, n: int) -> np.ndarray:
    """The powers of an odd number from 0 on, modulo 2**64."""
    out = np.full(n, base % 2**64, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class PartHashes:
    """Hashes of any byte ranges by differences of one running sum, modulo 2**64."""

    def __init__(self) -> None:
        self.powers = self.back = np.ones(1, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if n > len(self.powers):
            self.powers, self.back = powers(_BASE, n), powers(pow(_BASE, -1, 2**64), n)
        out = np.zeros(n, np.uint64)
        np.cumsum(_VALUES[data] * self.powers[: n - 1], out=out[1:])
        return out

    def of(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self.back[starts]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)
