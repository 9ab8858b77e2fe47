"""Word shingles of texts as 64-bit hashes, the same in every process."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

WIDTH = 5
_M = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def ascii_words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` in UTF-8 with A-Z lower-cased: just what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_BASE = 0xC2B2AE3D27D4EB4F  # odd, so that its powers have inverses
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Shingler:
    """Distinct shingle hashes of texts. Words are hashed all at once, by differences of one running polynomial over the bytes."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        one = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            self.up = np.concatenate([one, np.cumprod(np.full(n, _BASE, np.uint64))])
            self.down = np.concatenate([one, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))])

    def word_hashes(self, raw: bytes) -> np.ndarray:
        """Hashes of the words of a text, A-Z lower-cased."""
        a = np.frombuffer(raw.lower(), np.uint8)
        if len(a) >= len(self.up):
            self._powers(2 * len(a))
        space = np.ones(len(a) + 2, np.int8)
        space[1:-1] = _SPACE[a]
        edge = np.diff(space)
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        run = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * self.up[: len(a)], out=run[1:])
        return mixed((run[end] - run[start]) * self.down[start] + (end - start).astype(np.uint64))

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes; a text with fewer words than the width has its whole sequence as one, one without words none."""
        h = self.word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.zeros(0, np.uint64)
        n = len(h)
        if not n:
            return h
        width = min(n, self.width)
        out = np.full(n - width + 1, np.uint64(width if n < self.width else 0), np.uint64)
        for k in range(width):
            out = out * _M + h[k : k + len(out)]
        return np.unique(mixed(out))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a set of shingles."""
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)
