"""Plain form of a text: NFKC, lower case, letters and digits only.

These are Python functions for use inside Arrow batches, as Spark has no
built-in Unicode normalisation of this kind.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np

_OTHER = re.compile(r"[\W_]+")
#: Wide marks and spaces of ordinary texts; NFKC makes narrow marks and spaces of them, never letters or digits.
_WIDE_MARKS = "，：；（）！？％\u3000\xa0"
#: Characters from which on a table look-up is the faster way.
_LONG = 40


@cache
def _alphanumeric() -> np.ndarray:
    """Whether each code point is a letter or a digit."""
    return np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000)


def plain_form(text: str | None) -> str:
    """``None`` gives ``''``."""
    if not text:
        return ""
    if not unicodedata.is_normalized("NFKC", text):
        for mark in _WIDE_MARKS:
            text = text.replace(mark, " ")
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if len(text) < _LONG:
        return _OTHER.sub("", text)
    points = code_points(text)
    return points[_alphanumeric()[points]].tobytes().decode("utf-32-le", "surrogatepass")


def code_points(text: str) -> np.ndarray:
    """The characters as uint32; lone surrogates are kept as they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def kgram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` characters, by doubling; empty if there are none."""
    if len(points) < k:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        power, width = base, 1
        piece = points.astype(np.uint64) + np.uint64(0x1000)
        pieces = []  # (width, hashes, multiplier for that width) of the binary digits of k
        while True:
            if k & width:
                pieces.append((width, piece, power))
            if width * 2 > k:
                break
            piece = piece[: len(piece) - width] * power + piece[width:]
            power = power * power
            width *= 2
        n, out, at = len(points) - k + 1, None, 0
        for w, h, p in reversed(pieces):
            part = h[at : at + n]
            out = part.copy() if out is None else out * p + part
            at += w
        return mix64(out)


#: Characters that are hashed together.
_TOGETHER = 1 << 16


def kgram_hashes_of(texts: Sequence[str], k: int) -> Iterator[np.ndarray]:
    """``kgram_hashes`` of each text, many short ones at a time."""
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(texts[end]) <= _TOGETHER):
            n += len(texts[end])
            end += 1
        hashes, start = kgram_hashes(code_points("".join(texts[at:end])), k), 0
        for t in texts[at:end]:
            yield hashes[start : start + max(0, len(t) - k + 1)]
            start += len(t)
        at = end


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser; spreads the bits of polynomial hashes."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))
