"""Character n-grams of batches of texts, as arrays of code points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters handled at once.
GROUP = 1 << 19
_PLACES = np.array(
    [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64
)


def grouped(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about ``GROUP`` characters, one text at least."""
    i = size = 0
    for j, text in enumerate(texts):
        size += len(text) + 1
        if size >= GROUP:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a 0, and where each text begins."""
    parts = [t.replace("\0", " ") if "\0" in t else t for t in texts]
    found = np.frombuffer(("\0".join(parts) + "\0").encode("utf-32-le", "replace"), np.uint32)
    ends = np.flatnonzero(found == 0)
    return found, np.concatenate([[0], ends + 1])


def ngrams(found: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram at each place, and whether it stays inside a text."""
    m = len(found) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.full(m, n, np.uint64)
    inside = np.ones(m, bool)
    zero = found == 0
    for j in range(n):
        total += found[j : j + m] * _PLACES[j]
        inside &= ~zero[j : j + m]
    return total, inside


def sums(values: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` over n segments; ``begin`` has their n + 1 bounds.

    Each segment is added up by itself, so a text's sum does not depend on
    its neighbours in the batch.
    """
    out = np.zeros(n, values.dtype if values.dtype.kind == "f" else np.int64)
    some = np.flatnonzero(begin[1 : n + 1] > begin[:n])
    if len(some):
        out[some] = np.add.reduceat(values, begin[some], dtype=out.dtype)
    return out
