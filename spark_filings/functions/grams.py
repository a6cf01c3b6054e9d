"""Runs of characters of a text, hashed together."""

from __future__ import annotations

import numpy as np


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)


def gram_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of `size` code points; equal runs have equal ones."""
    n = max(0, len(points) - size + 1)
    hashed = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + points[k : k + n]
        hashed ^= hashed >> np.uint64(29)
    return hashed
