"""Hashed character and word features, computed on whole arrays of code points."""

from __future__ import annotations

from functools import cache

import numpy as np

SPACE = np.uint32(32)
_MIX = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F)]


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)


def letters_and_spaces(text: str | None) -> np.ndarray:
    """Lower-case letters; every run of other characters, and either end, is one space."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4")
    x = np.concatenate([[SPACE], np.where(_letters()[points], points, SPACE), [SPACE]]).astype(np.uint32)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != SPACE) | (x[:-1] != SPACE)
    return x[keep]


def _spread(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _MIX[3]
    return (h ^ (h >> np.uint32(13))) >> np.uint32(32 - bits)


def char_ngrams(x: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Buckets of all n-grams of ``x``."""
    out, h = [], np.zeros(len(x), np.uint32)
    for size in range(1, max(sizes) + 1):
        if len(x) < size:
            break
        h = (h[: len(x) - size + 1] * _MIX[0]) ^ ((x[size - 1 :] + np.uint32(size)) * _MIX[1])
        if size in sizes:
            out.append(_spread(h, bits))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def word_features(x: np.ndarray, prefixes: tuple[int, ...], bits: int) -> np.ndarray:
    """Distinct buckets of whole words (in the first 2**bits) and of word prefixes of
    given lengths (in a further 2**bits each)."""
    starts = np.flatnonzero((x[:-1] == SPACE) & (x[1:] != SPACE)) + 1
    if not len(starts):
        return np.empty(0, np.int64)
    ends = np.flatnonzero((x[1:] == SPACE) & (x[:-1] != SPACE)) + 1
    inside = np.arange(len(x)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(x)]])))
    power = np.cumprod(np.full(64, _MIX[0], np.uint32), dtype=np.uint32)[np.minimum(inside, 63)]
    sums = np.cumsum(np.where(x == SPACE, np.uint32(0), x * power), dtype=np.uint32)
    found = []
    for k, size in enumerate((None, *prefixes)):
        stop = ends if size is None else np.minimum(starts + size, ends)
        some = slice(None) if size is None else ends - starts >= size
        h = (sums[stop - 1] - sums[starts - 1])[some]
        found.append(_spread(h * _MIX[2] + np.uint32(k), bits).astype(np.int64) + (k << bits))
    return np.unique(np.concatenate(found))
