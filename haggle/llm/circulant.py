"""Circulant MinHash signatures.

Two permutations make all coordinates.  The first (a bijective mixer on the
64-bit shingle universe, folded to ``UNIVERSE`` places) scatters the set.  The
second is one stored permutation ``pi`` of the places; coordinate k reads it
shifted circularly by k.  The K values a place contributes are then K
neighbours of ``pi``, so one window gather and one minimum give the whole
signature.
"""

from __future__ import annotations

import numpy as np

from haggle.llm.words import mix

UNIVERSE = 1 << 21
_cache: dict[tuple[int, int], np.ndarray] = {}


def windows(k: int, seed: int = 7) -> np.ndarray:
    """Row i: pi at places i, i+1, ..., i+k-1 (circular); a view, not a copy."""
    if (k, seed) not in _cache:
        pi = np.random.default_rng(seed).permutation(UNIVERSE).astype(np.uint32)
        _cache[k, seed] = np.lib.stride_tricks.sliding_window_view(np.concatenate((pi, pi[: k - 1])), k)
    return _cache[k, seed]


def signature(shingles: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """The k circulant MinHash coordinates of a non-empty set of 64-bit hashes."""
    view = windows(k, seed)
    places = (mix(shingles ^ np.uint64(0xA5A5A5A5DEADBEEF)) % np.uint64(UNIVERSE)).astype(np.int64)
    best = None
    for at in range(0, len(places), 512):
        low = view[places[at: at + 512]].min(axis=0)
        best = low if best is None else np.minimum(best, low)
    return best


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates; the band's number is part of the key."""
    bands = sig.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(bands), dtype=np.uint64) + np.uint64(1)
    for i in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + bands[:, i])
    return key.view(np.int64)
