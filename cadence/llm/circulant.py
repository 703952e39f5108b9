"""Circulant MinHash: every signature coordinate from two permutations, one of them shifted circularly."""

from __future__ import annotations

import numpy as np


class CirculantMinHash:
    """Signatures of ``coordinates`` values over a universe of ``2 ** bits`` places.

    The first permutation scatters a hashed shingle to a place; coordinate k is
    the least value that the second permutation, shifted by k places, gives to
    the scattered set. The shifted copies are windows of one table, so that no
    coordinate has a permutation of its own.
    """

    def __init__(self, coordinates: int = 128, bits: int = 20, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.mask = np.uint64((1 << bits) - 1)
        self.scatter = rng.permutation(1 << bits).astype(np.int32)
        second = rng.permutation(1 << bits).astype(np.int32)
        around = np.concatenate([second, second[: coordinates - 1]])
        self.windows = np.lib.stride_tricks.sliding_window_view(around, coordinates)
        self.coordinates = coordinates

    def signature(self, hashes: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """Of a set that is not empty; ``chunk`` bounds the memory of a large one."""
        places = self.scatter[(hashes & self.mask).astype(np.int64)]
        least = self.windows[places[:chunk]].min(axis=0)
        for at in range(chunk, len(places), chunk):
            np.minimum(least, self.windows[places[at : at + chunk]].min(axis=0), out=least)
        return least
