"""Minimal perfect hash over distinct 64-bit keys: levels of bit arrays, the rank of a key's bit is its index."""

from __future__ import annotations

import numpy as np

GAMMA = 1.7
MOST_LEVELS = 60


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser, seeded."""
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class PerfectHash:
    def __init__(self, keys: np.ndarray):
        left, self.sizes, bits = np.unique(keys.astype(np.uint64)), [], []
        for level in range(MOST_LEVELS):
            if not len(left):
                break
            size = max(64, int(GAMMA * len(left)) | 1)
            at = (mix(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys could not be placed")
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.bits = np.packbits(flat, bitorder="little")
        padded = np.zeros(-len(self.bits) % 8 + len(self.bits), np.uint8)
        padded[: len(self.bits)] = self.bits
        self.bits = padded
        ones = np.unpackbits(padded, bitorder="little").reshape(-1, 64).sum(1) if len(padded) else np.zeros(0, np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)

    def __len__(self) -> int:
        return int(self.ranks[-1])

    def index(self, keys: np.ndarray) -> np.ndarray:
        """0 to n-1, a different one for each key of the set; any index or -1 for others."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        words = self.bits.view(np.uint64)
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            low = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.ranks[at[hit] >> 6] + np.bitwise_count(low)
            open_ = open_[~hit]
            base += size
        return out
