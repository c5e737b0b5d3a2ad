"""Binary fuse filters (Graf and Lemire, 2022): static sets of 64-bit keys at about nine bits a key, built with numpy."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor, log

import numpy as np

from passagework.llm.base import mixed

#: More seeds than any set of different keys needs.
SEEDS = 100


@dataclass(frozen=True)
class FuseFilter:
    """`holds` is true for every key of the set and for about one in 256 others."""

    seed: int
    segment: int
    prints: np.ndarray

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.prints):
            return np.zeros(len(keys), dtype=bool)
        hashes = _hashes(keys, self.seed)
        a, b, c = self.prints[_slots(hashes, self.segment, len(self.prints))]
        return (a ^ b ^ c) == _prints(hashes)

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment], dtype="<i8").tobytes() + self.prints.tobytes()

    @staticmethod
    def from_bytes(body: bytes) -> FuseFilter:
        seed, segment = np.frombuffer(body, dtype="<i8", count=2)
        return FuseFilter(int(seed), int(segment), np.frombuffer(body, dtype=np.uint8, offset=16))

    @staticmethod
    def of(keys: np.ndarray) -> FuseFilter:
        """The filter of some 64-bit keys; keys that repeat count once."""
        keys = np.unique(keys.astype(np.uint64))
        if not len(keys):
            return FuseFilter(0, 1, np.zeros(0, dtype=np.uint8))
        segment, length = _shape(len(keys))
        for seed in range(SEEDS):
            hashes = _hashes(keys, seed)
            slots = _slots(hashes, segment, length)
            if (order := _peeled(slots, length)) is not None:
                return FuseFilter(seed, segment, _filled(slots, _prints(hashes), order, length))
        raise RuntimeError("no seed makes a filter")  # keys are distinct, so this has no practical chance


def _shape(count: int) -> tuple[int, int]:
    """Slots in a segment (a power of two) and in all."""
    segment = 1 << min(18, max(2, floor(log(max(count, 2)) / log(3.33) + 2.25)))
    room = count * max(1.125, 0.875 + 0.25 * log(10**6) / log(max(count, 2)))
    return segment, segment * (max(1, ceil(room / segment) - 2) + 2)


def _hashes(keys: np.ndarray, seed: int) -> np.ndarray:
    return mixed(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64))


def _prints(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def _slots(hashes: np.ndarray, segment: int, length: int) -> np.ndarray:
    """Three slots for each key, in three segments side by side."""
    starts = np.uint64(length - 2 * segment)
    low = np.uint64(segment - 1)
    first = ((hashes >> np.uint64(32)) * starts) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((hashes >> np.uint64(18)) & low)
    third = (first + np.uint64(2 * segment)) ^ (hashes & low)
    return np.stack([first, second, third]).astype(np.int64)


def _peeled(slots: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (keys, slots that only these keys are left in), or None if some keys cannot be told apart."""
    keys = np.arange(slots.shape[1])
    held, which = np.bincount(slots.ravel(), minlength=length), np.zeros(length, dtype=np.int64)
    for row in slots:
        np.bitwise_xor.at(which, row, keys)
    rounds, left = [], len(keys)
    front = np.flatnonzero(held == 1)
    while len(front):
        own, at = np.unique(which[front], return_index=True)
        rounds.append((own, front[at]))
        left -= len(own)
        touched = slots[:, own].ravel()
        np.subtract.at(held, touched, 1)
        np.bitwise_xor.at(which, touched, np.tile(own, 3))
        front = np.unique(touched[held[touched] == 1])
    return rounds if not left else None


def _filled(slots: np.ndarray, prints: np.ndarray, rounds: list[tuple[np.ndarray, np.ndarray]], length: int) -> np.ndarray:
    """The table in which the three slots of every key give its print: the last keys peeled are set first."""
    table = np.zeros(length, dtype=np.uint8)
    for keys, own in reversed(rounds):
        # The own slot still holds 0 and no other key of the round uses it.
        a, b, c = table[slots[:, keys]]
        table[own] = a ^ b ^ c ^ prints[keys]
    return table
