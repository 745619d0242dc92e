"""Hashed character n-grams of texts, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def batch_slots(texts: list[str], sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, every n-gram of every text, repeats included: (number of its text, its slot below 2**bits)."""
    coded = [np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4") for text in texts]
    code = np.concatenate([np.zeros(0, np.uint32), *coded]).astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(c) for c in coded])
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        mixed = (code + np.uint64(1)) * _MIX
        mixed ^= mixed >> np.uint64(29)
        rolled = mixed
        for size in range(1, max(sizes) + 1):
            if size > 1:
                rolled = rolled[:-1] * _STEP + mixed[size - 1 :]
            if not len(rolled):
                break
            if size in sizes:
                last = rolled ^ (rolled >> np.uint64(32))
                slots = ((last * _MIX + np.uint64(size)) >> shift).astype(np.uint32)
                if size == 1:
                    yield row, slots
                else:
                    within = row[: len(slots)] == row[size - 1 :]  # an n-gram does not reach into the next text
                    yield row[: len(slots)][within], slots[within]


def gram_slots(text: str, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """The slot, below 2**bits, of each n-gram of each size of one text, repeats included."""
    return np.concatenate([np.zeros(0, np.uint32), *(slots for _, slots in batch_slots([text], sizes, bits))])
