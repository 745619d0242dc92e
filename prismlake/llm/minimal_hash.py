"""A minimal perfect hash over 96-bit keys: bit tables by level, ranked by population counts."""

from __future__ import annotations

import numpy as np

_STEP, _MIX, _MARK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32, _ONE = np.uint64(29), np.uint64(32), np.uint64(1)


def _place(keys: np.ndarray, marks: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (keys ^ (marks.astype(np.uint64) * _MARK)) + np.uint64(level + 1) * _STEP
        x = (x ^ (x >> _S29)) * _MIX
        x = (x ^ (x >> _S32)) * _STEP
        x ^= x >> _S29
    return (x % np.uint64(bits)).astype(np.int64)


class MinimalHash:
    """Numbers distinct keys (64 bits and 32 bits) from 0 to n - 1 without keeping them.

    A level has two bits a key; a key that is alone at its bit is settled there, the others go on to
    the next level. A key's number is the count of set bits before its own. Other keys get any
    number, or -1.
    """

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray, marks: np.ndarray) -> MinimalHash:
        sizes, tables = [], [np.zeros(0, np.uint64)]
        while len(keys):
            bits = -(-2 * len(keys) // 64) * 64
            at = _place(keys, marks, len(sizes), bits)
            alone = np.bincount(at, minlength=bits) == 1
            tables.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(bits)
            left = ~alone[at]
            keys, marks = keys[left], marks[left]
        return cls(sizes, np.concatenate(tables))

    def numbers(self, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        found, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, bits in enumerate(self.sizes):
            if not len(open_):
                break
            at = base + _place(keys[open_], marks[open_], level, bits)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & _ONE == _ONE
            found[open_[here]] = self.before[at[here] >> 6] + np.bitwise_count(word[here] & ((_ONE << bit[here]) - _ONE))
            open_, base = open_[~here], base + bits
        return found

    def to_bytes(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], "<u8").tobytes() + self.words.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> MinimalHash:
        held = np.frombuffer(data, "<u8")
        levels = int(held[0])
        return cls(held[1 : 1 + levels].astype(int).tolist(), held[1 + levels :])
