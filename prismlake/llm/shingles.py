"""Word-shingle sets and one-permutation MinHash signatures, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
BINS = 256
ROWS = 5
BANDS = BINS // ROWS

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)
_BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


class _WordHash(dict):
    """64-bit hash of a word, remembered; bounded."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 150_000:
            self[word] = value
        return value


_HASH = _WordHash()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a whole text.

    A-Z are lower-cased and words are runs without ASCII white space. A text of fewer words is one
    shingle; a text without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        one = (one ^ (one >> _S29)) * _MIX
        one ^= one >> _S32
        n = max(1, len(one) - WORDS + 1)
        total = np.full(n, min(len(one), WORDS), np.uint64)
        for k in range(min(WORDS, len(one))):
            total = (total ^ (total >> _S29)) * _C[0] + one[k : k + n] * _C[k]
        total = (total ^ (total >> _S32)) * _MIX
        total ^= total >> _S29
    return np.unique(total)


def _probe_order() -> np.ndarray:
    """For each bin a fixed pseudo-random order of all bins, in which an empty bin looks for a full one."""
    draw = np.random.default_rng(20240501)
    return np.stack([draw.permutation(BINS) for _ in range(BINS)])


_PROBES = _probe_order()
_BAND_SALT = np.arange(1, BANDS + 1, dtype=np.uint64) * _C[1]


def band_hashes(shingles: np.ndarray) -> np.ndarray:
    """One signed 64-bit key a band of the one-permutation signature, optimally densified.

    The top bits of a shingle's hash name its bin, and a bin keeps its least hash. An empty bin
    copies the first full bin in its own fixed random order.
    """
    bins = (shingles >> _BIN_SHIFT).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    signature = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    signature[bins[first]], full[bins[first]] = shingles[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _PROBES[empty]
        signature[empty] = signature[order[np.arange(len(empty)), full[order].argmax(1)]]
    rows = signature[: BANDS * ROWS].reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = _BAND_SALT.copy()
        for k in range(ROWS):
            key = (key ^ (key >> _S29)) * _MIX + rows[:, k] * _C[k]
        key ^= key >> _S32
        key *= _MIX
    return key.view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())
