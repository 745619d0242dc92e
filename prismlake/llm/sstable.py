"""Sorted-string-table shards of token ids.

Layout of a shard: data blocks, block index, Bloom filter, footer. A block holds entries in key
order; each entry stores how many bytes its key shares with the one before, the rest of the key and
the ids. The index names the last key, place and size of each block. All integers are little-endian
except inside keys.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard

MAGIC = b"TOKSST01"
#: index place and size, filter place and size, entries, ids, bytes of an id, hash functions, magic
FOOTER = struct.Struct("<QQQQQQBB8s")
BLOCK_BYTES = 1 << 16
BITS_PER_KEY = 10
HASHES = 7


def document_key(doc_id: int | None, repeat: int = 0) -> bytes:
    """Bytes that sort as (null first, id, repeat) does."""
    if doc_id is None:
        return b"\0" + bytes(8) + repeat.to_bytes(4, "big")
    return b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big") + repeat.to_bytes(4, "big")


def key_document(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:9], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _filter_places(doc_key: bytes, bits: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(doc_key), xxhash.xxh64_intdigest(doc_key, seed=1) | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class ShardWriter:
    """Writes one shard to ``sink``; keys must come in ascending order."""

    def __init__(self, sink, id_bytes: int):
        self._sink, self.id_bytes = sink, id_bytes
        self._packer = zstandard.ZstdCompressor(level=1)
        self._block = bytearray()
        self._last = b""
        self._index: list[tuple[bytes, int, int]] = []
        self._ids_of_keys: list[bytes] = []
        self.entries = self.ids = self.size = 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.entries and key < self._last:
            raise ValueError("keys must ascend")
        shared = 0
        if self._block:
            while shared < len(key) and key[shared] == self._last[shared]:
                shared += 1
        self._block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self._last = key
        self._ids_of_keys.append(key[:9])
        self.entries += 1
        self.ids += len(value) // self.id_bytes
        if len(self._block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self._block:
            packed = self._packer.compress(bytes(self._block))
            self._index.append((self._last, self.size, len(packed)))
            self._put(packed)
            self._block = bytearray()

    def _put(self, data: bytes) -> None:
        self._sink.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._end_block()
        index_at = self.size
        self._put(b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self._index))
        filter_at = self.size
        bits = max(64, BITS_PER_KEY * len(self._ids_of_keys))
        marks = np.zeros(bits, np.bool_)
        for key in self._ids_of_keys:
            marks[_filter_places(key, bits)] = True
        self._put(struct.pack("<Q", bits) + np.packbits(marks, bitorder="little").tobytes())
        self._put(FOOTER.pack(index_at, filter_at - index_at, filter_at, self.size - filter_at, self.entries, self.ids, self.id_bytes, HASHES, MAGIC))


class ShardReader:
    """Reads a shard from a seekable source; holds the index, the filter and one block at a time."""

    def __init__(self, source):
        self._source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - FOOTER.size)
        index_at, index_n, filter_at, filter_n, self.entries, self.ids, self.id_bytes, _, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        raw = self._at(index_at, index_n)
        self._index: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(raw):
            n, at = _read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            place, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            self._index.append((key, place, size))
        self._last_keys = [key[:9] for key, _, _ in self._index]
        raw = self._at(filter_at, filter_n)
        self._bits = struct.unpack_from("<Q", raw)[0]
        self._filter = raw[8:]
        self._unpacker = zstandard.ZstdDecompressor()

    def _at(self, place: int, size: int) -> bytes:
        self._source.seek(place)
        return self._source.read(size)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, size = self._index[block]
        data = self._unpacker.decompress(self._at(place, size))
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self._index)):
            for key, value in self._entries(block):
                yield key_document(key), np.frombuffer(value, f"<u{self.id_bytes}")

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self._filter[p >> 3] >> (p & 7) & 1 for p in _filter_places(document_key(doc_id)[:9], self._bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every entry with this id: filter, binary search of the index, scan of the blocks that may hold it."""
        if not self.may_hold(doc_id):
            return []
        want, found = document_key(doc_id)[:9], []
        for block in range(bisect.bisect_left(self._last_keys, want), len(self._index)):
            for key, value in self._entries(block):
                if key[:9] == want:
                    found.append(np.frombuffer(value, f"<u{self.id_bytes}"))
                elif key[:9] > want:
                    return found
        return found
