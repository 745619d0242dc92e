"""Exact, fast encoding of texts with a byte-level BPE tokenizer file, each distinct piece once.

A byte-level pre-tokenizer takes white space only at the start of a word, so a text may be cut
before any space or line end that follows a character that is not white space: no word, merge or special
string spans such a cut. Pieces repeat heavily, so each distinct piece is encoded once per worker
and looked up afterwards; the table of pieces is bounded and only a cache.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Two white spaces before another character are words of their own, or open the next word, so a cut before
# each is safe; of three and more, or two at the end, several may be one word.
_LONG_RUN = re.compile(r"\s\s\s")
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n])")

#: A worker forgets its pieces after so many characters of them.
TABLE_CHARS = 12 << 20
#: Pieces that are encoded in one call; a longer text costs more for each of them.
JOINED_PIECES = 200


def safe_pieces(text: str) -> list[str]:
    """Cut ``text`` at safe boundaries; joined again the pieces are the text, and none is empty."""
    if not text:
        return []
    if text[-2:].isspace() or "\0" in text or _LONG_RUN.search(text):
        return _SAFE_CUT.split(text)
    pieces = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return pieces if pieces[0] else pieces[1:]


class Numbers(dict):
    """Numbers its keys in the order of their first use; ``fresh`` lists those not yet taken care of."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.fresh.append(key)
        return number

    def taken(self) -> list[str]:
        fresh, self.fresh = self.fresh, []
        return fresh


def gathered(data: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``picks`` of ``data`` one after another, and where each begins and the last ends."""
    starts = offsets[picks]
    sizes = offsets[picks + 1] - starts
    ends = np.r_[0, np.cumsum(sizes)]
    return data[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)], ends


class Runs:
    """Runs of numbers, one after another, in arrays that grow."""

    def __init__(self):
        self._data, self._ends, self._n, self._runs = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64), 0, 0

    def add(self, data: np.ndarray, sizes: np.ndarray) -> None:
        while self._n + len(data) > len(self._data):
            self._data = np.r_[self._data, np.zeros_like(self._data)]
        while self._runs + len(sizes) + 1 > len(self._ends):
            self._ends = np.r_[self._ends, np.zeros_like(self._ends)]
        self._data[self._n : self._n + len(data)] = data
        self._ends[self._runs + 1 : self._runs + len(sizes) + 1] = self._n + np.cumsum(sizes, dtype=np.int64)
        self._n, self._runs = self._n + len(data), self._runs + len(sizes)

    def take(self, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gathered(self._data, self._ends[: self._runs + 1], picks)

    def sizes(self, picks: np.ndarray) -> np.ndarray:
        return self._ends[picks + 1] - self._ends[picks]


def byte_batches(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[pa.Array]:
    """Slices of a column of texts that hold about ``most_bytes`` each; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = before = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield column.slice(at, end - at)
        at, before = end, int(ends[end - 1])


class PieceEncoder:
    """Encodes texts with a tokenizer file, without added special tokens.

    Special strings within texts are read as the file says. New pieces are encoded many at a time,
    with a special token of the file between them, where it has one.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        added = self._tokenizer.get_added_tokens_decoder()
        if any(re.search(r"\s", token.content) for token in added.values()):
            raise ValueError("texts can't be cut at spaces: a special string holds one")
        plain = [(number, token.content) for number, token in sorted(added.items()) if token.special and not (token.lstrip or token.rstrip or token.single_word or token.normalized)]
        self._between = plain[0] if plain else None
        self._forget()

    def _forget(self) -> None:
        self._numbers, self._runs, self._held = Numbers(), Runs(), 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> None:
        self._held += sum(map(len, fresh))
        for at in range(0, len(fresh), JOINED_PIECES):
            part = fresh[at : at + JOINED_PIECES]
            if self._between:
                number, mark = self._between
                data = np.array(self._ids([mark.join(part)])[0], np.int32)
                cuts = np.flatnonzero(data == number)
                if len(cuts) == len(part) - 1:
                    self._runs.add(np.delete(data, cuts), np.diff(np.r_[-1, cuts, len(data)]) - 1)
                    continue
            ids = self._ids(part)  # one holds the mark itself
            self._runs.add(np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all pieces, where those of each text begin and the last end)."""
        if self._held > TABLE_CHARS:
            self._forget()
        parts = [safe_pieces(text.as_py() or "") for text in texts]
        ends = np.cumsum([0, *map(len, parts)])
        numbers = np.fromiter(map(self._numbers.__getitem__, chain.from_iterable(parts)), np.int64, int(ends[-1]))
        self._learn(self._numbers.taken())
        return numbers, ends

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where those of each begin and the last end)."""
        numbers, ends = self._numbered(texts)
        data, places = self._runs.take(numbers)
        return data, places[ends]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        numbers, ends = self._numbered(texts)
        return np.diff(np.r_[0, np.cumsum(self._runs.sizes(numbers))][ends])


_ENCODERS: dict[str, PieceEncoder] = {}


def worker_encoder(tokenizer_path: str) -> PieceEncoder:
    """This worker's encoder of a file, kept over its tasks."""
    if tokenizer_path not in _ENCODERS:
        _ENCODERS[tokenizer_path] = PieceEncoder(tokenizer_path)
    return _ENCODERS[tokenizer_path]


def id_width(tokenizer_path: str, end_id: int) -> int:
    """Bytes that hold every id of the file, and ``end_id``."""
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
