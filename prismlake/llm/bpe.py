"""Byte-level BPE by Spark's higher-order functions over distinct words, and its decoding."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import Numbers, Runs, gathered, safe_pieces

#: Characters of text that leave a task as one row; a longer document makes a row of its own.
FLUSH_CHARS = 512 << 10
#: A task forgets its words after so many characters of distinct pieces, which bounds its memory.
DICTIONARY_CHARS = 4 << 20


@lru_cache(maxsize=2)
def read_ranks(path: str) -> list[bytes]:
    """The pieces of a rank file, by rank; a worker reads it once."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(piece) for piece, rank in (line.split() for line in lines if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [found[k] for k in range(len(found))]


def merges(pieces: list[bytes]) -> dict[int, tuple[int, int]]:
    """The two parts of each piece of several bytes: what merges of lower rank leave of its bytes.

    A part is a piece of lower rank or a byte. Ranks of a trained vocabulary have two parts for
    each piece; others raise.
    """
    number = {piece: k for k, piece in enumerate(pieces)}
    if any(bytes([b]) not in number for b in range(256)):
        raise ValueError("every byte must be a piece")
    rank: dict[tuple[int, int], int] = {}
    parts: dict[int, tuple[int, int]] = {}
    for merged, piece in enumerate(pieces):
        if len(piece) < 2:
            continue
        symbols = [number[piece[k : k + 1]] for k in range(len(piece))]
        while len(symbols) > 2:
            least, at = min((rank.get(pair, len(pieces)), k) for k, pair in enumerate(zip(symbols, symbols[1:])))
            if least == len(pieces):
                raise ValueError(f"piece {merged} is not made of two pieces of lower rank")
            symbols[at : at + 2] = [least]
        parts[merged] = rank_of = (symbols[0], symbols[1])
        rank[rank_of] = merged
    return parts


def _codes(pieces: list[bytes]) -> list[int]:
    """The character that stands for each piece: a byte for itself, the others from 256 on, surrogates left out."""
    codes = [piece[0] if len(piece) == 1 else 256 + rank for rank, piece in enumerate(pieces)]
    return [code if code < 0xD800 else code + 0x800 for code in codes]


def rank_literal(pieces: list[bytes]) -> Column:
    """The rank map as one constant: by rank, the two characters that merge and the one they become."""
    char, parts = [chr(code) for code in _codes(pieces)], merges(pieces)
    pairs = [char[parts[k][0]] + char[parts[k][1]] if k in parts else None for k in range(len(pieces))]
    return F.from_json(F.lit(json.dumps({"pairs": pairs, "merged": char}, separators=(",", ":"))), "pairs array<string>, merged array<string>")


def folded_symbols(word: Column, ranks: Column, known: Column) -> Column:
    """Fold the merges ``ranks``, ascending, over the bytes of ``word``: a string with a character for each piece left.

    ``ranks`` names every piece whose bytes occur in the word, or more. Taken in this order, a merge
    finds its two parts side by side exactly where ranked merging joins them: all lower merges are
    done, and a merge never gives a pair of lower rank. ``replace`` joins from the left without
    overlap, as ranked merging does.
    """
    return F.aggregate(ranks, F.decode(word, "ISO-8859-1"), lambda state, rank: F.replace(state, F.get(known["pairs"], rank), F.get(known["merged"], rank)))


class _Occurring:
    """Finds the pieces of several bytes that occur in words, in all words at once.

    Each prefix of a piece has a slot by its rolling hash. Other bytes may fall in the same slot, so
    a word may get a piece too many, which the fold passes over, but never one too few.
    """

    _BITS, _BASE, _MIX = 21, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(piece) for piece in pieces])
        self._most = int(sizes.max())
        letters = np.frombuffer(b"".join(piece.ljust(self._most, b"\0") for piece in pieces), np.uint8).reshape(len(pieces), -1)
        self._begun = np.zeros(1 << self._BITS, bool)
        self._ranks: list[np.ndarray] = []  # pieces that share a slot lie in several tables
        rolled = letters[:, 0].astype(np.uint64) + np.uint64(1)
        for size in range(2, self._most + 1):
            left = np.flatnonzero(sizes >= size)
            rolled[left] = rolled[left] * self._BASE + letters[left, size - 1] + np.uint64(1)
            slots = self._slot(rolled[left])
            self._begun[slots] = True
            slots, left = slots[sizes[left] == size], left[sizes[left] == size]
            for table in range(len(pieces)):
                if not len(left):
                    break
                if table == len(self._ranks):
                    self._ranks.append(np.full(1 << self._BITS, -1, np.int32))
                free = np.flatnonzero(self._ranks[table][slots] < 0)
                free = free[np.unique(slots[free], return_index=True)[1]]
                self._ranks[table][slots[free]] = left[free]
                slots, left = np.delete(slots, free), np.delete(left, free)

    def _slot(self, rolled: np.ndarray) -> np.ndarray:
        return ((rolled ^ rolled >> np.uint64(32)) * self._MIX >> np.uint64(64 - self._BITS)).astype(np.int64)

    def in_words(self, words: list[bytes]) -> pa.ListArray:
        """The ranks of each word, ascending."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array([len(word) for word in words])
        word_of = np.repeat(np.arange(len(words)), sizes)
        room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))
        at, rolled, found = np.arange(len(data)), data.astype(np.uint64) + np.uint64(1), []
        for size in range(2, self._most + 1):
            fits = room[at] >= size
            at = at[fits]
            rolled = rolled[fits] * self._BASE + data[at + size - 1] + np.uint64(1)
            slots = self._slot(rolled)
            begun = self._begun[slots]
            at, rolled, slots = at[begun], rolled[begun], slots[begun]
            if not len(at):
                break
            for ranks in self._ranks:
                rank = ranks[slots]
                hit = rank >= 0
                found.append(word_of[at[hit]] << 32 | rank[hit])
        pairs = np.sort(np.concatenate([np.zeros(0, np.int64), *found]))
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]]
        ends = np.searchsorted(pairs, np.arange(len(words) + 1) << 32)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)))


def _packed(values) -> bytes:
    return np.asarray(values, "<i4").tobytes()


_CUT = pa.schema([("word", pa.binary()), ("ranks", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("words", pa.binary())])


def _cut_in_words(docs: DataFrame, ranks_path: str, pattern: str, flush_chars: int, dictionary_chars: int) -> DataFrame:
    """Rows of three kinds, in an order that only this task's next step relies on.

    A word row holds a word (pattern match) that the task has not met before, and the ranks of the
    pieces that occur in it. A text row follows the rows of its words: ids of documents, for each the
    count of its pieces of text, their numbers, and for each new piece of text the count and the
    numbers of its words. A row of nulls says that the numbers start again.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        occurring, match = _Occurring(read_ranks(ranks_path)), regex.compile(pattern).findall

        def rows(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _CUT], schema=_CUT)

        pieces, words = Numbers(), Numbers()
        ids: list[int | None] = []
        counts: list[int] = []
        numbers: list[bytes] = []
        size = held = 0

        def flush(fresh: list[str]) -> Iterator[pa.RecordBatch]:
            found = list(map(match, fresh))
            lengths, of_pieces = list(map(len, found)), list(map(words.__getitem__, chain.from_iterable(found)))
            new = [word.encode() for word in words.taken()]
            for at in range(0, len(new), 10_000):
                part = new[at : at + 10_000]
                yield rows(len(part), word=pa.array(part, pa.binary()), ranks=occurring.in_words(part))
            yield rows(1, ids=pa.array([ids], pa.list_(pa.int64())), **{name: pa.array([value], pa.binary()) for name, value in (("counts", _packed(counts)), ("numbers", b"".join(numbers)), ("lengths", _packed(lengths)), ("words", _packed(of_pieces)))})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                parts = safe_pieces(text)
                ids.append(doc_id)
                counts.append(len(parts))
                numbers.append(_packed(list(map(pieces.__getitem__, parts))))
                size += len(text)
                if size >= flush_chars:
                    held += sum(map(len, pieces.fresh))
                    yield from flush(pieces.taken())
                    ids, counts, numbers, size = [], [], [], 0
                    if held >= dictionary_chars:
                        yield rows(1)
                        pieces, words, held = Numbers(), Numbers(), 0
        if ids:
            yield from flush(pieces.taken())
        pieces = words = None
        pa.default_memory_pool().release_unused()  # the worker lives on, beside others

    return docs.mapInArrow(cut, "word binary, ranks array<int>, ids array<long>, counts binary, numbers binary, lengths binary, words binary")


def _folded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, flush_chars: int, dictionary_chars: int) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("body"))
    cut = _cut_in_words(rows, ranks_path, pattern, flush_chars, dictionary_chars)
    fold = F.get(F.transform(F.array(rank_literal(read_ranks(ranks_path))), lambda known: folded_symbols(F.col("word"), F.col("ranks"), known)), F.lit(0))
    return cut.select(fold.alias("symbols"), "ids", "counts", "numbers", "lengths", "words")


def _look_up(batches: Iterator[pa.RecordBatch], ranks_path: str) -> Iterator[pa.RecordBatch]:
    """Ids and token ids of documents, from the rows of ``_cut_in_words`` with their words folded."""
    codes = np.array(_codes(read_ranks(ranks_path)))
    rank_of_code = np.full(codes.max() + 1, -1, np.int32)
    rank_of_code[codes] = np.arange(len(codes))
    of_words, of_pieces = Runs(), Runs()

    def learn(symbols: pa.Array) -> None:
        sizes = pc.utf8_length(symbols).to_numpy()
        joined = "".join(symbols.to_pylist())
        of_words.add(rank_of_code[np.frombuffer(joined.encode("utf-32-le"), "<u4")], sizes)

    for batch in batches:
        is_text = np.flatnonzero(batch.column(0).is_null().to_numpy(zero_copy_only=False))
        begin = 0
        for at in [*is_text.tolist(), batch.num_rows]:
            if at > begin:
                learn(batch.column(0).slice(begin, at - begin))
            begin = at + 1
            if at == batch.num_rows:
                break
            if not batch.column(1)[at].is_valid:
                of_words, of_pieces = Runs(), Runs()
                continue
            ids = batch.column(1)[at].values
            counts, numbers, lengths, words = (np.frombuffer(batch.column(k)[at].as_buffer(), "<i4") for k in (2, 3, 4, 5))
            data, ends = of_words.take(words)
            of_pieces.add(data, np.diff(ends[np.r_[0, np.cumsum(lengths, dtype=np.int64)]]))
            data, ends = of_pieces.take(numbers)
            ends = ends[np.r_[0, np.cumsum(counts, dtype=np.int64)]]
            for first in range(0, len(ids), 1000):
                part = ends[first : first + 1001]
                listed = pa.ListArray.from_arrays(pa.array((part - part[0]).astype(np.int32)), pa.array(data[part[0] : part[-1]]))
                yield pa.RecordBatch.from_arrays([ids[first : first + 1000], listed], names=["id", "token_ids"])


def _decode(batches: Iterator[pa.RecordBatch], ranks_path: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """The batches with the last column, lists of ids, followed or replaced by the bytes of the text and of the ids."""
    vocabulary = read_ranks(ranks_path)
    letters = np.frombuffer(b"".join(vocabulary), np.uint8)
    places = np.r_[0, np.cumsum([len(piece) for piece in vocabulary], dtype=np.int64)]

    def decoded(ids: np.ndarray) -> bytes:
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(vocabulary):
            raise ValueError("an id is not in the vocabulary")
        # in parts, so that the places of the letters stay small
        return b"".join(gathered(letters, places, ids[at : at + (1 << 18)])[0].tobytes() for at in range(0, len(ids), 1 << 18))

    for batch in batches:
        texts, packed = [], []
        for value in batch.column(batch.num_columns - 1):
            if value.values is not None and value.values.null_count:
                raise ValueError("an id is null")
            ids = None if value.values is None else value.values.to_numpy(zero_copy_only=False)
            texts.append(None if ids is None else decoded(ids))
            packed.append(None if ids is None else ids.astype("<u4").tobytes())
        columns = batch.columns if keep_ids else batch.columns[:-1]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.binary()), pa.array(packed, pa.binary())], names=[*batch.schema.names[: len(columns)], "_decoded", "_packed"])


def encode_bpe(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", flush_chars: int = FLUSH_CHARS, dictionary_chars: int = DICTIONARY_CHARS) -> DataFrame:
    """One row per row of ``docs``: id and ``token_ids`` (array of int).

    Nothing is shuffled. Each task cuts its texts into words (pattern matches) and hands each distinct
    word on as a row of its bytes; Spark folds the ranked merges over them with the rank map as a
    constant; the texts, held as numbers of words, then become lookups in the same task. Words are
    distinct within a task, or within ``dictionary_chars`` of distinct text. Words of any length
    are folded. Special strings are ordinary text. Null and empty texts have no ids; null ids and
    repeated rows are kept; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    folded = _folded(docs, ranks_path, pattern, id_col, text_col, flush_chars, dictionary_chars)
    return folded.mapInArrow(lambda batches: _look_up(batches, ranks_path), "id long, token_ids array<int>").withColumnRenamed("id", id_col)


def decode_bpe(encoded: DataFrame, ranks_path: str, ids_col: str = "token_ids", keep_ids: bool = True) -> DataFrame:
    """``encoded`` with ``decoded`` (the ids' pieces joined, binary) and ``id_bytes`` (little-endian 32-bit ids).

    A null list decodes to null; an id outside the vocabulary, or a null one, raises. Without
    ``keep_ids`` the list itself is left out. Columns named as the results are replaced.
    """
    held = [c for c in encoded.columns if c not in ("decoded", "id_bytes", ids_col)]
    slim = encoded.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(held)], F.col(f"`{ids_col}`").alias("_ids"))
    fields = slim.schema.fields if keep_ids else slim.schema.fields[:-1]
    out = slim.mapInArrow(lambda batches: _decode(batches, ranks_path, keep_ids), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ("," if fields else "") + " _decoded binary, _packed binary")
    listed = [F.col("_ids").alias(ids_col)] if keep_ids else []
    return out.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(held)], *listed, F.col("_decoded").alias("decoded"), F.col("_packed").alias("id_bytes"))


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, decode and digest: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids are decoded in the step that looks them up, which spares each task a third Python worker.
    """
    folded = _folded(docs, ranks_path, pattern, "doc_id", "text", FLUSH_CHARS, DICTIONARY_CHARS)
    decoded = folded.mapInArrow(lambda batches: _decode(_look_up(batches, ranks_path), ranks_path, keep_ids=False), "doc_id long, decoded binary, id_bytes binary")
    n_tokens = (F.octet_length("id_bytes") / 4).cast("long")
    return decoded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("id_bytes", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
