"""Words of letters, digits and everything beyond ASCII, as UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

#: ASCII letters lower-cased; digits and bytes of longer characters as they are; the rest are gaps.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A text is split in pieces of about so many bytes, so that a very long one does not stand in memory as a list of words.
PIECE_BYTES = 1 << 20


def word_lists(text: str | None, overlap: int = 0, piece_bytes: int | None = None) -> Iterator[tuple[list[bytes], int]]:
    """The words of a whole text in lists, each after the last ``overlap`` words before it: (words, how many of them are repeats)."""
    piece_bytes = piece_bytes or PIECE_BYTES
    data, at, carry = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD), 0, []
    while at < len(data):
        end = len(data)
        if end - at > piece_bytes:
            end = data.rfind(b" ", at, at + piece_bytes)
            if end <= at:
                end = data.find(b" ", at + piece_bytes)
            if end < 0:
                end = len(data)
        words = carry + data[at:end].split()
        if len(words) > len(carry):
            yield words, len(carry)
        carry = words[-overlap:] if overlap else []
        at = end
