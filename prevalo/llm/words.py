"""Words of ASCII letters, digits and all other characters beyond ASCII, as bytes; A-Z count as a-z."""

from __future__ import annotations

from collections.abc import Iterator

#: What is left of each byte: letters in lower case, digits and bytes of longer characters; anything else divides words.
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 19


def word_lists(text: bytes | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text in order, in lists of those of about ``piece`` bytes."""
    if not text:
        return
    if len(text) <= piece:
        yield text.translate(KEPT).split()
        return
    plain = text.translate(KEPT)
    start = 0
    while start < len(plain):
        stop = plain.find(b" ", start + piece)
        stop = len(plain) if stop < 0 else stop
        yield plain[start:stop].split()
        start = stop
