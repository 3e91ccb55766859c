"""Words of whole texts, a bounded piece of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

# Bytes of text whose words are held together.
TEXT_AT_ONCE = 4_000_000


def word_lists(raw: bytes | None, table: bytes, at_once: int = TEXT_AT_ONCE) -> Iterator[list[bytes]]:
    """Words of a text after a byte translation that makes blanks of all separators."""
    text = (raw or b"").translate(table)
    at = 0
    while at < len(text):
        end = at + at_once
        if end < len(text):
            cut = text.find(b" ", end)
            end = len(text) if cut < 0 else cut
        yield text[at:end].split()
        at = end
