"""Words of whole texts as bytes, a block at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Letters and digits of ASCII and everything beyond it, in lower-cased UTF-8.
WORD, GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of a block; a word is never cut.
BLOCK = 1 << 20


def word_blocks(text: bytes, block: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in lists of about ``block`` bytes, so that a long text makes no long list."""
    text, at = text.lower(), 0  # of bytes, only A-Z change
    while at < len(text):
        gap = GAP.search(text, at + block)
        end = gap.start() if gap else len(text)
        yield WORD.findall(text, at, end)
        at = end
