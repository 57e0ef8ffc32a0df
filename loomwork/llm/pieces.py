"""Cutting text for byte-level tokenizers, by their pattern and, where that gives the same, at single spaces first.

The pattern's pieces never run over a space that stands after or before something that isn't white space: such a space
begins a piece. A text in which every space is like that can be cut at its spaces, which is much faster than matching,
and what stands between two of them recurs."""

from __future__ import annotations

from functools import cache

import regex

#: Fixed value: how the public byte-level tokenizers cut text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Of the other white space, those within ASCII, which come first.
ASCII_SPACES = 4


@cache
def other_spaces() -> list[str]:
    """White space but the space and the line feed."""
    space = regex.compile(r"\s")
    return [chr(c) for c in range(0x3001) if chr(c) not in " \n" and space.match(chr(c))]


def splits(text: str) -> bool:
    """Whether no space stands between white space, or between white space and the text's end."""
    if "   " in text or "\n  " in text or "  \n" in text or "\n \n" in text or text[-2:] in ("\n ", "  "):
        return False
    spaces = other_spaces()
    return not any(c in text for c in (spaces[:ASCII_SPACES] if text.isascii() else spaces))
