"""Texts as pieces whose tokens don't depend on what stands around them."""

from __future__ import annotations

import re

#: A space before a character that is no white space always begins a pre-token of byte-level BPE patterns.
_ODD_SPACE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")


def pieces(text: str) -> list[str]:
    """The text cut at such spaces; the first piece is as it stands, each other follows one space."""
    return _CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")
