"""Cuts that no token of a byte-level BPE crosses.

A pre-token either consists of white space or holds at most one blank, at its start. So no
pre-token goes on from a character that is not white space to one that is: a text may be
cut there, and each piece encoded by itself, with the same tokens as the whole. Nor does one go on from a letter
to a character that is no letter, mark or apostrophe, or from a digit to one that is none: long pieces are cut there too.
A run of letters alone is one pre-token and stays whole.
"""

from __future__ import annotations

import re

import regex

#: White space beside a blank, or a blank at the end: a cut at each blank isn't safe then. Python's \s holds all Unicode white space, and more.
_BESIDE = re.compile(r"\s |  |  ?\s| $|^ ")
_PIECE = regex.compile(r"\p{White_Space}*\P{White_Space}+|\p{White_Space}+")

#: Pieces with more characters are cut within.
LONG = 4096
_WITHIN = regex.compile(r"(?<=\p{L})(?=[^\s\p{L}\p{M}'\u2019])|(?<=\p{N})(?=[^\s\p{N}])", regex.V1)


def whole_pieces(text: str) -> list[str]:
    own = _PIECE.findall(text)
    return within(own) if len(text) > LONG else own


def within(own: list[str]) -> list[str]:
    """Pieces with the long ones cut; each but the first of a cut piece starts with neither a blank nor other white space."""
    if max(map(len, own), default=0) <= LONG:
        return own
    return [y for x in own for y in ([x] if len(x) <= LONG else _WITHIN.split(x))]


def plain_pieces(text: str) -> list[str] | None:
    """The pieces of a text in which every blank is a safe cut, each but the first without the blank that it starts with; None for other texts and where a piece is long."""
    if _BESIDE.search(text):
        return None
    own = text.split(" ")
    return None if len(text) > LONG and max(map(len, own)) > LONG else own


def all_pieces(text: str) -> list[str]:
    """The pieces of a text, in order and with their white space; joined they are the text."""
    if not text:
        return []
    own = plain_pieces(text)
    return whole_pieces(text) if own is None else [own[0], *[" " + x for x in own[1:]]]
