"""Texts to units that a byte-level BPE encodes independently of each other.

The pre-tokenizer's pattern lets a piece take at most one space in front of a run
of other characters, so no piece crosses a space between two characters that are
not white space.  A unit ends there, and also where a run of common letters is
followed by an ASCII character that is neither a letter nor an apostrophe: the
piece ends at that point in any case.  Units repeat far more often than texts, so
their ids are remembered.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# white space of the pre-tokenizer's pattern (Unicode White_Space)
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
_AFTER = r"(?=[\x00-&(-@\[-`{-\x7f]|\Z)"
UNIT = re.compile(
    f" ?[{_LETTERS}]++{_AFTER}|[ ]?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
)
# a unit that is one piece
LETTERS = re.compile(f" ?[{_LETTERS}]+")
# units remembered by one Python worker, in each of two generations
REMEMBERED = 250_000


class UnitMemory(dict):
    """Packed ids (little-endian unsigned 32-bit) by unit.

    When it is full it becomes the older generation, from which units that occur
    again return; what was not asked for in the meantime is forgotten.
    """

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.older.get(unit)
        if ids is None:
            ids = self.encode(unit)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[unit] = ids
        return ids

    def packed(self, text: str, special: dict[str, bytes]) -> bytes:
        """Ids of a whole text; ``special`` strings stand for themselves."""
        for token, ids in special.items():
            if token in text:
                rest = {t: i for t, i in special.items() if t != token}
                return ids.join([self.packed(part, rest) for part in text.split(token)])
        return b"".join(map(self.__getitem__, UNIT.findall(text)))
