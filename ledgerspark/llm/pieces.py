"""Cuts texts where byte-level BPE's pre-tokens must end, and remembers what each part encodes to.

No pre-token crosses a place before a space that a non-space follows. So a text splits there into parts, most of them
words that come again and again, and a bounded memory of parts does most of the work. Texts with white space of other
kinds than single spaces and line ends between words are one part as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

ODD = re.compile(r" \s| \Z|[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
MOST, LONG = 500_000, 100
CHARS = 2 << 20


def parts(text: str) -> list[str]:
    """The parts of a text; all but the first lack the space that they begin with, see whole()."""
    return [text] if ODD.search(text) else text.split(" ")


class Memory:
    """What encode gives for parts; forgets all when it holds MOST. encode takes a list of strings."""

    def __init__(self, encode: Callable[[list[str]], list], most: int = MOST):
        self.encode, self.most = encode, most
        self.first: dict[str, object] = {}
        self.rest: dict[str, object] = {}
        self.passing: list[tuple[dict, str]] = []

    def learn(self, split: list[list[str]]) -> None:
        for known, x in self.passing:  # long parts hardly come again
            known.pop(x, None)
        self.passing = []
        if len(self.first) > self.most:
            self.first.clear()
        if len(self.rest) > self.most:
            self.rest.clear()
        first, rest = set(), set()
        for p in split:
            first.add(p[0])
            rest.update(p[1:])
        for known, new, lead in ((self.first, first - self.first.keys(), ""), (self.rest, rest - self.rest.keys(), " ")):
            new = list(new)
            if new:
                known.update(zip(new, self.encode([lead + x for x in new]), strict=True))
                self.passing += [(known, x) for x in new if len(x) > LONG]

    def look_up(self, p: list[str]) -> list:
        found = list(map(self.rest.__getitem__, p[1:]))
        found.insert(0, self.first[p[0]])
        return found


def by_chars(texts: list[str], most: int = CHARS):
    """Slices of the texts of about `most` characters."""
    i = n = 0
    for j, t in enumerate(texts):
        if n and n + len(t) > most:
            yield texts[i:j]
            i, n = j, 0
        n += len(t)
    if i < len(texts):
        yield texts[i:]
