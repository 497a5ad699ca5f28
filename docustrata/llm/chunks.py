"""Cutting texts at white space so that each distinct chunk is encoded once per worker.

Byte-level patterns never join a run of non-space characters with what follows it, and take at most one
space before it. So the ids of a text are those of its chunks: ``' '`` + run where a run follows exactly
one space, and the text's own first run. Texts with other white space before a run are cut by a pattern.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import regex

_CHUNK = regex.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Bytes of chunks and values a worker remembers before it starts anew, an entry counting ENTRY besides its text; bounds its memory, not what is encoded.
REMEMBERED, ENTRY = 96 << 20, 200


class Chunks:
    """Remembers what ``encode`` (a list of strings to a list of values) gave for each chunk."""

    def __init__(self, encode: Callable[[list[str]], list], remembered: int = REMEMBERED):
        self.encode, self.remembered, self.held, self.known = encode, remembered, 0, {}

    def values(self, texts: list[str]) -> Iterable[list]:
        """For each text, the values of its chunks, in order."""
        cut = []
        for t in texts:
            parts = t.split(" ")
            cut.append(parts)
        keys = set()
        for parts in cut:
            keys.update(parts)
        known = self.known
        if self.held > self.remembered:
            known.clear()
            self.held = 0
        odd = {k for k in keys if not k or (k[0].isspace() and k not in known)}
        new = [k for k in keys if k not in known and k not in odd]
        known.update(zip(new, self.encode([" " + k for k in new]), strict=True))
        self.held += ENTRY * len(new) + sum(map(len, new))
        for t, parts in zip(texts, cut, strict=True):
            if odd and not odd.isdisjoint(parts):
                yield self._by_pattern(t)
            else:
                yield [*self._of([parts[0]]), *map(known.__getitem__, parts[1:])]

    def _by_pattern(self, text: str) -> list:
        return self._of(_CHUNK.findall(text))

    def _of(self, chunks: list[str]) -> list:
        """Of whole chunks, with their leading space if any; kept apart from the others by a mark."""
        known = self.known
        new = [c for c in dict.fromkeys(chunks) if (c, 0) not in known]
        if new:
            known.update(zip(((c, 0) for c in new), self.encode(new), strict=True))
            self.held += ENTRY * len(new) + sum(map(len, new))
        return [known[c, 0] for c in chunks]
