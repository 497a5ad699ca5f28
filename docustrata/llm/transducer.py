"""Byte-pair merges compiled into a lazily determinised finite-state transducer, and streaming decode.

A sequence of tokens is what the merges produce exactly if every two neighbours are: merging the bytes
of both gives the two back. So the encoding of each prefix is one longer token after the encoding of
some shorter prefix. A state of the transducer holds, for every start from which a token may still
grow, the token that ends there and the place in the token trie; a start is dropped when no token
continues from it. A move writes the one token that ends at the new byte. The chains that lead to the
open starts meet within the longest tokens' reach, and what lies before that point is final: it is
emitted after this bounded lookahead, or at the end of the piece. States and moves are made when a
text first needs them and kept up to a bound.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

#: States kept before the table is started anew (bounds memory only).
STATES = 400_000
#: Bytes read between two emissions within one piece.
EMIT = 1024


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.at: list[int] = [-1]
        self.depth: list[int] = [0]
        for t, i in ranks.items():
            node = 0
            for b in t:
                nxt = self.trie[node].get(b)
                if nxt is None:
                    nxt = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.at.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = nxt
            self.at[node] = i
        self.length = {i: len(t) for t, i in ranks.items()}
        self.whole: dict[int, bool] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.start = self._intern(((-1, 0),))

    def _intern(self, state: tuple) -> int:
        i = self.ids.get(state)
        if i is None:
            i = self.ids[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return i

    def merge(self, piece: bytes) -> list[int]:
        """The merges applied one by one, lowest rank first: defines which tokens may stand side by side."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank == 1 << 40:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _reachable(self, t: int) -> bool:
        ok = self.whole.get(t)
        if ok is None:
            ok = self.whole[t] = self.merge(self.token[t]) == [t]
        return ok

    def _follows(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            ok = self.pairs[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return ok

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        alive, done = [], -1
        for last, node in self.states[state]:
            node = self.trie[node].get(byte)
            if node is None:
                continue
            t = self.at[node]
            if done < 0 and t >= 0 and self._reachable(t) and self._follows(last, t):
                done = t
            if self.trie[node]:
                alive.append((last, node))
        alive.append((done, 0))
        move = self.moves[state][byte] = (self._intern(tuple(alive)), done)
        return move

    def _final(self, state: int, ends: list[int]) -> int:
        """How many bytes lie before the point where the chains to all open starts meet."""
        at = {len(ends) - self.depth[node] for _, node in self.states[state]}
        while len(at) > 1:
            last = max(at)
            at.remove(last)
            at.add(last - self.length[ends[last - 1]])
        return at.pop()

    def stream(self, piece: bytes, every: int = EMIT) -> Iterator[list[int]]:
        """Ids of one piece, a part whenever ``every`` more bytes were read."""
        if len(self.states) > STATES:
            self._restart()
        state, ends, moves, length = self.start, [], self.moves, self.length
        for b in piece:
            move = moves[state].get(b)
            if move is None:
                move = self._move(state, b)
            state, t = move
            ends.append(t)
            if len(ends) >= every and (n := self._final(state, ends)):
                yield self._trace(ends, n)
                del ends[:n]
        yield self._trace(ends, len(ends))

    def _trace(self, ends: list[int], at: int) -> list[int]:
        out = []
        while at:
            t = ends[at - 1]
            out.append(t)
            at -= self.length[t]
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece; a piece that is a token is that token."""
        if (t := self.ranks.get(piece)) is not None:
            return [t]
        return [t for part in self.stream(piece) for t in part]


class Utf8:
    """An incremental UTF-8 state machine: how many bytes the character begun still needs."""

    def __init__(self):
        self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, 0

    def step(self, b: int) -> bool:
        """Takes one byte; whether a character, or an invalid byte by itself, ends here."""
        if self.need and self.low <= b <= self.high:
            self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
            self.held = self.held + 1 if self.need else 0
            return not self.need
        self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, 0
        if 0xC2 <= b <= 0xF4:
            self.need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            self.held = 1
            self.low = 0xA0 if b == 0xE0 else 0x90 if b == 0xF0 else 0x80
            self.high = 0x9F if b == 0xED else 0x8F if b == 0xF4 else 0xBF
            return False
        return True


def open_tail(data: bytes) -> int:
    """Bytes at the end of ``data`` that begin a character and may still be completed."""
    machine = Utf8()
    at = max(0, len(data) - 3)
    while at < len(data) and 0x80 <= data[at] <= 0xBF:
        at += 1
    for b in data[at:]:
        machine.step(b)
    return machine.held


def decode_stream(ids: Iterable[int], token: dict[int, bytes], every: int = 4096) -> Iterator[bytes]:
    """Bytes of whole characters as ids arrive; what is open at the end comes last, as it is."""
    tail, part = b"", []
    for i in ids:
        part.append(token[i])
        if len(part) == every:
            data = tail + b"".join(part)
            n = len(data) - open_tail(data)
            yield data[:n]
            tail, part = data[n:], []
    if data := tail + b"".join(part):
        yield data
