"""Byte-level BPE as a lazily determinised finite-state transducer.

A piece of text has exactly one sequence of tokens in which every neighbouring
pair is one that the merges leave apart.  So reading left to right, every prefix
has one last token, found from the tokens ending there and the last token before
each of them.  A position stays open while some longer token could still start at
it.  The open positions, each with the token that ends at it and the place in the
token trie that the bytes since lead to, make up a state; a move outputs the last
token of the prefix it completes.  The ways back from all open positions meet
within a bounded distance, and what lies before is settled and emitted.  States
and moves are built when first met, up to a bound.  A piece that needs one beyond it
is followed to its end without states: its open positions are those that the longest
of them has behind it (suffix links of the trie), so that one alone is carried on.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

_ROOT = 0
#: An open position packs its last token, plus one, above the place in the trie, which has room for a byte below.
_LAST, _PLACE = 32, (1 << 32) - 1
#: What the trie's entries say of a place in their lowest bits: a token ends there, and some go on.
_ENDS, _GOES_ON = 1, 2
#: Halves of a token that merges never make.
_NEVER = (-1, -1)
#: A move packs the next state and the token; ranks are below this.
_TOKENS = 1 << 20
#: Bytes of a piece after which settled tokens are emitted.
_WINDOW = 1024


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes and ranks from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = 80_000):
        if max(ranks.values(), default=0) >= _TOKENS:
            raise ValueError("a rank is too large to be packed into a move")
        self.ranks = ranks
        self.most_states = most_states
        self.text = {rank: token for token, rank in ranks.items()}
        # What each step looks up is flat, as scattered objects cost more than the work on them.
        self.packed = [struct.pack("<I", rank) for rank in range(max(self.text, default=-1) + 1)]
        self.length = [len(self.text.get(rank, b"")) for rank in range(len(self.packed))]
        places: dict[int, int] = {}
        self.token = [-1]
        self.depth = [0]
        goes_on = [False]
        for token, rank in ranks.items():
            node = _ROOT
            for byte in token:
                key = node << 8 | byte
                if key not in places:
                    places[key] = len(self.token)
                    goes_on[node] = True
                    self.token.append(-1)
                    self.depth.append(self.depth[node] + 1)
                    goes_on.append(False)
                node = places[key]
            self.token[node] = rank
        self.child = {key: node << 8 | _ENDS * (self.token[node] >= 0) | _GOES_ON * goes_on[node] for key, node in places.items()}
        self._link()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.apart: dict[int, bool] = {}
        start = (_ROOT << 8,)
        self.states: list[tuple[int, ...]] = [start]
        self.number = {start: 0}
        self.moves: dict[int, int] = {}

    def _link(self) -> None:
        """Suffix links of the trie, and the tokens that end at each place, longest first."""
        self.shorter = [_ROOT] * len(self.token)
        self.ending: list[tuple[int, ...]] = [()] * len(self.token)
        # A shorter suffix is nearer to the root, so its entries are ready when places are taken by depth.
        for key, place in sorted(self.child.items(), key=lambda x: self.depth[x[1] >> 8]):
            node, link = place >> 8, key >> 8
            if link != _ROOT:
                byte = key & 255
                link = self.shorter[link]
                while (found := self.child.get(link << 8 | byte)) is None and link != _ROOT:
                    link = self.shorter[link]
                self.shorter[node] = _ROOT if found is None else found >> 8
            behind = self.ending[self.shorter[node]]
            self.ending[node] = (self.token[node], *behind) if self.token[node] >= 0 else behind

    def _split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte.

        A token that the merges of its own bytes don't lead to is never part of a
        longer result, which its halves (-1, -1) say.
        """
        if rank not in self.halves:
            parts = merged(self.text[rank], self.ranks, rank)
            self.halves[rank] = None if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else _NEVER
        return self.halves[rank]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges never join anything across the border of two tokens (-1: the piece's start); kept for later.

        The later of the two was completed last, so the border is followed back in
        time: at each step the token made later is taken apart, and a merge across
        the border that would have come before that step rules the pair out.
        """
        if len(self.apart) > 400_000:
            self.apart.clear()
        known = self._split(right) != _NEVER if left < 0 else self._stay_apart(left, right)
        self.apart[left + 1 << 24 | right] = known
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        if self._split(left) == _NEVER or self._split(right) == _NEVER:
            return False
        before = len(self.text) + 1 + max(left, right)
        while True:
            joined = self.ranks.get(self.text[left] + self.text[right])
            if joined is not None and joined < before:
                return False
            a, b = self._split(left), self._split(right)
            if a is None and b is None:
                return True
            # Equal ranks merge from the left, so a merge on the right also comes after its equal on the border.
            if b is None or a is not None and left > right:
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]

    def _move(self, state: int, byte: int) -> int:
        """The next state, with room for a byte below, and the last token of the prefix that ends with ``byte``, packed."""
        child, apart, out, found = self.child.get, self.apart.get, [], -1
        for position in self.states[state >> 8]:
            place = child(position & _PLACE | byte)
            if place is not None:
                if found < 0 and place & _ENDS:
                    ends, last = self.token[place >> 8], position >> _LAST
                    fits = apart(last << 24 | ends)
                    if self.stay_apart(last - 1, ends) if fits is None else fits:
                        found = ends
                if place & _GOES_ON:
                    out.append(position >> _LAST << _LAST | place >> 8 << 8)
        if found < 0:
            raise ValueError("the ranks lack a single byte")
        out.append(found + 1 << _LAST)
        key = tuple(out)
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state | byte] = number * (_TOKENS << 8) + found
        return move

    def _settled(self, places: Iterable[int], lasts: list[int]) -> int:
        """Up to where the tokens are the same whatever follows: where the ways back from all open positions meet."""
        ends = sorted({len(lasts) - self.depth[place] for place in places})
        while len(ends) > 1:
            end = ends.pop()
            before = end - self.length[lasts[end - 1] & _TOKENS - 1]
            if before not in ends:
                ends.append(before)
                ends.sort()
        return ends[0]

    def _places(self, node: int) -> Iterator[int]:
        """The places of all open positions, from that of the longest."""
        while node != _ROOT:
            yield node
            node = self.shorter[node]
        yield _ROOT

    def _follow(self, node: int, lasts: list[int], head: int, part: bytes) -> int:
        """Adds the last token of each prefix that ends in ``part`` and gives the place then; ``head``: the token before ``lasts``, plus one."""
        child, shorter, ending, length, apart = self.child.get, self.shorter, self.ending, self.length, self.apart.get
        at = len(lasts)
        for byte in part:
            at += 1
            place = child(node << 8 | byte)
            while place is None:
                if node == _ROOT:
                    raise ValueError("the ranks lack a single byte")
                node = shorter[node]
                place = child(node << 8 | byte)
            node = place >> 8
            for token in ending[node]:
                before = at - length[token]
                last = (lasts[before - 1] & _TOKENS - 1) + 1 if before else head
                fits = apart(last << 24 | token)
                if self.stay_apart(last - 1, token) if fits is None else fits:
                    lasts.append(token)
                    break
            else:
                raise ValueError("the ranks lack a single byte")
        return node

    def _back(self, lasts: list[int], end: int) -> bytes:
        out, length, packed = [], self.length, self.packed
        while end > 0:
            token = lasts[end - 1] & _TOKENS - 1
            out.append(packed[token])
            end -= length[token]
        out.reverse()
        return b"".join(out)

    def piece(self, piece: bytes) -> bytes:
        """Ids of one match of the splitting pattern, as little-endian 32-bit integers."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return self.packed[whole]
        state, lasts, done, known, node, head = 0, [], [], self.moves.get, -1, 0
        keep = lasts.append
        for low in range(0, len(piece), _WINDOW):
            part = piece[low : low + _WINDOW]
            if node < 0:
                for n, byte in enumerate(part):
                    move = known(state | byte)
                    if move is None:
                        if len(self.states) >= self.most_states:
                            node, part = (self.states[state >> 8][0] & _PLACE) >> 8, part[n:]
                            break
                        move = self._move(state, byte)
                    state = move >> 20
                    keep(move)
            if node >= 0:
                node = self._follow(node, lasts, head, part)
            if low + _WINDOW < len(piece):
                places = [(position & _PLACE) >> 8 for position in self.states[state >> 8]] if node < 0 else self._places(node)
                end = self._settled(places, lasts)
                done.append(self._back(lasts, end))
                if end:
                    head = (lasts[end - 1] & _TOKENS - 1) + 1
                del lasts[:end]
        return b"".join([*done, self._back(lasts, len(lasts))])


def merged(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The piece after all merges of a rank less than ``below``, lowest and leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Utf8Stream:
    """Incremental UTF-8: takes bytes in any cut and gives back whole characters.

    The state is the started character, at most three bytes.  Bytes that cannot
    continue it are passed on, so that nothing is lost.
    """

    def __init__(self) -> None:
        self.started = b""

    def feed(self, data: bytes) -> bytes:
        data = self.started + data
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                needs = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                cut = len(data) - back if back < needs else len(data)
                break
            if byte < 0x80:
                cut = len(data)
                break
        else:
            cut = len(data)
        self.started = data[cut:]
        return data[:cut]

    def close(self) -> bytes:
        rest, self.started = self.started, b""
        return rest


class _Pieces(dict):
    """Pieces met before, the latest ``most`` and up to as many before those; pieces that come again stay."""

    def __init__(self, fst: Transducer, most: int):
        super().__init__()
        self.fst, self.most, self.older = fst, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.fst.piece(piece.encode())
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for one set of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = 160_000):
        import regex

        self.fst = Transducer(ranks)
        self.split = regex.compile(pattern)
        self.pieces = _Pieces(self.fst, most_pieces)
        self.tokens = [self.fst.text.get(i, b"") for i in range(max(self.fst.text) + 1)]
        self.column = pa.array(self.tokens, pa.binary())

    def encode(self, text: str) -> bytes:
        """All ids of a text, as little-endian unsigned 32-bit integers."""
        if len(text) < 1 << 18:
            return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))
        return b"".join(self.pieces[m.group()] for m in self.split.finditer(text))

    def decode_texts(self, texts: list[bytes]) -> pa.Array:
        """The bytes of each text's ids, which are as ``encode`` gives them; tokens are gathered by one take."""
        ids = np.frombuffer(b"".join(texts), "<u4")
        if not len(ids):
            return pa.array([b""] * len(texts), pa.binary())
        _, ends, data = self.column.take(pa.array(ids)).buffers()
        first = np.append(0, np.cumsum([len(x) // 4 for x in texts]))
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.frombuffer(ends, np.int32)[first]), data])

    def decode_stream(self, ids: Iterable[int], block: int = 1 << 16) -> Iterator[bytes]:
        """The bytes of the ids in blocks, each of whole characters."""
        stream, ids = Utf8Stream(), iter(ids)
        from itertools import islice

        while chunk := list(islice(ids, block)):
            yield stream.feed(b"".join(map(self.tokens.__getitem__, chunk)))
        yield stream.close()
