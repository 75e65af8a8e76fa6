"""Exact comparison of the windows of a block of phrases, three ways."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from gainset.llm import arrays


def _key(window: bytes) -> tuple[int, int]:
    both = np.frombuffer(blake2b(window, digest_size=16).digest(), np.int64)
    return int(both[0]), int(both[1])


def suffix_ranks(key: np.ndarray, depth: int, left: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes of terminated sequences, by prefix doubling.

    ``key`` orders the first ``depth`` symbols from each position, ``left`` says how
    many there are up to the terminator.  A rank is the number of smaller suffixes, so
    equal suffixes have equal ranks, and each round sorts only suffixes that had an equal.
    """
    n = len(key)
    rank, tied, groups = np.zeros(n, np.int64), np.arange(n), 0
    while len(tied):
        order = np.argsort(key)
        tied, key, old = tied[order], key[order], rank[tied[order]]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        if len(first) == groups:  # no suffix was told from its equals, nor will be
            break
        # Those of one rank stay together; each gets that rank and the number of smaller ones among them.
        begin = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), np.arange(len(old)), 0))
        sizes = np.diff(np.append(first, len(key)))
        rank[tied] = np.repeat(old[first] + first - begin[first], sizes)
        # A suffix that ends within the depth has equals that end there too.
        tied = tied[np.repeat(sizes > 1, sizes)]
        tied = tied[left[tied] > depth]
        old = rank[tied]
        groups = int((old[1:] != old[:-1]).sum()) + 1
        key, depth = old * n + rank[tied + depth], 2 * depth
    return rank


def _terminated(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where sequences of these lengths begin if each has a terminator after it, and what is left from each position, it included."""
    begin = np.cumsum(lengths + 1) - (lengths + 1)
    total = int((lengths + 1).sum())
    return begin, np.repeat(begin + lengths + 1, lengths + 1) - np.arange(total)


class SuffixArray:
    """Order of the suffixes of a shard's strings by prefix-free parsing.

    Rolling hashes of ``TRIGGER`` bytes cut the strings into phrases that end with the
    next one's trigger.  The dictionary of distinct phrases and the parse, the strings
    as sequences of dictionary ranks, each get a suffix array.  A suffix is the rest of
    its phrase and what follows it in the parse, so the two ranks together give the
    order of all suffixes, without sorting the text itself.  Neighbours in that order
    are then compared byte by byte over ``length`` bytes.
    """

    TRIGGER = 8
    #: A place in so many is a trigger.
    EVERY = 32

    def __init__(self, length: int):
        self.length = length

    def window_key(self, phrase: bytes, start: int) -> tuple[int, int]:
        return _key(phrase[start : start + self.length])

    def parse(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the phrases, and the first phrase of each string."""
        ends = np.repeat(offsets[1:], np.diff(offsets))
        hashed = arrays.Spans(arrays.byte_symbols(data)).grams(self.TRIGGER)
        at = np.flatnonzero(hashed % np.uint64(self.EVERY) == 0)
        at = at[at + self.TRIGGER <= ends[at]]
        starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], at)
        own_end = ends[starts]
        stop = np.append(starts[1:], len(data)) + self.TRIGGER
        stop = np.where(np.append(starts[1:], len(data)) < own_end, np.minimum(stop, own_end), own_end)
        return starts, stop, np.searchsorted(starts, offsets)

    def dictionary(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each phrase, where each distinct phrase begins in the dictionary, and the suffix ranks of that."""
        hashed = arrays.Spans(arrays.byte_symbols(data)).hash(starts, stops)
        _, one, number = np.unique(hashed, return_index=True, return_inverse=True)
        lengths = (stops - starts)[one]
        begin, left = _terminated(lengths)
        symbols = np.zeros(len(left), np.uint64)
        filled = left > 1
        symbols[filled] = data[np.repeat(starts[one], lengths) + (np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths))] + np.uint64(1)
        depth = 7  # symbols of nine bits in the first keys
        key, padded = np.zeros(len(left), np.uint64), np.concatenate([symbols, np.zeros(depth, np.uint64)])
        for i in range(depth):
            key = key << np.uint64(9) | np.where(left > i, padded[i : i + len(left)], np.uint64(0))
        return number, begin, suffix_ranks(key, depth, left)

    def order(self, data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The positions ``at`` in the order of the suffixes from there to the ends of their strings."""
        return at[self.places(data, offsets, at)]

    def places(self, data: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where in ``at`` the positions are, in that order; those of equal suffixes in any."""
        starts, stops, first = self.parse(data, offsets)
        number, begin, ranks = self.dictionary(data, starts, stops)
        counts = np.diff(first)
        place, left = _terminated(counts)
        symbols = np.zeros(len(left), np.int64)
        own = np.arange(len(starts)) + np.repeat(np.arange(len(counts)), counts)  # each string before has a terminator
        symbols[own] = ranks[begin[number]] + 1
        parsed = suffix_ranks(symbols, 1, left)
        phrase = np.searchsorted(starts, at, "right") - 1
        rest = ranks[begin[number[phrase]] + at - starts[phrase]]
        return np.argsort(rest * (len(parsed) + 1) + parsed[own[phrase] + 1])

    def _same(self, data: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether ``length`` bytes from p and from q are the same."""
        width = 1 << min(3, self.length.bit_length() - 1)
        words = np.ndarray(len(data) - width + 1, f"u{width}", np.ascontiguousarray(data), strides=(1,))
        same, left = np.zeros(len(p), bool), np.arange(len(p))
        for i in [self.length - width, *range(0, self.length - width, width)]:
            equal = words[p + i] == words[q + i]
            if not equal.all():
                left, p, q = left[equal], p[equal], q[equal]
        same[left] = True
        return same

    def __call__(self, phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in phrases])
        counts = np.maximum(lengths - self.length + 1, 0)
        row = np.repeat(np.arange(len(phrases)), counts)
        start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        number = np.zeros(len(row), np.int64)
        if len(row):
            data, offsets = np.frombuffer(b"".join(phrases), np.uint8), np.append(0, np.cumsum(lengths))
            at = offsets[row] + start
            places = self.places(data, offsets, at)
            sorted_at = at[places]
            fresh = np.append(True, ~self._same(data, sorted_at[1:], sorted_at[:-1]))
            number[places] = np.cumsum(fresh)
        return row, start, number


class _Split:
    """Windows of units with a separator between them."""

    def __init__(self, length: int, glue: bytes):
        self.length, self.glue = length, glue

    def _windows(self, phrase: bytes) -> list[bytes]:
        cuts, at = [0], phrase.find(self.glue)
        while at >= 0:
            cuts.append(at + 1)
            at = phrase.find(self.glue, at + 1)
        cuts.append(len(phrase) + 1)
        return [phrase[cuts[i] : cuts[i + self.length] - 1] for i in range(len(cuts) - self.length)]

    def window_key(self, phrase: bytes, start: int) -> tuple[int, int]:
        return _key(self._windows(phrase)[start])


class Lines(_Split):
    """Windows of lines, compared as they are."""

    def __init__(self, length: int):
        super().__init__(length, b"\n")

    def __call__(self, phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        number: dict[bytes, int] = {}
        out = [(r, i, number.setdefault(w, len(number))) for r, p in enumerate(phrases) for i, w in enumerate(self._windows(p))]
        return tuple(np.array(out, np.int64).reshape(-1, 3).T)


class Automaton(_Split):
    """Windows of words: passages that recur form an Aho-Corasick automaton, which finds all their places.

    Counts of hashes say which windows are worth a pattern; which places hold one, and
    so which windows are equal, is what the automaton finds in the streamed text.
    """

    def __init__(self, length: int):
        super().__init__(length, b" ")

    def __call__(self, phrases: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = b"".join(phrases)
        data, offsets = np.frombuffer(raw, np.uint8), np.append(0, np.cumsum([len(p) for p in phrases])).astype(np.int64)
        starts, ends, first = arrays.words(data, offsets)
        counts = np.maximum(np.diff(first) - self.length + 1, 0)
        row = np.repeat(np.arange(len(phrases)), counts)
        start = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        word = first[row] + start
        number = np.arange(len(row)) + len(row)
        spans = arrays.Spans(arrays.Spans(arrays.byte_symbols(data)).hash(starts, ends) | np.uint64(1))
        _, one, times = np.unique(spans.hash(word, word + self.length), return_index=True, return_counts=True)
        passages = one[times > 1]
        if len(passages):
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, (low, high) in enumerate(zip(starts[word[passages]].tolist(), ends[word[passages] + self.length - 1].tolist(), strict=True)):
                automaton.add_word(f" {raw[low:high].decode('latin-1')} ", (i, high - low))
            automaton.make_automaton()
            found = [(offset + end - length - 1, i) for offset, phrase in zip(offsets.tolist(), phrases) for end, (i, length) in automaton.iter(f" {phrase.decode('latin-1')} ")]
            at, which = np.array(found, np.int64).reshape(-1, 2).T
            number[np.searchsorted(word, np.searchsorted(starts, at))] = which
        return row, start, number
