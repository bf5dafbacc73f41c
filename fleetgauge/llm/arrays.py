"""Many texts as flat numpy arrays: code points, words, lines and their hashes.

All sums wrap modulo 2^64. A hash of a span is the difference of two prefix sums of
`code * BASE^position`, moved back to position 0 by the inverse power; BASE is odd, so it has one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

GROUP_CHARS = 1 << 20  # code points worked on at once; one longer text makes a group of its own
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), grown by doubling and kept for the next group."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        while len(have) < n:
            step = np.uint64(pow(base, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        if n <= 4 * GROUP_CHARS:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) from their prefix sums."""
    return (prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def groups(texts: Sequence[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first text, texts) in groups of about GROUP_CHARS code points."""
    first, size, held = 0, 0, []
    for k, text in enumerate(texts):
        text = text or ""
        if held and size + len(text) > GROUP_CHARS:
            yield first, held
            first, size, held = k, 0, []
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held


class Flat:
    """Code points of some texts, each text followed by one line feed, and their words.

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and return.
    """

    def __init__(self, texts: Sequence[str]):
        self.codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.ends = np.cumsum(sizes + 1)  # one past the line feed of each text
        self.begins = self.ends - sizes - 1
        self.n_texts = len(texts)
        codes = self.codes
        black = ~((codes == 32) | ((codes >= 9) & (codes <= 13)))
        edge = np.flatnonzero(np.diff(black, prepend=False))  # the last code is white
        self.starts, self.stops = edge[0::2], edge[1::2]
        self.word_offsets = np.searchsorted(self.starts, np.append(self.begins, len(codes)))
        self._prefix: np.ndarray | None = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = prefix_sums(mix(self.codes.astype(np.uint64) + np.uint64(1)))
        return self._prefix

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_offsets)

    def word_hashes(self) -> np.ndarray:
        return mix(rolling(self.prefix, self.starts, self.stops))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts)

    def per_text(self, of_codes: np.ndarray) -> np.ndarray:
        """Sum over each text of a number per code point."""
        total = np.concatenate([[0], np.cumsum(of_codes, dtype=np.int64)])
        return total[self.ends] - total[self.begins]

    def per_text_words(self, of_words: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(of_words, dtype=np.int64)])
        return np.diff(total[self.word_offsets])


def windows(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the windows of n words that lie inside one text."""
    counts = np.diff(offsets)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(hashes))
    first = at[at + n <= offsets[1:][text]] if len(at) else at
    return first, mix(rolling(prefix_sums(hashes), first, first + n))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = np.diff(keys[order]) == 0
        out[order[1:]] = same
        out[order[:-1]] |= same
    return out


def covered(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Marks of the places that lie in any window [first, first + n)."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, first, 1)
    np.add.at(steps, first + n, -1)
    return np.cumsum(steps)[:-1] > 0
