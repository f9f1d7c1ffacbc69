"""Words and lines of a whole Arrow batch of texts as numbers, without a Python object per word.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. A word of up to eight
bytes is its own number, mixed; longer ones are mixed eight bytes at a time.
A sequence of words is hashed as the sum of its words' numbers times a random
odd number for each place, so the hash of any part, or of all but one word,
is a difference of running sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers, one for each of ``x``; different ones stay different."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def place_factors(n: int, salt: int) -> np.ndarray:
    """A random odd number for each of ``n`` places."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


def running(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:], dtype=np.uint64)
    return out


class Words:
    """The words of a batch of texts, dealt into lines (or with ``lines=False`` into whole texts).

    ``hash`` has a number for each word; line k has the words ``first[k]`` up to
    ``first[k + 1]``, is in text ``row[k]`` and is that text's line ``pos[k]``.
    """

    def __init__(self, texts: pa.Array, lines: bool = True):
        texts = pc.fill_null(texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and len(texts) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
        self.data, n = data, len(data)
        space = _SPACE[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner] = after[inner - 1] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.hash = self._hashes(_LOWER[data])
        rows, begin = np.arange(len(offsets) - 1), offsets[:-1]
        if lines:
            breaks = np.flatnonzero(data == 10)
            rows = np.concatenate([rows, np.searchsorted(offsets, breaks, "right") - 1])
            begin = np.concatenate([begin, breaks + 1])
            order = np.argsort(rows, kind="stable")
            rows, begin = rows[order], begin[order]
        self.row, self.begin = rows, begin
        self.first = np.append(np.searchsorted(self.start, begin), len(self.start))
        self.n = np.diff(self.first)
        at = np.arange(len(rows))
        self.pos = at - np.maximum.accumulate(np.where(np.append(True, rows[1:] != rows[:-1]), at, 0)) if len(rows) else at
        #: Where each line ends: before its line break, or at its text's end.
        stop = offsets[1:][rows]
        if len(rows):
            same = rows[1:] == rows[:-1]
            stop[:-1][same] = begin[1:][same] - 1
        self.stop = stop

    def _hashes(self, low: np.ndarray) -> np.ndarray:
        size = self.end - self.start
        padded = np.concatenate([low, np.zeros(8, np.uint8)])
        eight = np.ndarray((max(len(low), 1),), "<u8", padded.data, strides=(1,)) if len(low) else np.zeros(0, "<u8")

        def block(at: np.ndarray, left: np.ndarray) -> np.ndarray:
            return eight[at] & _LEFT[np.minimum(left, 8)]

        out = mixed(block(self.start, size) + np.minimum(size, 9).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        more, done = np.flatnonzero((size > 8) & (size <= _LONG)), 8
        while len(more):
            out[more] = mixed(out[more] * np.uint64(0xC2B2AE3D27D4EB4F) ^ block(self.start[more] + done, size[more] - done))
            done += 8
            more = more[size[more] > done]
        for k in np.flatnonzero(size > _LONG):
            out[k] = xxhash.xxh64_intdigest(low[self.start[k] : self.end[k]].tobytes())
        return out

    def line(self, k: int) -> str:
        return self.data[self.begin[k] : self.stop[k]].tobytes().decode("utf-8", "surrogatepass")


class LineHashes:
    """Hashes of the lines of ``words``: of whole lines, of their halves, and of lines without one word."""

    def __init__(self, words: Words):
        self.n, self.a, self.b = words.n, words.first[:-1], words.first[1:]
        at = np.arange(len(words.hash)) - np.repeat(self.a, self.n)
        longest = int(self.n.max(initial=0))
        self.factors = place_factors(longest + 1, 1)
        self.at, self.words = at, words.hash
        self.sums = running(words.hash * self.factors[at])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each line."""
        other = running(self.words * place_factors(len(self.factors), 2)[self.at])
        return self.sums[self.b] - self.sums[self.a], other[self.b] - other[self.a] + mixed(self.n.astype(np.uint64))

    def halves(self) -> np.ndarray:
        """Four keys a line: beginnings of n // 2 and (n - 1) // 2 words, ends of the same, rounded up."""
        a, b, n, out = self.a, self.b, self.n, []
        from_end = np.repeat(n, n) - 1 - self.at
        ends = running(self.words * self.factors[from_end])
        for size in (n // 2, np.maximum(n - 1, 0) // 2):
            out.append(mixed((self.sums[a + size] - self.sums[a]) ^ (2 * size).astype(np.uint64)))
        for size in ((n + 1) // 2, n // 2):
            out.append(mixed((ends[b] - ends[b - size]) ^ (2 * size + 1).astype(np.uint64)))
        return np.stack(out, axis=1)

    def whole(self) -> np.ndarray:
        """The variant that leaves out nothing."""
        return mixed((self.sums[self.b] - self.sums[self.a]) ^ (4 * self.n).astype(np.uint64))

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(line, place, key, key with the place) of every line without one of its words."""
        line = np.repeat(np.arange(len(self.n)), self.n)
        word = np.arange(len(line))
        moved = running(self.words * self.factors[np.maximum(self.at - 1, 0)])
        less = self.sums[word] - self.sums[self.a[line]] + moved[self.b[line]] - moved[word + 1]
        fewer = (4 * (self.n[line] - 1)).astype(np.uint64)
        return line, self.at, mixed(less ^ fewer), mixed(mixed(less ^ fewer) + (4 * self.at + 1).astype(np.uint64))
