"""Words of many texts at once, with numpy, inside Spark tasks.

Texts are scanned as UTF-8 bytes.  Each word gets a 64-bit hash from prefix sums of
a polynomial modulo 2**64, mixed at the end, so that the cost is a few vector
operations per byte.  Word sequences (n-grams, lines) are hashed from word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
SEGMENT = 1 << 18          # bytes hashed at once; longer only for one word that is longer
CHUNK = 2 << 20            # bytes of text that are scanned together; longer only for one text that is longer

_R = 0x9E3779B97F4A7C15    # odd, so that it has an inverse modulo 2**64
_R_INV = pow(_R, -1, 1 << 64)
_SEQ = U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_R))

SPACED = np.ones(256, bool)                      # words: [^\x20\x09-\x0D]+
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, bool)                       # words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(r: int) -> np.ndarray:
        out = np.full(n, U(r), U)
        out[0] = 1
        return np.multiply.accumulate(out)
    return table(_R), table(_R_INV)


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        size = SEGMENT
        while size < b - a:
            size *= 2
        up, down = _powers(size + 1)
        sums = np.zeros(b - a + 1, U)
        np.cumsum(_BYTE[buf[a:b]] * up[:b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
        i = j
    return out


class Words:
    """The words of several texts.

    ``doc[i]`` is the text that word ``i`` is in, ``starts``/``ends`` its bytes within
    that text, ``first[d]:first[d + 1]`` the words of text ``d``, ``hash`` their hashes.
    """

    def __init__(self, texts: list[bytes], word: np.ndarray):
        joined = b"\n".join(texts).lower()       # bytes.lower() changes A-Z only
        self.joined = joined
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(self.sizes + 1, out=base[1:])
        buf = np.frombuffer(joined, np.uint8)
        inside = np.zeros(len(buf) + 2, np.int8)
        inside[1:-1] = word[buf]
        edges = np.flatnonzero(np.diff(inside))
        starts, ends = edges[0::2], edges[1::2]
        self.base = base
        self.abs_starts, self.abs_ends = starts, ends
        self.first = np.searchsorted(starts, base)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.starts, self.ends = starts - base[self.doc], ends - base[self.doc]
        self.hash = _hashes(buf, starts, ends)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of each run of ``k`` words within one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        g = self.hash[:n].copy()
        for j in range(1, k):
            g = g * _SEQ + self.hash[j:j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1:])
        return at, mix(g[at] + U(k))

    def words(self, i: int, j: int) -> list[bytes]:
        """Words ``i`` to ``j - 1``."""
        return [self.joined[a:b] for a, b in zip(self.abs_starts[i:j].tolist(), self.abs_ends[i:j].tolist(), strict=True)]


def sequence_hash(hashes: np.ndarray) -> int:
    """Hash of one word sequence; equal to what ``grams`` gives for it."""
    g = U(0)
    with np.errstate(over="ignore"):
        for i, h in enumerate(hashes):
            g = h if i == 0 else g * _SEQ + h
        return int(mix(np.array([g + U(len(hashes))], U))[0])


def chunks(texts: list, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes or characters of text."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        total += len(t)
        if total >= most:
            yield i, j + 1
            i, total = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?")] = True


class Sentences:
    """Runs of words of one line that end with a word ending in ``.``, ``!`` or ``?``, or with the line, of several texts.

    Offsets (from the first word to the end of the last) are in characters; ``number`` counts
    the sentences of a text from 0.
    """

    def __init__(self, texts: list[bytes]):
        words = Words(texts, SPACED)
        buf = np.frombuffer(words.joined, np.uint8)
        line = np.searchsorted(np.flatnonzero(buf == 10), words.abs_starts)      # texts are joined by line breaks, too
        begins = np.ones(len(line), bool)
        begins[1:] = (line[1:] != line[:-1]) | _STOPS[buf[words.abs_ends[:-1] - 1]]
        first = np.flatnonzero(begins)
        last = np.append(first[1:], len(line))[:len(first)]
        chars = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
        self.doc = words.doc[first]
        begin = chars[words.base[self.doc]]
        self.starts, self.stops = chars[words.abs_starts[first]] - begin, chars[words.abs_ends[last - 1]] - begin
        self.n_words = last - first
        self.number = np.arange(len(first)) - np.searchsorted(self.doc, np.arange(len(texts)))[self.doc]
        self.hash1 = _sequences(words.hash, first, last)
        self.hash2 = _sequences(mix(words.hash + U(_R)), first, last)


def _sequences(h: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences ``h[first:last]``, which follow one another."""
    out = np.empty(len(first), U)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(last, first[i] + SEGMENT, "right")))
        a, b = int(first[i]), int(last[j - 1])
        size = SEGMENT
        while size < b - a:
            size *= 2
        up, down = _powers(size + 1)
        sums = np.zeros(b - a + 1, U)
        np.cumsum(h[a:b] * up[:b - a], out=sums[1:])
        s, e = first[i:j] - a, last[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
        i = j
    return out
