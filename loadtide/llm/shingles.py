"""Sets of hashed word shingles of whole texts, in NumPy.

Words are runs of bytes other than space and 09-0D after A-Z are lower-cased. A word's hash is a
polynomial over its bytes, a shingle's hash mixes the hashes of its words. Memory is bounded by one
block of bytes plus eight bytes a word of the text at hand.
"""
import numpy as np

from loadtide.llm.common import ship

BLOCK = 1 << 20
_rng = np.random.default_rng(77)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
WORD_FACTOR = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(h):
    """Spread every bit over the word (a bijection)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """``sets(datas)`` gives for each UTF-8 text the sorted distinct shingle hashes."""

    def __init__(self, words: int):
        self.words, self.n = words, 0

    def _powers(self, n):
        if n > self.n:
            self.n = max(n, 2 * BLOCK)
            step = np.full(self.n, BASE, dtype=np.uint64)
            step[0] = 1
            self.power = np.cumprod(step)
            step[1:] = BASE_INVERSE
            self.inverse = np.cumprod(step)

    def _block(self, data):
        """Hashes and starts of the words of a block that cuts no word."""
        a = LOWER[np.frombuffer(data, dtype=np.uint8)]
        gap = SPACE[a]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        self._powers(len(a) + 1)
        run = np.zeros(len(a) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[a] * self.power[:len(a)], out=run[1:])
        h = (run[ends] - run[starts]) * self.inverse[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * WORD_FACTOR[63]), starts

    def _long(self, data):
        parts, at = [], 0
        while at < len(data):
            end = min(at + BLOCK, len(data))
            while end < len(data) and data[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            parts.append(self._block(data[at:end])[0])
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)

    def _set(self, w):
        k, n = self.words, len(w)
        if n == 0:
            return w
        if n < k:
            h = np.uint64(n)
            with np.errstate(over="ignore"):
                for x in w:
                    h = mixed(h * WORD_FACTOR[62] + x)
            return np.array([h], dtype=np.uint64)
        h = w[:n - k + 1] * WORD_FACTOR[0]
        for i in range(1, k):
            h = h + w[i:n - k + 1 + i] * WORD_FACTOR[i]
        return np.unique(mixed(h))

    def sets(self, datas):
        out, group, size = [], [], 0
        for d in datas:
            if len(d) > BLOCK:
                out += self._flush(group)
                group, size = [], 0
                out.append(self._set(self._long(d)))
                continue
            group.append(d)
            size += len(d) + 1
            if size > BLOCK:
                out += self._flush(group)
                group, size = [], 0
        return out + self._flush(group)

    def _flush(self, group):
        if not group:
            return []
        h, starts = self._block(b"\n".join(group))
        edges = np.searchsorted(starts, np.cumsum([0] + [len(d) + 1 for d in group]))
        return [self._set(h[a:b]) for a, b in zip(edges[:-1], edges[1:])]


ship(__name__)
