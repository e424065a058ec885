"""Distinct word n-grams of whole texts as 64-bit hashes, computed over the bytes of a batch at once."""

import functools

import numpy as np

_rng = np.random.default_rng(20240601)
#: One random 64-bit value for each byte, with A-Z sharing those of a-z.
_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CODES[65:91] = _CODES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_KEPT = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """Ascending powers of ``base``, not to be written to: those of most texts are kept."""
    return _kept_powers(base)[:n] if n <= _KEPT else _all_powers(base, n)


def _all_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@functools.cache
def _kept_powers(base: int) -> np.ndarray:
    return _all_powers(base, _KEPT)


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text in order, A-Z as a-z; white space is ASCII's."""
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text, np.uint8)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    # Rolling hash modulo 2**64: the base is odd, so a word's own value is its part of the sum times a power of the inverse.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[raw] * _powers(_BASE, len(raw)))])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw))[starts])


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Distinct ``words``-grams, ascending; a shorter text is one n-gram, a text without words none."""
    hashes = word_hashes(text)
    if len(hashes) == 0:
        return hashes
    words = min(words, len(hashes))
    n = len(hashes) - words + 1
    total = np.full(n, words, np.uint64)
    for i, factor in enumerate(_powers(0xD6E8FEB86659FD93, words + 1)[1:]):
        total += hashes[i : i + n] * factor
    total = mix(total)
    total.sort()
    fresh = np.ones(n, bool)
    np.not_equal(total[1:], total[:-1], out=fresh[1:])
    return total[fresh]


class PieceWords:
    """Word hashes of texts that are given as pieces, without joining them: the same as ``word_hashes`` of the joined bytes.

    No piece may hold white space between other bytes.
    """

    def __init__(self, pieces: list[bytes]):
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        self.length = np.array([len(p) for p in pieces], np.int64)
        owner = np.repeat(np.arange(len(pieces)), self.length)
        space = _SPACE[raw]
        at = np.arange(len(raw)) - (np.cumsum(self.length) - self.length)[owner]
        self.lead, last = self.length.copy(), np.zeros(len(pieces), np.int64)
        np.minimum.at(self.lead, owner[~space], at[~space])
        np.maximum.at(last, owner[~space], at[~space] + 1)
        if (~space != ((at >= self.lead[owner]) & (at < last[owner]))).any():
            raise ValueError("a piece holds white space between other bytes")
        #: Whether a word may go on behind the piece.
        self.open = (last > 0) & (last == self.length)
        self.value = np.zeros(len(pieces), np.uint64)
        np.add.at(self.value, owner, np.where(space, np.uint64(0), _CODES[raw] * _powers(_BASE, int(self.length.max(initial=0)) + 1)[at]))

    def hashes(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, text after text, and how many words each has."""
        length, lead = self.length[ids], self.lead[ids]
        ends = np.cumsum(sizes)
        offset = np.cumsum(length) - length
        begins = ends - sizes
        full = begins[sizes > 0]
        doc = np.repeat(np.arange(len(sizes)), sizes)
        base = np.zeros(len(sizes), np.int64)
        base[sizes > 0] = offset[full]
        offset -= base[doc]
        written = length > lead
        # A word begins behind white space, within a piece or before it, and with its text.
        fresh = written & (lead > 0)
        fresh[1:] |= written[1:] & ~self.open[ids[:-1]]
        fresh[full] |= written[full]
        start = np.flatnonzero(fresh)
        if not len(start):
            return np.empty(0, np.uint64), np.zeros(len(sizes), np.int64)
        most = int((offset + length).max()) + 1
        totals = np.add.reduceat(np.where(written, self.value[ids] * _powers(_BASE, most)[offset], np.uint64(0)), start)
        return mix(totals * _powers(_INVERSE, most)[offset[start] + lead[start]]), np.bincount(doc[start], minlength=len(sizes))
