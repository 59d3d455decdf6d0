"""Words and word shingles of whole batches of texts as 64-bit hashes, without a loop over words.

A word is a longest run of letters and digits (``str.isalnum``), lower-cased. The
texts of a batch are laid out as one array of code points; word borders come from a
table look-up, and each word's hash from differences of one running polynomial sum,
so the cost is a few nanoseconds a character.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np

#: Odd multiplier of the polynomial, its inverse modulo 2**64, and the multipliers of the finalizer (fixed values).
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def _alnum() -> np.ndarray:
    if "alnum" not in _tables:
        _tables["alnum"] = np.fromiter((chr(c).isalnum() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _tables["alnum"]


def _powers(base: np.uint64, name: str, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown as needed."""
    have = _tables.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            step = have[done - 1] * base
            have[done : 2 * done] = have[:done] * step
            done *= 2
        _tables[name] = have
    return have


def _letters() -> np.ndarray:
    if "letter" not in _tables:
        _tables["letter"] = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _tables["letter"]


def kinds(name: str, of: Callable[[str], int]) -> np.ndarray:
    """The small number that ``of`` gives each character; made once for a name."""
    if name not in _tables:
        _tables[name] = np.fromiter((of(chr(c)) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    return _tables[name]


def laid_out(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the lower-cased texts, a line feed between two, where each text begins); given to several of the functions below, they are made once."""
    low = [t.lower() if t else "" for t in texts]
    lens = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate(([0], np.cumsum(lens[:-1] + 1))) if len(lens) else np.empty(0, np.int64)


def lines(texts: Sequence[str | None], laid: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of its letters, number of text, start, end) of every line with letters; lines end at line and form feeds."""
    codes, first = laid or laid_out(texts)
    with np.errstate(over="ignore"):
        letter = _letters()[codes]
        breaks = np.flatnonzero((codes == 10) | (codes == 12))
        start, end = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(codes)]))
        before = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(letter, out=before[1:])
        n = int(before[-1])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((codes[letter].astype(np.uint64) + np.uint64(1)) * _powers(_P, "p", n)[:n], out=sums[1:])
        a, b = before[start], before[end]
        has = b > a
        start, end, a, b = start[has], end[has], a[has], b[has]
        h = mix((sums[b] - sums[a]) * _powers(_P_INV, "i", n)[a])
    owner = np.searchsorted(first, start, side="right") - 1
    return h, owner, start - first[owner] if len(owner) else start, end - first[owner] if len(owner) else end


def only_letters(texts: Sequence[str | None], owner: np.ndarray, start: np.ndarray, end: np.ndarray, laid: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Whether the words at these offsets have no digits."""
    codes, first = laid or laid_out(texts)
    before = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(_letters()[codes], out=before[1:])
    at = first[owner] if len(owner) else start
    return before[at + end] - before[at + start] == end - start


def words(texts: Sequence[str | None], laid: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, number of text, start, end) of every word in text order; a null text has none. Offsets are into the lower-cased text."""
    codes, first = laid or laid_out(texts)
    with np.errstate(over="ignore"):
        inside = np.empty(len(codes) + 2, bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = _alnum()[codes]
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = turns[0::2], turns[1::2]
        if not len(start):
            none = np.empty(0, np.int64)
            return np.empty(0, np.uint64), none, none, none
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(_P, "p", len(codes))[: len(codes)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * _powers(_P_INV, "i", len(codes))[start])
        owner = np.searchsorted(first, start, side="right") - 1
    return h, owner, start - first[owner], end - first[owner]


def shingles(h: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of k words in a row, index of its first word), never across two texts."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for i in range(1, k):
            s = s * _P + h[i : i + n]
        s = mix(s)
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    return s[at], at


def shingle_sets(texts: Sequence[str | None], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, sorted distinct shingles) of each text, in order.

    A text of fewer than k words has no shingles.
    """
    h, owner, _, _ = words(texts)
    n_words = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    s, at = shingles(h, owner, k)
    per = np.bincount(owner[at], minlength=len(texts)) if len(at) else np.zeros(len(texts), np.int64)
    cut = np.concatenate(([0], np.cumsum(per)))
    for i in range(len(texts)):
        own = np.sort(s[cut[i] : cut[i + 1]])
        yield int(n_words[i]), own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own


def set_id(values: np.ndarray) -> int:
    """A signed 64-bit name of a sorted set of hashes; equal sets have equal names."""
    with np.errstate(over="ignore"):
        folded = mix(values * _P + np.uint64(len(values))).sum(dtype=np.uint64) if len(values) else np.uint64(0)
        return int(mix(np.asarray([folded ^ np.uint64(len(values))]))[0].astype(np.int64))
