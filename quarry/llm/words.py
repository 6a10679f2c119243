"""Words, hashes and shingles of whole texts, computed with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D; these are
ASCII, so splitting UTF-8 bytes gives the same words as splitting code points.
"""

from __future__ import annotations

import numpy as np

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROLL = (_RNG.integers(0, 2**64, 64, dtype=np.uint64)) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SIGN = np.zeros(256, bool)
_IS_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 1 << 17)
        inverse = np.uint64(pow(int(_STEP), -1, 2**64))
        up, down = np.full(n, _STEP, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer, on a copy."""
    h = h ^ (h >> _S33)
    h *= _MIX1
    h ^= h >> _S29
    h *= _MIX2
    h ^= h >> _S33
    return h


def word_hashes(text: str | None, lower: bool = True, strip: bool = False) -> np.ndarray:
    """One 64-bit hash for each word of a text; empty for null."""
    return word_spans(text, lower, strip)[0]


def _signs(raw: np.ndarray) -> np.ndarray:
    """Bytes of ASCII signs and of the Latin-1, general and CJK punctuation."""
    out = _IS_SIGN[raw]
    if len(raw) > 2:
        a, b = raw[:-2], raw[1:-1]
        three = np.flatnonzero((a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80))
        out[three] = out[three + 1] = out[three + 2] = True
    two = np.flatnonzero(raw[:-1] == 0xC2)
    out[two] = out[two + 1] = True
    return out


def word_spans(text: str | None, lower: bool = True, strip: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and end bytes of the words of a text.

    Hashes are polynomial prefix sums over random byte values, so the work is
    vectorized; equal words have equal hashes, and only ASCII case is folded.
    ``strip`` leaves out signs at the edges of words that are not all signs.
    """
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    none = np.zeros(0, np.int64)
    if not len(raw):
        return none.astype(np.uint64), none, none
    if lower:
        raw = _LOWER[raw]
    inside = np.concatenate(([False], ~_IS_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edges[::2], edges[1::2]
    if not len(first):
        return none.astype(np.uint64), none, none
    if strip:
        kept = np.flatnonzero(~(_signs(raw) | ~inside[1:-1]))
        if len(kept):
            at, to = np.searchsorted(kept, first), np.searchsorted(kept, end)
            some = to > at
            first[some], end[some] = kept[at[some]], kept[to[some] - 1] + 1
    out = np.empty(len(first), np.uint64)
    # In blocks, so that the power tables stay small for very long texts.
    block = 1 << 20
    done = 0
    while done < len(first):
        upto = max(done + 1, int(np.searchsorted(end, first[done] + block, "right")))
        at, stop = int(first[done]), int(end[upto - 1])
        up, down = _power_tables(stop - at + 1)
        sums = np.zeros(stop - at + 1, np.uint64)
        np.cumsum(_BYTE[raw[at:stop]] * up[: stop - at], out=sums[1:])
        f, e = first[done:upto] - at, end[done:upto] - at
        out[done:upto] = (sums[e] - sums[f]) * down[f] + (e - f).astype(np.uint64) * _MIX1
        done = upto
    return mix(out), first, end


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each k-word shingle, in order of position.

    With fewer words the whole sequence is the one shingle; no words, none.
    """
    n = len(words)
    if n == 0:
        return words
    w = min(k, n)
    with np.errstate(over="ignore"):
        h = np.full(n - w + 1, np.uint64(w), np.uint64)
        for i in range(w):
            h += words[i : n - w + 1 + i] * _ROLL[i]
        return mix(h)
