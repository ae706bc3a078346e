"""Character 4-gram similarity: cleaning, minwise bit sketches and exact verification.

Texts are handled a batch at a time as one array of code points. Similarity of two texts:
lower-case them, keep letters and digits (Unicode L and N), take the set of all substrings
of four characters; common ones divided by different ones. Texts with fewer than
``MIN_CHARS`` letters and digits have no similarity and get no sketch.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

GRAM = 4
MIN_CHARS = 20
#: A fingerprint has so many bits of each of so many minwise values.
SYMBOLS, SYMBOL_BITS = 128, 3
#: Grams that are hashed at once: their arrays stay in the cache of a core.
GRAMS_AT_ONCE = 1 << 16


@functools.cache
def _kept() -> np.ndarray:
    """For every code point: is it a letter or a digit?"""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)


def clean(text: str | None) -> str:
    """Lower-case letters and digits of one text."""
    return "".join(c for c in (text or "").lower() if unicodedata.category(c)[0] in "LN")


def gram_set(text: str | None) -> set[str]:
    """Plain version of the shingle set, for tests and small inputs."""
    t = clean(text)
    return {t[i : i + GRAM] for i in range(len(t) - GRAM + 1)} if len(t) >= MIN_CHARS else set()


def code_points(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Cleaned code points of all texts, one after another, and the n + 1 offsets."""
    low = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    flat = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = _kept()[flat]
    ends = np.concatenate([[0], np.cumsum(keep)])[np.cumsum(sizes)] if len(low) else np.zeros(0, np.int64)
    return flat[keep], np.concatenate([[0], ends]).astype(np.int64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def gram_hashes(cp: np.ndarray) -> np.ndarray:
    """64-bit hash of the 4-gram that begins at each position."""
    c = cp.astype(np.uint64)
    n = max(0, len(c) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):  # 21 bits a code point: three fit exactly, the fourth is folded in by mixing
        h = mix64(h) ^ (c[k : k + n] << np.uint64(13 * k))
    return mix64(h)


def sketches(cp: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """[texts, count] minwise values (32 bits); every text needs at least GRAM characters."""
    texts = len(off) - 1
    valid = np.ones(len(cp), bool)
    for k in range(1, GRAM):
        valid[off[1:] - k] = False
    h = gram_hashes(cp)
    h = (h[valid[: len(h)]] >> np.uint64(32)).astype(np.uint32)
    starts = off[:-1] - (GRAM - 1) * np.arange(texts)
    rnd = np.random.default_rng(20240229)
    drawn = [rnd.integers(1, 2**32, 2, dtype=np.uint32) for _ in range(count)]
    out = np.empty((texts, count), np.uint32)
    begin = 0
    while begin < texts:
        end = max(begin + 1, int(np.searchsorted(starts, starts[begin] + GRAMS_AT_ONCE)))
        own = h[starts[begin] : starts[end] if end < texts else len(h)]
        at, v, w = starts[begin:end] - starts[begin], np.empty_like(own), np.empty_like(own)
        for k, (xor, mul) in enumerate(drawn):
            np.bitwise_xor(own, xor, out=v)
            np.multiply(v, mul | np.uint32(1), out=v)
            np.right_shift(v, np.uint32(15), out=w)
            np.bitwise_xor(v, w, out=v)
            np.multiply(v, np.uint32(0x2C1B3C6D), out=v)
            out[begin:end, k] = np.minimum.reduceat(v, at)
        begin = end
    return out


def fingerprints(mins: np.ndarray) -> np.ndarray:
    """[texts, 6] signed 64-bit words of the fingerprint: the lowest bit of the first 128 values in two words, then
    the second and the third bit."""
    bits = (mins[:, None, :SYMBOLS] >> np.arange(SYMBOL_BITS, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).reshape(len(mins), -1), axis=1, bitorder="little").view("<i8")


#: Pairs verified together: their number takes the upper 12 bits of a key, 52 bits of gram hash the rest.
_TOGETHER = 4096


def _keys(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (place, gram) keys of some texts and the number of grams of each."""
    cp, off = code_points(texts)
    h = gram_hashes(cp)
    size = np.diff(off)
    many = np.where(size >= MIN_CHARS, size - GRAM + 1, 0)
    place = np.repeat(np.arange(len(texts)), many)
    at = np.arange(len(place)) - np.repeat(np.cumsum(many) - many, many) + off[:-1][place]
    keys = np.sort((place.astype(np.uint64) << np.uint64(52)) | (h[at] >> np.uint64(12)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    return keys, np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=len(texts))


def jaccard_pairs(left: list, right: list) -> np.ndarray:
    """Similarity of texts at equal places of two lists; NaN where a side has none."""
    out = np.full(len(left), np.nan)
    for i in range(0, len(left), _TOGETHER):
        a, na = _keys(left[i : i + _TOGETHER])
        b, nb = _keys(right[i : i + _TOGETHER])
        both = np.sort(np.concatenate([a, b]), kind="stable")
        twice = both[1:][both[1:] == both[:-1]]
        common = np.bincount((twice >> np.uint64(52)).astype(np.int64), minlength=len(na))
        has = (na > 0) & (nb > 0)
        out[i : i + _TOGETHER][has] = common[has] / (na + nb - common)[has]
    return out
