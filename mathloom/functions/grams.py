"""Character n-grams of many texts at once, counted on arrays of code points.

One Arrow batch is one array: no gram is cut out of a text one by one, and the counts of a text need
no shuffle, as a text is one row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np

SIZES = (2, 3, 4)
#: Characters that are counted at once, about 200 bytes of memory each; a longer text is counted alone.
CHUNK_CHARS = 250_000

#: (text, gram, count) as parallel arrays, the second one an index into the list of grams.
Counts = tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]


def ranges(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about ``most`` characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def counted(texts: list, most: int = CHUNK_CHARS) -> Iterator[Counts]:
    """How often each gram of SIZES characters occurs in each text, some texts at a time. Null and
    one-character texts have no grams."""
    for lo, hi in ranges(texts, most):
        yield from _counted([t or "" for t in texts[lo:hi]], lo)


def _counted(texts: list[str], first: int) -> Iterator[Counts]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet, place = np.unique(points, return_inverse=True)
    bits = int(len(alphabet)).bit_length()  # 0 is no letter, so the grams of all sizes fit one key
    if bits * max(SIZES) > 64:
        if len(texts) > 1:
            half = len(texts) // 2
            yield from _counted(texts[:half], first)
            yield from _counted(texts[half:], first + half)
        else:
            yield _by_dictionary(texts[0], first)
        return
    letter = place.astype(np.uint64) + np.uint64(1)
    text = np.repeat(np.arange(len(texts)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    shifts = [np.uint64(bits * (max(SIZES) - 1 - i)) for i in range(max(SIZES))]
    keys, owners = [], []
    for n in SIZES:
        at = np.flatnonzero(room >= n)
        key = np.zeros(len(at), np.uint64)
        for i in range(n):
            key |= letter[at + i] << shifts[i]
        keys.append(key)
        owners.append(text[at])
    grams, g = np.unique(np.concatenate(keys), return_inverse=True)
    pair, count = np.unique(np.concatenate(owners) * max(1, len(grams)) + g, return_counts=True)
    owner, g = np.divmod(pair, max(1, len(grams)))
    yield owner + first, g, count, _spelt(grams, shifts, np.uint64(2**bits - 1), alphabet)


def _spelt(keys: np.ndarray, shifts: list, mask: np.uint64, alphabet: np.ndarray) -> list[str]:
    letters = np.concatenate([np.zeros(1, np.uint32), alphabet.astype(np.uint32)])
    spelt = np.stack([letters[((keys >> s) & mask).astype(np.int64)] for s in shifts], 1) if len(keys) else np.zeros((0, len(shifts)), np.uint32)
    if len(alphabet) and alphabet[0] == 0:  # numpy would take a NUL at the end for padding
        sizes = np.stack([((keys >> s) & mask) > 0 for s in shifts], 1).sum(1)
        return ["".join(map(chr, row[:n])) for row, n in zip(spelt.tolist(), sizes)]
    return np.ascontiguousarray(spelt).view(f"<U{len(shifts)}").ravel().tolist()


def _by_dictionary(text: str, first: int) -> Counts:
    """A text of so many different characters that its grams fit no 64-bit key."""
    found = Counter(text[i : i + n] for n in SIZES for i in range(len(text) - n + 1))
    return np.full(len(found), first), np.arange(len(found)), np.fromiter(found.values(), np.int64, len(found)), list(found)
