"""Words and word shingles of texts as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For the words of letters and digits: every other ASCII byte is a space.
MARKS = np.ones(256, bool)
MARKS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = False
MARKS[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_M = 0x9E3779B97F4A7C55
_INVERSE = pow(_M, -1, 1 << 64)


def _powers(n: int, m: int) -> np.ndarray:
    out = np.full(n, m, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: list[bytes], most: int = 1 << 18):
    """(first, end) ranges whose bytes together stay near ``most``; a longer value stands alone."""
    first, size = 0, 0
    for i, v in enumerate(values):
        if size and size + len(v) > most:
            yield first, i
            first, size = i, 0
        size += len(v) + 1
    if first < len(values):
        yield first, len(values)


def word_hashes(texts: list[bytes], space: np.ndarray = _SPACE) -> list[np.ndarray]:
    """Hashes of the words of each text: runs of anything but ASCII white space (or ``space``), A-Z in lower case."""
    out: list[np.ndarray] = []
    for a, b in runs(texts):
        data = b"\n" + b"\n".join(texts[a:b]) + b"\n"
        buf = _LOWER[np.frombuffer(data, np.uint8)]
        edge = np.diff(space[buf].astype(np.int8))
        start, end = np.nonzero(edge == -1)[0] + 1, np.nonzero(edge == 1)[0] + 1
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _powers(len(buf), _M))])
            hashed = mix((sums[end] - sums[start]) * _powers(len(buf), _INVERSE)[start] ^ (end - start).astype(np.uint64))
        cuts = np.searchsorted(start, np.cumsum([1, *(len(t) + 1 for t in texts[a:b])]))
        out += [hashed[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of every ``size`` words in a row; of all words where there are fewer."""
    n = min(size, len(words))
    if not n:
        return words
    with np.errstate(over="ignore"):
        total = np.full(len(words) - n + 1, n, np.uint64)
        for j in range(n):
            total = mix(total + words[j : len(words) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(total)


def encoded(texts: list[str | None]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
