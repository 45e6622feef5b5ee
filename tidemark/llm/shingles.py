"""Words and word shingles as 64-bit hashes, for whole batches of texts at once.

A word is a run of bytes other than space and \\t\\n\\v\\f\\r, with A-Z lower-cased. A word's hash is a
polynomial over a random table of byte values; a shingle's hash combines the hashes of its words by position.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
_U = np.uint64
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = int(_rng.integers(1, 2**61, dtype=np.uint64)) * 8 + 5
_PLACE = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) * _U(2) + _U(1)
_LENGTH = _rng.integers(1, 2**63, WIDTH + 1, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on every bit of h."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes."""
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, in order, and the offset at which each text begins (one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return hashes_of(raw)


def hashes_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    joined = b"\n".join(raw).lower()
    data = np.frombuffer(joined, np.uint8)
    starts, ends = word_spans(data)
    at = np.cumsum([0] + [len(x) + 1 for x in raw])
    offsets = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    up, down = _tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts]), offsets


def shingle_hashes(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts and the offsets of the texts in them; a text of fewer words has one shingle, one without words none."""
    n = np.diff(offsets)
    count = np.where(n >= WIDTH, n - WIDTH + 1, (n > 0).astype(n.dtype))
    out = np.concatenate(([0], np.cumsum(count)))
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    padded = np.concatenate((words, np.zeros(WIDTH, np.uint64)))
    full = np.full(len(words), _LENGTH[WIDTH])
    for i in range(WIDTH):
        full += padded[i : i + len(words)] * _PLACE[i]
    first = np.repeat(offsets[:-1] - out[:-1], count)
    found = full[np.arange(out[-1]) + first]
    for k in np.flatnonzero((n > 0) & (n < WIDTH)):
        own = words[offsets[k] : offsets[k + 1]]
        found[out[k]] = np.concatenate((own * _PLACE[: len(own)], _LENGTH[len(own) : len(own) + 1])).sum(dtype=np.uint64)
    return mixed(found), out


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    s, at = shingle_hashes(*word_hashes(texts))
    return [np.unique(s[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def sequence_hashes(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's whole sequence of words."""
    n = np.diff(offsets)
    up, down = _tables(max(1, len(words)))
    out = []
    for salt in (_U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mixed(words + salt) * up[: len(words)], out=total[1:])
        begin = np.minimum(offsets[:-1], max(len(words) - 1, 0))
        out.append(mixed((total[offsets[1:]] - total[offsets[:-1]]) * down[begin] + n.astype(np.uint64)))
    return out[0], out[1]
