"""Vectorised hashing of words and five-word shingles.

Words are the runs between ASCII white space of the text with A-Z lowered. A text of fewer words than a shingle has its
whole word sequence as its one shingle; a text without words has none. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

WIDTH = 5
#: Bytes of text hashed at once; one longer text is hashed alone.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0x9E3779B97F4A7C15 | 1)
_PLACE = _rng.integers(1, 2**63, WIDTH, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = np.multiply.accumulate(np.full(256, _STEP, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.full(max(n, 2 * len(_powers)), _STEP, dtype=np.uint64))
    return _powers


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word in ``buf`` (uint8, already lowered)."""
    gap = _SPACE[buf]
    begins = ~gap
    begins[1:] &= gap[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    inside = np.flatnonzero(~gap)
    lengths = np.diff(np.append(np.searchsorted(inside, starts), len(inside)))
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inside)) - np.repeat(first, lengths)
    values = _BYTE[buf[inside]] * _power(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)), starts


def _chunks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > CHUNK_BYTES:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingle hashes."""
    for part in _chunks((t or "").encode("utf-8", "surrogatepass").lower() for t in texts):
        buf = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
        ends = np.cumsum([len(t) + 1 for t in part])
        h, starts = word_hashes(buf)
        bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
        if len(h) >= WIDTH:
            n = len(h) - WIDTH + 1
            rolled = np.zeros(n, dtype=np.uint64)
            for k in range(WIDTH):
                rolled += h[k : k + n] * _PLACE[k]
            rolled = mix(rolled)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= WIDTH:
                s = np.sort(rolled[a : b - WIDTH + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif b > a:
                yield mix(np.add.reduce(h[a:b] * _PLACE[: b - a], keepdims=True) + _U(b - a))
            else:
                yield np.empty(0, dtype=np.uint64)


def text_chunks(column, limit: int = 8 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Slices of an Arrow string column of about ``limit`` bytes: first row and texts."""
    import pyarrow.compute as pc

    if not len(column):
        return
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64))
    row = 0
    while row < len(column):
        base = sizes[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield row, column.slice(row, end - row).to_pylist()
        row = end
