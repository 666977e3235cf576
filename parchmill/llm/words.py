"""Words of whole text columns as 64-bit hashes, with numpy over Arrow buffers.

A word is a longest run of a-z, 0-9 and non-ASCII bytes, A-Z counting as a-z:
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. Python never sees
a word, so a text costs some nanoseconds a byte and a bounded working set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20  # bytes hashed at once; a longer run of word bytes is still one word

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _is_word_byte() -> np.ndarray:
    byte = np.arange(256)
    return (
        ((byte >= 48) & (byte <= 57)) | ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122)) | (byte >= 128)
    )


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, dtype=np.uint64)
    values[65:91] = values[97:123]
    return values


WORD_BYTE = _is_word_byte()
_VALUE = _byte_values()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and ``base ** -i`` modulo 2**64, for i below n at least."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _powers:
        made = _geometric(_BASE, size), _geometric(pow(_BASE, -1, 1 << 64), size)
        if size > 2 * PIECE:
            return made  # one very long word: not kept
        _powers[size] = made
    return _powers[size]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a polynomial hash: every bit of the result depends on every bit."""
    h = h ^ (h >> _U(33))
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(29)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(32)
    return h


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the words of ``data`` start and end."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = WORD_BYTE[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[0::2], turns[1::2]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def windows(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes at each start, letters as in words."""
    total = np.zeros(len(starts), dtype=_U)
    for i in range(size):
        total += _VALUE[data[starts + i]] * _U(pow(_BASE, i, 1 << 64))
    return mix(total)


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of every word of one UTF-8 buffer."""
    if len(data) <= PIECE:
        starts, ends = word_spans(data)
        return hash_spans(data, starts, ends), starts, ends
    parts, at = [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and WORD_BYTE[data[end]]:
            end += 1
        starts, ends = word_spans(data[at:end])
        parts.append((hash_spans(data[at:end], starts, ends), starts + at, ends + at))
        at = end
    hashes, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
    return hashes, starts, ends


def text_buffers(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of a column, without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        for chunk in column.chunks:
            yield from text_buffers(chunk)
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    present = np.asarray(column.is_valid())
    for i in range(len(column)):
        yield flat[at[i] : at[i + 1]] if present[i] else flat[:0]


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k words in a row; none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    if k <= 8:
        total = np.zeros(n, dtype=_U)
        for i in range(k):
            total += hashes[i : i + n] * _U(pow(_BASE, i, 1 << 64))
        return mix(total)
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=_U)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n])


def stretches(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words from each start to before its end."""
    up, down = powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=_U)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """As ``runs``; a text of fewer words, but not none, is one shingle of all its words."""
    return runs(hashes, k) if len(hashes) >= k or not len(hashes) else runs(hashes, len(hashes))


def _sliding(op: np.ufunc, values: np.ndarray, window: int) -> np.ndarray:
    """``op`` over every ``window`` values in a row."""
    size, out = 1, values
    while size * 2 <= window:
        out = op(out[:-size], out[size:])
        size *= 2
    n = len(values) - window + 1
    return op(out[:n], out[window - size : window - size + n])


def window_minima(keys: np.ndarray, window: int) -> np.ndarray:
    """The smallest of every ``window`` keys in a row; none if there are fewer."""
    return _sliding(np.minimum, keys, window) if len(keys) >= window else np.zeros(0, dtype=_U)


def minimisers(keys: np.ndarray, window: int) -> np.ndarray:
    """Positions whose key is the smallest of some ``window`` keys in a row, all equals counting.

    Fewer keys than a window are one window.
    """
    window = min(window, len(keys))
    if not window:
        return np.zeros(0, dtype=np.int64)
    least = _sliding(np.minimum, keys, window)
    around = np.concatenate([np.zeros(window - 1, _U), least, np.zeros(window - 1, _U)])
    return np.flatnonzero(_sliding(np.maximum, around, window) == keys)
