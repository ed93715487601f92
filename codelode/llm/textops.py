"""Vectorised text primitives over Arrow string columns.

Words are maximal runs of ASCII letters, ASCII digits and bytes of non-ASCII characters; ASCII letters are
lower-cased. Hashes are 64-bit polynomials over the bytes of a word, so equal words hash alike on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; intermediates take some 60 bytes for each.
SLICE_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = np.zeros(256, bool)
    lower = np.arange(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        word[b] = b >= 128 or (c.isascii() and c.isalnum())
        if "A" <= c <= "Z":
            lower[b] = b + 32
    value = mix64(lower.astype(np.uint64) + np.uint64(1))
    value[~word] = 0
    return word, lower, value


IS_WORD, LOWER, _VALUE = _tables()


def word_table(also: str, same: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """A table for words(): the characters of `also` belong to words, and keys of `same` count as their values."""
    word, value = IS_WORD.copy(), _VALUE.copy()
    for c in also:
        word[ord(c)] = True
        value[ord(c)] = mix64(np.array([ord(c) + 1], np.uint64))[0]
    for c, d in same.items():
        word[ord(c)] = True
        value[ord(c)] = value[ord(d)]
    return word, value


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n; kept for the life of a worker."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _P), ("down", _P_INV)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows. A null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.string(), pa.large_string()):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    kind = np.int64 if column.type == pa.large_string() else np.int32
    o = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs and len(column) else np.zeros(len(column) + 1, np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return b, o


def slices(offs: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes together, or of one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(b: np.ndarray, offs: np.ndarray, table: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of some rows, the words' start and end bytes, and each row's first word (with the total at the end)."""
    is_word, value = table or (IS_WORD, _VALUE)
    base, end = int(offs[0]), int(offs[-1])
    t = b[base:end]
    n = len(t)
    rel = offs - base
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offs), np.int64)
    w = is_word[t]
    first = np.zeros(n + 1, bool)
    first[rel] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | first[1:n]
    stop = np.empty(n, bool)
    stop[-1] = w[-1]
    stop[:-1] = w[:-1] & (~w[1:] | first[1:n])
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = _powers(max(n, SLICE_BYTES + 1))
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(value[t] * up[:n], out=total[1:])
    h = mix64((total[e] - total[s]) * down[s])
    return h, s + base, e + base, np.searchsorted(s, rel).astype(np.int64)


def prefix_hashes(b: np.ndarray, s: np.ndarray, e: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the words' first `size` bytes, as words() would have them; 0 for words that are no longer than that."""
    up, _ = _powers(max(size, SLICE_BYTES + 1))
    out = np.zeros(len(s), np.uint64)
    k = np.flatnonzero(e - s > size)
    x = np.zeros(len(k), np.uint64)
    for i in range(size):
        x += _VALUE[b[s[k] + i]] * up[i]
    out[k] = mix64(x)
    return out


def word_hash(word: str, table: tuple[np.ndarray, np.ndarray] | None = None) -> int:
    """The hash of one word as words() has it."""
    raw = word.encode()
    h = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64), table)[0]
    if len(h) != 1:
        raise ValueError(f"not one word: {word!r}")
    return int(h[0])


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every word n-gram; a row of fewer words, but some, has one gram of all its words."""
    count = np.diff(first)
    rows = np.repeat(np.arange(len(count)), np.maximum(count - n + 1, 0))
    at = np.arange(len(h))
    inside = at + n <= np.repeat(first[1:], count)
    at = at[inside]
    g = np.zeros(len(at), np.uint64)
    for k in range(n):
        g = g * np.uint64(0xD6E8FEB86659FD93) + h[at + k]
    g = mix64(g)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        x = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            has = count[few] > k
            x[has] = x[has] * np.uint64(0xA0761D6478BD642F) + h[first[few[has]] + k]
        rows, g = np.concatenate([rows, few]), np.concatenate([g, mix64(x + count[few].astype(np.uint64))])
    return rows, g


def gram_sets(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct n-grams as ascending 48-bit integers, one row after the other, and where each row begins."""
    rows, g = grams(h, first, n)
    key = np.sort((rows.astype(np.uint64) << np.uint64(48)) | (g >> np.uint64(16)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    at = np.searchsorted(key >> np.uint64(48), np.arange(len(first)).astype(np.uint64))
    return (key & np.uint64((1 << 48) - 1)).astype(np.int64), at.astype(np.int64)


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, kind))
