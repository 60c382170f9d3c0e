"""Whole Arrow batches of texts cut into words and hashed with numpy, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15 | 1
_POW: list[np.ndarray] = []


def _table(seps: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(seps)] = True
    return t


#: White space of the near-duplicate contract.
SPACES = _table(b"\x20\x09\x0a\x0b\x0c\x0d")
#: All of ASCII but letters and digits.
NON_ALNUM = _table(bytes(i for i in range(128) if not chr(i).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A random 64-bit value for each byte, A-Z as a-z.
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)[LOWER]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits each depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 20)
        out = []
        for base in (_P, pow(_P, -1, 2**64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _POW[:] = out
    return _POW[0], _POW[1]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", budget: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The batches in runs of whole rows of about `budget` bytes of text: (rows, bytes, offsets). Bounds
    the memory of what is computed for each byte, whatever the batch size."""
    for rb in batches:
        data, off = text_bytes(rb.column(rb.schema.get_field_index(text)))
        i, n = 0, rb.num_rows
        while i < n:
            j = max(i + 1, min(n, int(np.searchsorted(off, off[i] + budget, "right")) - 1))
            yield rb.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def spans(data: np.ndarray, off: np.ndarray, seps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words; words of text d are first[d] up to first[d + 1]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~seps[data]
    s, e = inside.copy(), inside.copy()
    s[1:] &= ~inside[:-1]
    e[:-1] &= ~inside[1:]
    begin = off[:-1][off[:-1] < off[1:]]
    s[begin] = inside[begin]
    last = off[1:][off[:-1] < off[1:]] - 1
    e[last] = inside[last]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, A-Z as a-z, from one running sum of byte values times powers."""
    out = np.empty(len(starts), np.uint64)
    i, step = 0, 1 << 19
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + step, "right")))
        n = int(ends[j - 1] - at)
        up, down = powers(n + 1)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data[at : at + n]] * up[:n], out=run[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (run[e] - run[s]) * down[s]
        i = j
    return mix(out)


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of the runs of n words of each text; a text of fewer words, but one at least, has
    its whole sequence as its only one."""
    count = np.diff(first)
    m = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(m)])
    out = np.empty(bounds[-1], np.uint64)
    if len(h) >= n:
        g = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            g = mix(g * np.uint64(_P) + h[k : len(h) - n + 1 + k])
        long = np.flatnonzero(count >= n)
        src = np.repeat(first[:-1][long] - bounds[:-1][long], m[long]) if len(long) else np.zeros(0, np.int64)
        dst = np.flatnonzero(np.repeat(count >= n, m))
        out[dst] = g[dst + src]
    for d in np.flatnonzero((count > 0) & (count < n)):
        g = np.zeros(1, np.uint64)
        for x in h[first[d] : first[d + 1]]:
            g = mix(g * np.uint64(_P) + x)
        out[bounds[d]] = mix(g + np.uint64(count[d]))[0]
    return out, bounds
