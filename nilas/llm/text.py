"""Words and shingles of whole Arrow text columns, as numpy arrays of 64-bit hashes.

A word is a run of bytes outside 0x20 and 0x09-0x0D; UTF-8 never uses those bytes
inside a longer character, so work on bytes gives the same words as work on characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at once, so that the arrays stay in the processor's cache.
CHUNK = 1 << 18
#: Bytes of text in one slice of a batch; a longer text is a slice of its own.
SLICE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
LOWER_BYTE = BYTE.copy()
LOWER_BYTE[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(n, base, U)]), dtype=U)


POWER, INVERSE = _powers(BASE, CHUNK), _powers(BASE_INVERSE, CHUNK)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as large_binary, nulls as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    col = col.cast(pa.large_string()) if pa.types.is_string(col.type) else col
    return col.cast(pa.large_binary()).fill_null(b"")


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a large_binary array."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE):
    """Parts of the batch with about `most` bytes of text at a time."""
    _, offsets = buffers(column(batch, name))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, bounds: bool = False):
    """Hash of each word and, for each text, where its words begin.

    Returns (hashes, word_offsets), and with bounds also the byte starts and ends of words.
    """
    table, total = (LOWER_BYTE if lower else BYTE), len(data)
    edge = np.zeros(total + 1, bool)
    edge[offsets] = True
    hashes, starts, ends, s = [], [], [], 0
    while s < total:
        e = min(total, s + CHUNK)
        if e < total:  # cut between words
            cuts = np.flatnonzero(SPACE[data[s:e]] | edge[s:e])
            if len(cuts) and cuts[-1] > 0:
                e = s + int(cuts[-1])
            else:
                while e < total and not edge[e] and not SPACE[data[e]]:
                    e += 1
        b = data[s:e]
        word = ~SPACE[b]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[s + 1 : e]
        last[:-1] &= ~word[1:] | edge[s + 1 : e]
        first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
        n = e - s
        power, inverse = (POWER, INVERSE) if n <= CHUNK else (_powers(BASE, n), _powers(BASE_INVERSE, n))
        sums = np.zeros(n + 1, U)
        np.cumsum(table[b] * power[:n], out=sums[1:])
        hashes.append(mix((sums[last] - sums[first]) * inverse[first]))
        starts.append(first + s)
        ends.append(last + s)
        s = e
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    hashes, starts = cat(hashes, U), cat(starts, np.int64)
    at = np.searchsorted(starts, offsets)
    return (hashes, at, starts, cat(ends, np.int64)) if bounds else (hashes, at)


def shingles(hashes: np.ndarray, at: np.ndarray, size: int, short: bool = True):
    """Hash of each run of `size` words, and where each text's runs begin.

    A text with fewer words has its whole sequence as its one shingle if `short`, else none.
    """
    n, counts = len(hashes), np.diff(at)
    runs = np.zeros(max(0, n - size + 1), U)
    for k in range(size):
        runs = mix(runs * U(0xD1342543DE82EF95) + hashes[k : n - size + 1 + k]) if len(runs) else runs
    last = np.repeat(at[1:], counts)[: len(runs)]
    runs = runs[np.arange(len(runs)) + size <= last]
    each = np.maximum(counts - size + 1, 0)
    if short and (few := np.flatnonzero((counts > 0) & (counts < size))).size:
        where = (np.cumsum(each) - each)[few]
        values = []
        for i in few:
            h = np.zeros(1, U) + U(counts[i])
            for x in hashes[at[i] : at[i + 1]]:
                h = mix(h * U(0xD1342543DE82EF95) + x)
            values.append(h[0])
        runs = np.insert(runs, where, np.array(values, U))
        each[few] = 1
    return runs, np.concatenate([[0], np.cumsum(each)])


#: Words put together at once.
WORD_BLOCK = 1 << 18


def rejoined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> pa.Array:
    """A text a row of the chosen words, one space between them; at: where each row's words begin."""
    blank = np.ones(len(starts), np.int64)
    blank[at[1:][np.diff(at) > 0] - 1] = 0  # none after a row's last word
    size = ends - starts + blank
    to = np.concatenate([[0], np.cumsum(size)])
    parts = []
    for i in range(0, len(starts), WORD_BLOCK):
        j = min(len(starts), i + WORD_BLOCK)
        index = np.arange(to[i], to[j]) + np.repeat(starts[i:j] - to[i:j], size[i:j])
        part = data[np.minimum(index, len(data) - 1)]
        part[to[i + 1 : j + 1][blank[i:j] == 1] - 1 - to[i]] = 0x20
        parts.append(part)
    whole = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    out = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(to[at].astype(np.int64)), pa.py_buffer(whole)])
    return out.cast(pa.large_string())
