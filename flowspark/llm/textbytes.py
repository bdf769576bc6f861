"""Vectorised helpers over the UTF-8 bytes of an Arrow batch of texts.

A batch is cut into slices of a few MB, so that the numpy arrays of a task stay
small whatever the batch size; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
_MULT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS: list[np.ndarray] = []


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, offsets, bytes) of slices holding about ``limit`` text bytes; null counts as empty."""
    texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield batch.slice(at, end - at), offsets[at:end + 1] - offsets[at], data[offsets[at]:offsets[end]]
        at = end


def byte_class(members: str | bytes) -> np.ndarray:
    """Table of 256 booleans, true at the given ASCII characters."""
    table = np.zeros(256, bool)
    table[np.frombuffer(members.encode("ascii") if isinstance(members, str) else members, np.uint8)] = True
    return table


#: The blanks that end a word in the contracts' patterns.
BLANK = byte_class(b" \t\n\x0b\x0c\r")
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, member: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``member`` bytes, and where each text's runs begin."""
    inside = member[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    after[first[first > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        out = []
        for m in (_MULT, pow(_MULT, -1, 1 << 64)):
            p = np.full(size, m, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash: ``span_hashes`` reads the hash of any byte span from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _powers(len(data))[0][:len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): equal bytes give equal hashes wherever they stand."""
    inverse = _powers(len(prefix) - 1)[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (len(words) - k + 1 of them)."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += words[i:i + n] * np.uint64(pow(_MULT, 2 * i + 3, 1 << 64))
    return mix(out)
