"""Word shingles of whole texts as 64-bit hashes, made with numpy over many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

K = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D | 1
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_power: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64."""
    if not _power or len(_power[0]) < n:
        n = max(n, 1 << 19)
        inverse = pow(BASE, -1, 2**64)
        _power[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, np.uint64(b))])) for b in (BASE, inverse)]
    return _power[0], _power[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many each text has. Words are runs without white space; A-Z count as a-z."""
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * K)
    at = np.cumsum([0] + [len(t) + 1 for t in raw])
    return words, np.diff(np.searchsorted(starts, at))


def shingle_sets(raw: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of all its words, if it has fewer."""
    words, counts = word_hashes(raw)
    rolled = np.zeros(len(words), np.uint64)
    for j in range(k):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + np.concatenate([words[j:], np.zeros(min(j, len(words)), np.uint64)])
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            out.append(np.unique(rolled[at : at + n - k + 1]))
        elif n:
            h = np.uint64(n)
            for w in words[at : at + n]:
                h = mix(np.array([h * K + w], np.uint64))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def each(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle set) of a batch."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
    ends = np.cumsum([len(x) for x in (t.as_buffer() for t in texts)]) if len(texts) else []
    at = 0
    while at < len(ends):
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + 500_000, side="right")))
        with np.errstate(over="ignore"):
            yield from enumerate(shingle_sets(texts.slice(at, end - at).to_pylist()), at)
        at = end
