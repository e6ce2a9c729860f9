"""Words of whole Arrow batches as numbers: what the shingle and window operators hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes and rows of text worked on at once; a longer text is a slice of its own.
SLICE_BYTES, SLICE_ROWS = 1_000_000, 4_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def release() -> None:
    """Gives the memory of freed Arrow buffers back: a worker that waits for its next task holds none of the last one's."""
    pa.default_memory_pool().release_unused()


def cuts(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, stop) of slices of at most `most` bytes and SLICE_ROWS rows."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, before + most, side="right"))), start + SLICE_ROWS)
        yield start, stop
        start = stop


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in cuts(batch.column(column), most):
            yield batch.slice(start, stop - start)
        del batch
        release()


def split(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(codes, distinct words, starts): words are runs of anything but ASCII white space; text i has the codes from
    starts[i] to starts[i + 1]."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    real = pc.greater(pc.binary_length(flat), 0)
    seen = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False).astype(np.int64))])
    counts = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    starts = seen[np.concatenate([[0], np.cumsum(counts.astype(np.int64))])]
    coded = flat.filter(real).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    x = x + M1
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def word_hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(w, seed) for w in distinct.to_pylist()), np.uint64, len(distinct))


def owner(starts: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def shingles(codes: np.ndarray, distinct: pa.Array, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every distinct k-word shingle, sorted by both. A text of fewer words is one shingle; without
    words it has none."""
    words = word_hashes(distinct)[codes] if len(codes) else np.empty(0, np.uint64)
    text, n = owner(starts), len(words)
    total = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        total = mix(total ^ words[j : n - k + 1 + j]) if len(total) else total
    left = starts[1:][text[: len(total)]] - np.arange(len(total))
    inside = left >= k
    texts, hashes = text[: len(total)][inside], total[inside]
    lengths = np.diff(starts)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for at, i in enumerate(short):
            h = np.uint64(lengths[i])
            for w in words[starts[i] : starts[i + 1]]:
                h = mix(np.array([h ^ w]))[0]
            extra[at] = h
        texts, hashes = np.concatenate([texts, short]), np.concatenate([hashes, extra])
    order = np.lexsort((hashes, texts))
    texts, hashes = texts[order], hashes[order]
    new = np.ones(len(texts), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (hashes[1:] != hashes[:-1])
    return texts[new], hashes[new]


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
