"""Vectorised work on Arrow string columns: words, word hashes and shingles of many texts at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. A null text counts as an empty text.
Hashes are 64-bit and depend only on the bytes of a word, so they agree between executors and runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; the numpy temporaries are a few dozen times as large.
SLICE_BYTES = 1 << 20
SLICE_ROWS = 4096
_POW_LEN = 1 << 12
_MULT = 0x9E3779B97F4A7C15 | 1


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives back the memory it doesn't use: idle workers wait beside the next stage's."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def release() -> None:
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MULT))
_POW = np.cumprod(np.full(_POW_LEN, _MULT, dtype=np.uint64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def slices(column: pa.Array | pa.ChunkedArray, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of runs of whole texts of about most_bytes; one longer text is a run alone."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, side="right")) - 1
        j = min(n, i + most_rows, max(i + 1, j))
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


#: For words without punctuation: every ASCII character but letters and digits separates.
PUNCTUATION = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the index of its first word (one entry more than texts)."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    solid = ~space[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    cuts = offsets[:-1]
    cuts = cuts[cuts < len(data)]
    opens[cuts] = solid[cuts]
    closes = np.empty(len(data), dtype=bool)
    closes[:-1] = solid[:-1] & ~solid[1:]
    closes[-1] = solid[-1]
    last = cuts[cuts > 0] - 1
    closes[last] = solid[last]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return prefix_hashes(data, starts, ends)[0]


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Hashes of the words and, for each size, of the first so many bytes of each word, of all of it if it has fewer."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in range(1 + len(sizes))]
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    code = _BYTE_HASH[data[place + np.repeat(starts, lengths)]]
    far = place >= _POW_LEN
    if far.any():
        code = np.where(far, mix64(code + place.astype(np.uint64)), code)
    code *= _POW[place & (_POW_LEN - 1)]
    out = [mix64(np.add.reduceat(code, first) + lengths.astype(np.uint64))]
    if sizes:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code)])  # modulo 2**64, as the hash itself
        for size in sizes:
            short = np.minimum(lengths, size)
            out.append(mix64(sums[first + short] - sums[first] + short.astype(np.uint64)))
    return out


def chain(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width consecutive entries; the last width - 1 starts have none."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= np.uint64(_MULT)
        out += hashes[k : k + n]
    return mix64(out)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle hash) of all runs of width words inside one text; a text of 1 to width - 1 words has one shingle of them all."""
    counts = np.diff(first)
    texts = np.repeat(np.arange(len(counts)), counts)
    runs = chain(hashes, width)
    whole = texts[: len(runs)] == texts[width - 1 :] if len(runs) else np.zeros(0, bool)
    own, values = texts[: len(runs)][whole], runs[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        few = np.array([chain(hashes[first[t] : first[t + 1]], int(counts[t]))[0] for t in short], dtype=np.uint64)
        own, values = np.concatenate([own, short]), np.concatenate([values, few])
        order = np.argsort(own, kind="stable")
        own, values = own[order], values[order]
    return own, values


def text_shingles(column: pa.Array, width: int = 5, most_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, text, shingle) for each slice of a column."""
    for at, rows, data, offsets in slices(column, most_bytes):
        starts, ends, first = word_spans(data, offsets)
        yield at, rows, *shingles(word_hashes(data, starts, ends), first, width)
