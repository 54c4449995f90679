"""Words and word hashes of whole Arrow text columns, in numpy.

The classes of bytes below only separate at ASCII bytes, so working on UTF-8
bytes gives the same words as working on characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Text bytes handled at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20
#: And texts, for what is kept per text.
SLICE_ROWS = 4096

#: Bytes of words that are runs without white space (0x20, 0x09 to 0x0D).
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words that are runs of letters and digits: ASCII digits and lower
#: case, and whatever is not ASCII (text is lower-cased first).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: Lower-cases A-Z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_powers: list[np.ndarray] = [np.ones(0, dtype=U64), np.ones(0, dtype=U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (or a binary column's) end to end, and where each text begins
    and ends. Null counts as empty."""
    wide = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, b"" if wide == pa.large_binary() else "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in order, cut so that texts stay under ``limit``
    bytes together (a longer text comes alone) and are ``rows`` at most."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    at = 0
    while at < batch.num_rows:
        to = min(max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1), at + rows)
        yield batch.slice(at, to - at)
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and for each text the index of its first
    word (with the total at the end)."""
    inside = is_word[data]
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = inside
    first = before.copy()
    first[offsets] = False  # a text's first byte has nothing before it
    starts = np.flatnonzero(inside & ~first[:-1])
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, well mixed."""
    up, down = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` word hashes (text borders are the
    caller's business)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    up, down = _power_tables(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=U64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix64((total[k:] - total[:n]) * down[:n] + U64(k))


def owner(first: np.ndarray) -> np.ndarray:
    """For each word, the index of its text, from ``spans``' third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole_groups(batches: Iterator[pa.RecordBatch], group: str, limit: int) -> Iterator[pa.Table]:
    """Batches sorted by ``group``, gathered into tables of some ``limit`` rows
    that hold whole groups."""
    held: list[pa.RecordBatch] = []
    size, aim = 0, limit
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= aim:
            whole = pa.Table.from_batches(held)
            g = whole.column(group).to_numpy()
            # the last group may go on
            cut = int(np.flatnonzero(g != g[-1])[-1] + 1) if g[0] != g[-1] else 0
            if cut:
                yield whole.slice(0, cut)
                held = whole.slice(cut).combine_chunks().to_batches()
                size, aim = size - cut, limit
            else:
                aim = 2 * size
    if held:
        yield pa.Table.from_batches(held)
