"""Words of Arrow string batches, with distinct words taken once; shared by operators that run in Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of about so many bytes, which bounds a worker's memory; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20
SLICE_ROWS = 1 << 15


def trimmed() -> None:
    """Gives free memory back to the system: a worker lives on for other stages, and its heap would stay as large as its largest slice made it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; elsewhere the allocator is left alone
    if trim:
        trim(0)


def slices(batches, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in runs of ``most`` bytes of text and SLICE_ROWS rows at most; free memory goes back between them."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            base = ends[start] - size[start]
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            stop = min(stop, start + SLICE_ROWS)
            yield batch.slice(start, stop - start)
            start = stop
            trimmed()


def words(column: pa.Array, lower_ascii: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(codes, bounds, distinct)``: row r's words ``[^\\x20\\x09-\\x0D]+`` are ``distinct[codes[bounds[r]:bounds[r + 1]]]``."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(column)
    bounds, values = np.asarray(split.offsets, dtype=np.int64), split.values
    # Lower-cased here: over a slice of an array, ascii_lower reads the wrong bytes in this version of Arrow.
    coded = (pc.ascii_lower(values) if lower_ascii else values).dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:  # white space at either end of a text
        keep = codes != empty
        bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
        codes = codes[keep]
    return codes, bounds, coded.dictionary


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[starts[i] : starts[i] + lengths[i]]`` of every i, end to end."""
    total = int(lengths.sum())
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(total)
    return values[at]
