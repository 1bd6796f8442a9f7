"""Arrow batches taken in pieces of bounded text, and their words by position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text taken together, at most (one longer text is a piece of its own).
PIECE = 8 << 20


def starts(counts: np.ndarray) -> np.ndarray:
    """Offsets of lists of the given lengths, one more than there are lists."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE):
    """Slices of a batch whose texts have at most ``most`` bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        yield batch.slice(at, max(1, end - at))
        at = max(at + 1, end)


def coded_words(parts: pa.ListArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct strings, index of each string among them, offsets of each list); empty strings are dropped."""
    flat, offsets = parts.flatten(), parts.offsets.to_numpy()
    filled = pc.not_equal(flat, "")
    coded = flat.filter(filled).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), starts(filled.to_numpy(zero_copy_only=False))[offsets - offsets[0]]


def white_space_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """:func:`coded_words` of the white-space-free chunks of each text; null is empty."""
    return coded_words(pc.utf8_split_whitespace(pc.fill_null(texts, "")))
