"""Columnar text helpers for the Python side of the operators.

Texts arrive as Arrow columns.  They are cut into chunks of a few megabytes and worked on as
flat byte arrays, so a task's memory does not depend on its partition, only on the longest
single text.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Text bytes that are worked on at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 4 << 20

# ASCII white space, which separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about CHUNK_BYTES of text each."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        piece = np.cumsum(sizes.to_numpy(zero_copy_only=False)) // CHUNK_BYTES
        starts = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(piece) else []
        for start, end in zip(starts, [*starts[1:], len(piece)], strict=True):
            yield batch.slice(start, end - start)


def map_chunks(function: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text"):
    """A function for mapInArrow that applies ``function`` to every chunk."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, column):
            made = function(chunk)
            if made is not None:
                yield made

    return apply


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than texts) and UTF-8 bytes of a text column; NULL is empty."""
    values = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(values):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, np.int64, len(values) + 1 + values.offset)[values.offset :]
    size = int(ends[-1] - ends[0])
    if not size:
        return np.zeros(len(values) + 1, np.int64), np.empty(0, np.uint8)
    return ends - ends[0], np.frombuffer(data, np.uint8, size, int(ends[0]))


def binary(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary column of consecutive values with the given lengths."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), buffers)


@dataclass
class Words:
    """Words of some texts in order: ``offsets`` has the texts' places in ``codes``."""

    offsets: np.ndarray
    codes: np.ndarray
    distinct: pa.Array  # large_binary, by code

    @property
    def owner(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def runs(
    offsets: np.ndarray, data: np.ndarray, inside: np.ndarray, cut: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True in ``inside`` that lie within one text.

    ``cut`` has by two bytes whether a run is cut between them.
    """
    apart = np.ones(len(inside) + 1, bool)
    apart[1:-1] = ~(inside[1:] & inside[:-1])
    if cut is not None:
        apart[1:-1] |= cut[data[:-1], data[1:]]
    apart[offsets] = True
    return np.flatnonzero(inside & apart[:-1]), np.flatnonzero(inside & apart[1:]) + 1


def encode(offsets: np.ndarray, starts: np.ndarray, lengths: np.ndarray, kept: np.ndarray) -> Words:
    """Dictionary-encode pieces that start at ``starts`` and whose bytes follow in ``kept``."""
    coded = binary(lengths, kept).dictionary_encode()
    places = np.searchsorted(starts, offsets)
    return Words(places, coded.indices.to_numpy(), coded.dictionary)


def words(texts: pa.Array, lower: bool = False, cut: np.ndarray | None = None) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text, A-Z lower-cased if asked for."""
    offsets, data = flat(texts)
    if lower:
        data = LOWER[data]
    solid = ~SPACE[data]
    starts, ends = runs(offsets, data, solid, cut)
    return encode(offsets, starts, ends - starts, data[solid])


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each text's values; 0 for a text without any."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def gather(offsets: np.ndarray, values: np.ndarray, codes: np.ndarray):
    """Lists ``values[offsets[c]:offsets[c + 1]]`` of all codes, one after the other.

    Returns the values and the length of each list.
    """
    lengths = np.diff(offsets)[codes]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total) + np.repeat(offsets[codes] - (ends - lengths), lengths)
    return values[index], lengths
