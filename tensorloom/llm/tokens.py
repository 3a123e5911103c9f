"""Words of many texts at once, as indexes into their distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def batch_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    r"""Distinct words, index of each word of all texts in order, and how many words each text has.

    Words are ``[^\x20\x09-\x0D]+`` of the text with A-Z lower-cased; a null text has none.
    """
    lowered = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    parts = pc.ascii_split_whitespace(lowered)
    offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
    flat = parts.flatten()
    real = pc.greater(pc.binary_length(flat), 0)  # white space at an end gives an empty part
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    counts = np.diff(before[offsets])
    coded = flat.filter(real).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), counts


#: Rows of a batch that ``slices`` gives: what a row costs beside its text is bounded too.
SLICE_ROWS = 1 << 16


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches whose texts in the column have about ``most`` bytes, of ``rows`` rows at most; a longer text ends its batch.

    Rows are copied: some Arrow kernels misread arrays that begin inside a buffer.
    """
    held: list[pa.RecordBatch] = []
    size = count = 0
    for batch in batches:
        length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        begin = 0
        for i, n in enumerate(length):
            size += n
            count += 1
            if size >= most or count >= rows:
                yield _joined([*held, batch.slice(begin, i + 1 - begin)])
                held, size, count, begin = [], 0, 0, i + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One batch whose arrays begin at their buffers' start."""
    solid = [b.take(pa.array(np.arange(b.num_rows))) for b in batches]
    if len(solid) == 1:
        return solid[0]
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in solid]) for i in range(solid[0].num_columns)], schema=solid[0].schema)
