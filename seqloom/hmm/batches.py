"""Sequences of an Arrow batch side by side: grouped by length, so that neither
one long sequence nor many short ones fill the memory.

One rule for tokens holds in all of the library.  Null or negative: missing; a
model sums over what it may be, an automaton reads it as a token that no
constraint names.  Beyond the model's vocabulary: the model can't emit it, so the
sequence has probability 0 from there on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MISSING = -1


def grouped(tokens: pa.ListArray, width: int, cells: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, x, n): rows of the batch, their tokens filled up at the end with missing
    ones, and their lengths, shortest first.  Rows times places times ``width``
    stay within ``cells``, or a group has one row."""
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.maximum(pc.fill_null(pc.cast(tokens.flatten(), pa.int64()), MISSING).to_numpy(zero_copy_only=False), MISSING)
    starts, order, at = np.cumsum(lengths) - lengths, np.argsort(lengths, kind="stable"), 0
    while at < len(order):
        # the longest of a group is its last: the largest group that fits, by doubling down
        size = np.arange(1, len(order) - at + 1) * np.maximum(lengths[order[at:]], 1) * width
        end = at + max(1, int(np.searchsorted(size, cells, "right")))
        rows = order[at:end]
        n = lengths[rows]
        x = np.full((len(rows), max(1, int(n[-1]))), MISSING, np.int64)
        there = np.arange(x.shape[1]) < n[:, None]
        x[there] = values[(starts[rows][:, None] + np.arange(x.shape[1]))[there]]
        yield rows, x, n
        at = end
