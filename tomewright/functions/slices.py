"""Python over Arrow arrays of long texts, a few at a time, so that what it holds besides its batch does not grow with the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts, and their bytes, that are Python objects at once; a longer text is alone.
ROWS, BYTES = 256, 1 << 20


def slices(values: pa.Array) -> Iterator[pa.Array]:
    upto = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(values):
        before = upto[at - 1] if at else 0
        end = max(at + 1, min(at + ROWS, int(np.searchsorted(upto, before + BYTES, side="right"))))
        yield values.slice(at, end - at)
        at = end


def by_slices(work: Callable[[list], list], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """An Arrow function from one of Python lists."""

    def run(values: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], kind), *[pa.array(work(some.to_pylist()), kind) for some in slices(values)]])

    return run
