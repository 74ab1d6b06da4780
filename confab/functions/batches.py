"""Arrow batches of texts, a bounded run of them at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def text_blocks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of rows holding about ``max_bytes`` each, one row at least.

    An Arrow batch holds as many rows as the session says, however long their texts are;
    only a run of them at a time is turned into Python strings.
    """
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > max_bytes:
            yield start, column.slice(start, k - start).to_pylist()
            start, total = k, 0
        total += n
    if sizes:
        yield start, column.slice(start).to_pylist()
