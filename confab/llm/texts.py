"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confab.functions.batches import text_blocks  # noqa: F401


def blocks(texts: list[str | None], max_chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``max_chars`` characters each, one row at least."""
    start = total = 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > start and total + n > max_chars:
            yield start, k
            start, total = k, 0
        total += n
    if texts:
        yield start, len(texts)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows, twice as many at most: those whose key hashes below a cut.

    The same rows at every run. A filter, not a sort: nothing but the sample leaves the
    tasks, however many there are. Up to ``rows`` rows are taken as they are.
    """
    total = df.count()
    if total <= rows:
        return df
    cut = int((rows / total - 0.5) * 2**64)
    return df.where(F.xxhash64(F.lit(20011), F.col(key)) < F.lit(max(-(2**63), cut)).cast("long")).limit(2 * rows)
