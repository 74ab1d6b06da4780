"""Ordered folds: a Python function over each group's rows, in order, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

ROWS = 10_000  # of an outgoing batch


def running_fold(df: DataFrame, key: str, order: list[str], fields: list[str], fold: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """(key, ...) rows that ``fold`` makes of each key's rows.

    ``fold`` gets the group's rows, one after the other, as tuples of ``fields``, sorted by
    ``order`` and then by the other fields, nulls first, and gives rows of ``schema``, which
    leaves the key out. Rows are shuffled and sorted by the JVM, which spills, and pass
    through Python a batch at a time: of a long group no more is held than ``fold`` keeps.
    """
    names = list(dict.fromkeys([key, *order, *fields]))
    rows = df.select(*names).repartition(key).sortWithinPartitions(*names)
    kind = df.select(key).limit(0).join(df.sparkSession.createDataFrame([], schema)).schema
    arrow = to_arrow_schema(kind)
    where = [names.index(f) for f in fields]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            yield from zip(columns[0], zip(*[columns[k] for k in where]))

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for k, group in groupby(keyed(batches), key=itemgetter(0)):
            for row in fold(row for _, row in group):
                out.append((k, *row))
                if len(out) >= ROWS:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)

    return rows.mapInArrow(run, kind)


def ordered_fold(df: DataFrame, key: str, order: list[str], fields: list[str], fold: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """:func:`running_fold` for a ``fold`` that has to see its group as a list, which must then fit in memory."""
    return running_fold(df, key, order, fields, lambda rows: fold(list(rows)), schema)
