"""Results in batches of rows, with back-pressure: partitions come to the driver one after another, not all at once."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row

from corvane.functions.types import DialectError

BATCH = 64


def batches(df: DataFrame, size: int = BATCH, prefetch: bool = True) -> Iterator[list[Row]]:
    """df's rows, ``size`` at a time."""
    rows = df.toLocalIterator(prefetchPartitions=prefetch)
    while batch := list(islice(rows, size)):
        yield batch


class Cursor:
    """DECLARE, FETCH and CLOSE: forwards only."""

    def __init__(self, df: DataFrame):
        self._rows = df.toLocalIterator()
        self._open = True

    def fetch(self, count: int | None = 1) -> list[Row]:
        """The next ``count`` rows, or all that are left for None."""
        if not self._open:
            raise DialectError("34000", "cursor is closed")
        if count is not None and count < 0:
            raise DialectError("55000", "cursor can only scan forward")
        return list(self._rows if count is None else islice(self._rows, count))

    def close(self) -> None:
        self._open, self._rows = False, iter(())
