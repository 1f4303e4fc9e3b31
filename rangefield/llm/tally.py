"""Sums by key inside a task, with bounded memory."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


class Tally:
    """Adds up tables by their key columns; keys are compared as values, not by hashes.

    Parts are merged when they reach `limit` rows.  If the merged table is still
    above half of that, it is given out, and later parts start anew, so a task
    holds no more than about `limit` rows; equal keys of different outputs are
    added by whoever reads them.
    """

    def __init__(self, keys: list[str], sums: list[str], limit: int = 1_000_000):
        self.keys, self.sums, self.limit = keys, sums, limit
        self.parts: list[pa.Table] = []
        self.rows = 0

    def _merged(self) -> pa.Table:
        whole = pa.concat_tables(self.parts)
        out = whole.group_by(self.keys).aggregate([(c, "sum") for c in self.sums])
        return out.select([*self.keys, *[f"{c}_sum" for c in self.sums]]).rename_columns([*self.keys, *self.sums])

    def add(self, part: pa.Table) -> Iterator[pa.RecordBatch]:
        self.parts.append(part)
        self.rows += part.num_rows
        if self.rows > self.limit:
            merged = self._merged()
            self.parts, self.rows = [merged], merged.num_rows
            if self.rows > self.limit // 2:
                yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What has not been given out."""
        if self.parts:
            out = self._merged()
            self.parts, self.rows = [], 0
            yield from out.combine_chunks().to_batches(max_chunksize=50_000)
