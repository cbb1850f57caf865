"""Folds over the rows of a key in their order, with a state of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def keep_by_fold(rows: DataFrame, key: str, order: list[str], columns: list[str], step: Callable) -> DataFrame:
    """The rows that ``step`` keeps. ``step(state, values)`` gets the state of the key so far (None to begin with) and
    the row's ``columns``, and returns the new state and whether the row stays.

    Rows go to partitions by their key and are sorted there; a task reads them one batch after another and holds one
    state, so the rows of a key are never gathered.
    """
    dealt = rows.repartition(key).sortWithinPartitions(key, *order)

    def run(batches: Iterator[pa.RecordBatch]):
        at, state, begun = None, None, False
        for b in batches:
            kept = []
            for k, *values in zip(*(b.column(c).to_pylist() for c in (key, *columns)), strict=True):
                if not begun or k != at:
                    at, state, begun = k, None, True
                state, stays = step(state, values)
                kept.append(stays)
            yield b.filter(pa.array(kept, pa.bool_()))

    return dealt.mapInArrow(run, rows.schema)


def throttled(rows: DataFrame, key: str, time: str, value: str, *, seconds: float, moved: float, tie: str) -> DataFrame:
    """Reports of each key that are let through: the first, then each that is ``moved`` from the last one let through,
    and ``seconds`` later, at least."""

    def step(last, now):
        if last is None or ((now[0] - last[0]).total_seconds() >= seconds and abs(now[1] - last[1]) >= moved):
            return now, True
        return last, False

    return keep_by_fold(rows, key, [time, tie], [time, value], step)
