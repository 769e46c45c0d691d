"""Greedy cuts by accumulated size, where the sum starts anew after each cut."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame


def _fold(groups: int, limit: int, over: bool):
    def run(batches):
        current, at, total = None, 0, 0
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(groups)), strict=True))
            out = []
            for key, size in zip(keys, batch.column("_size").to_pylist(), strict=True):
                if key != current:
                    current, at, total = key, 0, 0
                out.append(at)
                total += size
                if total > limit if over else total >= limit:
                    at, total = at + 1, 0
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.int64())], names=[*batch.schema.names[:-1], "cut"])

    return run


def greedy_cuts(rows: DataFrame, group: list[str], order: list[str], size, limit: int, over: bool = False) -> DataFrame:
    """rows with ``cut``, from 0 in each group: a cut closes once its sizes reach ``limit`` (or, with over, exceed it).

    The fold is sequential in a group by nature. Groups are spread over tasks and
    streamed in order, so a task holds one batch of rows, whatever a group's length.
    """
    rest = [c for c in rows.columns if c not in group]
    laid = rows.select(*group, *rest, size.cast("long").alias("_size"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in laid.drop("_size").schema.fields) + ", cut long"
    return laid.repartition(*group).sortWithinPartitions(*group, *order).mapInArrow(_fold(len(group), limit, over), schema)
