"""Imperative passes over documents: the events of each in order, with state no larger than the pass keeps.

In batch a document's rows follow each other in one task after one shuffle and one sort; rows stream through, so that no
document is held as a whole. On a stream the state lies in Spark's state store between micro-batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Pass(Protocol):
    """One document's pass: ``step`` takes a row's values and gives those of the new columns; ``state`` can be restored."""

    def step(self, *values): ...

    def state(self) -> dict: ...

    def restore(self, state: dict) -> None: ...


def clustered(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The events of each document one after the other, in order."""
    return events.repartition(*keys).sortWithinPartitions(*keys, "seq")


def passed(events: DataFrame, keys: tuple[str, ...], make: Callable[[], Pass], reads: tuple[str, ...], adds: str) -> DataFrame:
    """``events`` with the columns ``adds`` (DDL) that each document's pass makes from ``reads``; batch or stream."""
    names = [x.split()[0] for x in adds.split(", ")]
    if events.isStreaming:
        return _streamed(events, keys, make, reads, adds, names)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in events.schema), adds])
    place = {c: i for i, c in enumerate(events.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            out = []
            for key, values in zip(_rows(batch, [place[k] for k in keys]), _rows(batch, [place[c] for c in reads]), strict=True):
                if own is None or key != last:
                    last, own = key, make()
                out.append(own.step(*values))
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), pa.int32()) for c in columns)], names=[*batch.schema.names, *names])

    return clustered(events, keys).mapInArrow(run, schema)


def _rows(batch: pa.RecordBatch, columns: list[int]) -> Iterator[tuple]:
    return zip(*[batch.column(i).to_pylist() for i in columns], strict=True)


def _streamed(events: DataFrame, keys: tuple[str, ...], make: Callable[[], Pass], reads: tuple[str, ...], adds: str, names: list[str]) -> DataFrame:
    """The same on a stream. Attributes travel as JSON, as maps do not survive pandas."""
    flat = events.withColumn("attributes", F.to_json("attributes"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in flat.schema), adds])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = make()
        if state.exists:
            own.restore(json.loads(state.get[0]))
        frame = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = [own.step(*_plain(values)) for values in zip(*[frame[c] for c in reads], strict=True)]
        state.update((json.dumps(own.state()),))
        yield frame.assign(**{n: pd.array(list(c), dtype="Int32") for n, c in zip(names, zip(*out, strict=True), strict=True)})

    out = flat.groupBy(*keys).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)
    return out.withColumn("attributes", F.from_json("attributes", "map<string,string>"))


def _plain(values: tuple) -> tuple:
    """Values as batches have them: no arrays of numpy, no NaN for null."""
    return tuple(v.tolist() if hasattr(v, "tolist") else None if isinstance(v, float) and v != v else v for v in values)
