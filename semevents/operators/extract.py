"""Extractors: the first occurrence of a tag in each document, and whatever else a class of one's own takes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import joined_in_order
from ..model import Event, by_document
from .documents import clustered


def extracted_events(events: DataFrame, tag: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Texts and ``tag`` events from the first mark of ``tag`` to the first unmark after it (or the end)."""
    whole = by_document(keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_tag = F.col("name") == tag
    first = F.min(F.when((F.col("type") == "mark") & is_tag, F.col("seq"))).over(whole)
    out = events.withColumn("_start", first)
    last = F.min(F.when((F.col("type") == "unmark") & is_tag & (F.col("seq") > F.col("_start")), F.col("seq"))).over(whole)
    out = out.withColumn("_end", last)
    return out.filter((F.col("seq") >= F.col("_start")) & (F.col("_end").isNull() | (F.col("seq") <= F.col("_end"))) & ((F.col("type") == "text") | is_tag))


def extract(events: DataFrame, tag: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row a document: tag, succeeded, is_extracting (never closed), attributes, content (null if none), events.

    ``events`` itself stays as it is; use both where both are wanted.
    """
    found = extracted_events(events, tag, keys).groupBy(*keys).agg(
        F.first("_end").isNotNull().alias("succeeded"),
        F.first("_end").isNull().alias("is_extracting"),
        F.max_by("attributes", F.when(F.col("type") == "mark", F.col("seq"))).alias("attributes"),
        F.nullif(joined_in_order(F.coalesce("text", F.lit(""))), F.lit("")).alias("content"),
        F.array_sort(F.collect_list(F.struct("seq", "type", "name", "is_tag", F.to_json("attributes").alias("attributes"), "text"))).alias("events"),
    )
    out = events.select(*keys).distinct().join(found, list(keys), "left")
    no = F.lit(False)
    return out.select(
        *keys, F.lit(tag).alias("tag"), F.coalesce("succeeded", no).alias("succeeded"), F.coalesce("is_extracting", no).alias("is_extracting"),
        "attributes", "content", F.coalesce("events", F.array().cast(found.schema["events"].dataType)).alias("events"),
    )


class Extractor(Protocol):
    """Sees a document's events in order. ``state`` must fit into JSON; streams keep it between micro-batches."""

    name: str
    is_extracting: bool
    attributes: dict[str, str] | None
    extracted: list[tuple[int, Event]]

    def process(self, seq: int, event: Event) -> None: ...

    def state(self) -> dict: ...

    def restore(self, state: dict) -> None: ...


class TagExtractor:
    """The first occurrence of ``name``: texts and marks of it up to its first unmark."""

    def __init__(self, name: str):
        self.name = name
        self.is_extracting = False
        self.attributes: dict[str, str] | None = None
        self.extracted: list[tuple[int, Event]] = []

    def process(self, seq: int, event: Event) -> None:
        kind, name, _, attributes, _ = event
        if kind == "mark" and name == self.name and (self.is_extracting or not self.extracted):
            self.is_extracting, self.attributes = True, attributes
        elif not self.is_extracting or kind != "text" and (kind == "mark" or name != self.name):
            return
        elif kind == "unmark":
            self.is_extracting = False
        self.extracted.append((seq, event))

    def state(self) -> dict:
        return {"is_extracting": self.is_extracting, "attributes": self.attributes, "extracted": self.extracted}

    def restore(self, state: dict) -> None:
        self.is_extracting, self.attributes = state["is_extracting"], state["attributes"]
        self.extracted = [(seq, tuple(e)) for seq, e in state["extracted"]]


_FOUND = "tag string, succeeded boolean, is_extracting boolean, attributes string, content string, events array<struct<seq:int,type:string,name:string,is_tag:boolean,attributes:string,text:string>>"


def _found(x: Extractor) -> tuple:
    dumped = lambda a: None if a is None else json.dumps(a, ensure_ascii=False, separators=(",", ":"))
    events = [dict(zip(("seq", "type", "name", "is_tag", "attributes", "text"), (seq, e[0], e[1], e[2], dumped(e[3]), e[4]), strict=True)) for seq, e in x.extracted]
    content = "".join(e[4] for _, e in x.extracted if e[0] == "text")
    return x.name, not x.is_extracting and bool(events), x.is_extracting, dumped(x.attributes), content or None, events


def extract_with(events: DataFrame, extractors: list[Callable[[], Extractor]], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row a document and extractor, as ``extract`` gives them; all extractors see a document in one pass.

    ``events`` may be a stream whose events of a document come in order: each micro-batch then gives new rows for the documents
    it has events of, with what has been found so far (output mode "update").
    """
    flat = events.select(*keys, "seq", "type", "name", "is_tag", F.to_json("attributes").alias("attributes"), "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.select(*keys).schema)
    schema, n = f"{kinds}, {_FOUND}", len(keys)
    columns = [*keys, "tag", "succeeded", "is_extracting", "attributes", "content", "events"]
    fields = pa.struct([("seq", pa.int32()), ("type", pa.string()), ("name", pa.string()), ("is_tag", pa.bool_()), ("attributes", pa.string()), ("text", pa.string())])
    types = [pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.list_(fields)]

    def see(own: list[Extractor], row: tuple) -> None:
        seq, kind, name, is_tag, attributes, text = row
        for x in own:
            x.process(int(seq), (kind, name, is_tag, None if attributes is None else json.loads(attributes), text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own, out, of = None, None, [], []

        def batch_of(kinds: list[pa.DataType]) -> pa.RecordBatch:
            keyed = [pa.array([k[i] for k in of], t) for i, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*keyed, *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], names=columns)

        kinds: list[pa.DataType] = []
        for batch in batches:
            kinds = [batch.column(i).type for i in range(n)]
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own is None or row[:n] != last:
                    out += [_found(x) for x in own or ()]
                    of += [last] * len(own or ())
                    last, own = row[:n], [make() for make in extractors]
                see(own, row[n:])
            if len(out) > 1000:
                yield batch_of(kinds)
                out, of = [], []
        if own is not None:
            out += [_found(x) for x in own]
            of += [last] * len(own)
            yield batch_of(kinds)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = [make() for make in extractors]
        if state.exists:
            for x, s in zip(own, json.loads(state.get[0]), strict=True):
                x.restore(s)
        frame = pd.concat(list(frames)).sort_values("seq", kind="stable")
        for row in zip(*[frame[c] for c in ("seq", "type", "name", "is_tag", "attributes", "text")], strict=True):
            see(own, tuple(None if v is None or v != v else v for v in row))
        state.update((json.dumps([x.state() for x in own]),))
        yield pd.DataFrame([(*key, *_found(x)) for x in own], columns=columns)

    if events.isStreaming:
        out = flat.groupBy(*keys).applyInPandasWithState(step, schema, "state string", "update", GroupStateTimeout.NoTimeout)
    else:
        out = clustered(flat, keys).mapInArrow(run, schema)
    return out.withColumn("attributes", F.from_json("attributes", "map<string,string>"))
