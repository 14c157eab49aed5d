"""Markdown documents and chunks to events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FIELDS
from .kernel import MarkdownKernel

#: A text without these needs no kernel: no inline control character, no line that begins like a block.
NEEDS_KERNEL = r"[*_`~^=$\[<\\]|(?m)^[#`\-|>$<0-9]"
_KINDS = [("seq", pa.int32()), ("type", pa.string()), ("name", pa.string()), ("is_tag", pa.bool_()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string())]


def event_arrays(rows: list[list], keys: list[pa.Array], names: list[str], source: list[int]) -> pa.RecordBatch:
    """A batch of events: ``source`` is the input row of each, whose keys it repeats."""
    take = pa.array(source, pa.int32())
    columns = [k.take(take) for k in keys]
    for i, (_, kind) in enumerate(_KINDS):
        values = [r[i] for r in rows]
        columns.append(pa.array([None if v is None else list(v.items()) for v in values] if pa.types.is_map(kind) else values, kind))
    return pa.RecordBatch.from_arrays(columns, names=[*names, *(n for n, _ in _KINDS)])


def parsed_by(df: DataFrame, keys: tuple[str, ...], column: str, parse) -> DataFrame:
    """Events of each row's ``column``, by a function from text to event tuples: a narrow map over Arrow batches."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema), FIELDS])
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, source = [], []
            for i, text in enumerate(batch.column(len(names)).to_pylist()):
                for n, e in enumerate(parse(text or "")):
                    rows.append([n, *e])
                    source.append(i)
                if len(rows) > 50_000:
                    yield event_arrays(rows, batch.columns[: len(names)], names, source)
                    rows, source = [], []
            yield event_arrays(rows, batch.columns[: len(names)], names, source)

    return df.select(*keys, column).mapInArrow(run, schema)


def parse(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", tag_names: tuple[str, ...] = (), normalize_newlines: bool = False, prose: bool = True, parser=None) -> DataFrame:
    """Events of Markdown documents, in incremental form (``coalesce_text`` makes the normal form).

    Documents that are plain prose are split into paragraphs by Catalyst; only the others go to the kernel.
    ``parser`` replaces the kernel by any function from text to event tuples. Null texts have no events.
    """
    kernel = lambda text: MarkdownKernel(tag_names, normalize_newlines).parse(text)
    if parser is not None or not prose:
        return parsed_by(docs, keys, text_col, parser or kernel)
    text = F.coalesce(F.col(text_col), F.lit(""))
    if normalize_newlines:
        text = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    rest = docs.filter(text.rlike(NEEDS_KERNEL))
    lines = docs.filter(~text.rlike(NEEDS_KERNEL)).select(*keys, F.posexplode(F.filter(F.split(text, "\n"), lambda x: x != "")).alias("line", "body"))
    event = lambda kind, body: F.struct(F.lit(kind).alias("type"), body.alias("text"))
    none = F.lit(None).cast("string")
    three = F.posexplode(F.array(event("mark", none), event("text", F.col("body")), event("unmark", none))).alias("k", "e")
    is_text = F.col("e.type") == "text"
    plain = lines.select(*keys, "line", "body", three).select(
        *keys, (F.col("line") * 3 + F.col("k")).cast("int").alias("seq"), F.col("e.type").alias("type"),
        F.when(~is_text, "p").alias("name"), F.when(~is_text, F.lit(False)).alias("is_tag"),
        F.lit(None).cast("map<string,string>").alias("attributes"), F.col("e.text").alias("text"),
    )
    return plain.unionByName(parsed_by(rest, keys, text_col, kernel))


def parse_chunks(chunks: DataFrame, keys: tuple[str, ...] = ("doc_id",), order: str = "chunk_seq", chunk_col: str = "chunk") -> DataFrame:
    """Events of documents that come as ordered chunks (batch): the chunks of a document are joined, then parsed."""
    whole = chunks.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(chunk_col, F.lit("")).alias("c")))), lambda x: x["c"]), "").alias("text")
    )
    return parse(whole, keys)
