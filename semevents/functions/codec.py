"""Events to JSON and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import joined_in_order

_READ = "type string, name string, isTag boolean, attributes map<string,string>, text string"
_ALLOWED = {"text": ["type", "text"], "mark": ["type", "name", "isTag", "attributes"], "unmark": ["type", "name", "isTag"]}


def json_column() -> Column:
    """One event as JSON: the type first, false isTag and null attributes left out, empty attributes kept."""
    return F.to_json(F.struct(
        "type", "name", F.when(F.col("is_tag"), F.lit(True)).alias("isTag"), "attributes", "text",
    ))


def to_json(events: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    return events.select(*keys, "seq", json_column().alias("json"))


def to_json_lines(events: DataFrame, keys: tuple[str, ...] = ("doc_id",), documents: DataFrame | None = None) -> DataFrame:
    """One row a document: its events as JSON lines. ``documents`` (keys) adds those without events, as ''."""
    out = to_json(events, keys).groupBy(*keys).agg(joined_in_order(F.col("json"), "\n").alias("jsonl"))
    if documents is None:
        return out
    return documents.select(*keys).distinct().join(out, list(keys), "left").withColumn("jsonl", F.coalesce("jsonl", F.lit("")))


def _wrong(source: Column) -> Column:
    """What is wrong with an event's JSON, or null."""
    given = F.json_object_keys(source)
    kind = F.get_json_object(source, "$.type")
    allowed = F.when(kind == "text", F.array(*map(F.lit, _ALLOWED["text"]))).when(kind == "mark", F.array(*map(F.lit, _ALLOWED["mark"]))).otherwise(F.array(*map(F.lit, _ALLOWED["unmark"])))
    needed = F.when(kind == "text", F.get_json_object(source, "$.text")).otherwise(F.get_json_object(source, "$.name"))
    return (
        F.when(F.try_parse_json(source).isNull() | given.isNull(), "it is no JSON object")
        .when(kind.isNull() | ~kind.isin(list(_ALLOWED)), "its type is missing or unknown")
        .when(needed.isNull(), "a field is missing")
        .when(F.size(F.array_except(given, allowed)) > 0, "a key is unknown")
    )


def json_errors(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",), json_col: str = "json") -> DataFrame:
    """keys, seq, error: the lines that ``from_json`` would stop at, and why."""
    return lines.select(*keys, "seq", _wrong(F.col(json_col)).alias("error")).filter("error IS NOT NULL")


def from_json(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",), json_col: str = "json") -> DataFrame:
    """Events from one JSON text each. Malformed JSON, an unknown type or key, or a missing field is an error."""
    source = F.col(json_col)
    read = lines.select("*", F.from_json(source, _READ).alias("_e"), _wrong(source).alias("_wrong"), source.alias("_json"))
    kind = F.when(F.col("_wrong").isNull(), F.col("_e.type")).otherwise(F.raise_error(F.concat(F.lit("not an event: "), F.col("_wrong"), F.lit(": "), F.coalesce("_json", F.lit("null")))).cast("string"))
    text = F.col("_e.type") == "text"
    return read.select(
        *keys, "seq", kind.alias("type"), F.col("_e.name").alias("name"),
        F.when(~text, F.coalesce("_e.isTag", F.lit(False))).alias("is_tag"), F.col("_e.attributes").alias("attributes"), F.col("_e.text").alias("text"),
    )
