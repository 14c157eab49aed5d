"""Events to HTML: pretty and compact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import close_tag, escape_text, is_block, joined_in_order, open_tag
from ..model import by_document
from .documents import passed


def _layout(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Level, open ``pre`` elements, open namespaced elements and whether a line has just begun: running aggregates over
    one window, so a document is sorted once."""
    w = by_document(keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    mark, unmark, text = (F.col("type") == k for k in ("mark", "unmark", "text"))
    name = F.coalesce("name", F.lit(""))

    def around(condition) -> F.Column:
        delta = F.when(mark & condition, 1).when(unmark & condition, -1).otherwise(0)
        return F.sum(delta).over(upto) - (mark & condition).cast("int")

    out = events.withColumn("_level", around(F.lit(True))).withColumn("_pre", around(name == "pre")).withColumn("_raw", around(name.contains(":")))
    block = is_block(name) & (F.col("_pre") == 0)
    plain = (F.col("_pre") <= 0) & (F.col("_raw") <= 0)
    sets = (
        F.when(text & (F.col("text") == ""), F.lit(None).cast("boolean"))
        .when(text, plain & F.endswith("text", F.lit("\n")))
        .when(mark, block)
        .when(block, F.lit(True))
    )
    return out.withColumn("_sets", sets).withColumn("_fresh", F.coalesce(F.last("_sets", True).over(before), F.lit(True))).drop("_sets")


class _Layout:
    """The same for a stream, in one pass: ``block`` tells block elements, ``ends`` texts that end a line."""

    def __init__(self):
        self.level, self.pre, self.raw, self.fresh = 0, 0, 0, True

    def step(self, kind: str, name: str | None, block: bool, ends: bool, empty: bool) -> tuple[int, int, int, int]:
        pre, raw = int(name == "pre"), int(":" in (name or ""))
        if kind == "unmark":
            self.level, self.pre, self.raw = self.level - 1, self.pre - pre, self.raw - raw
        out = self.level, self.pre, self.raw, int(self.fresh)
        if kind == "text":
            self.fresh = self.fresh if empty else bool(self.pre <= 0 and self.raw <= 0 and ends)
        elif kind == "mark":
            self.fresh = bool(block and self.pre == 0)
            self.level, self.pre, self.raw = self.level + 1, self.pre + pre, self.raw + raw
        elif block and self.pre == 0:
            self.fresh = True
        return out

    def state(self) -> dict:
        return vars(self)

    def restore(self, state: dict) -> None:
        vars(self).update(state)


def _layout_of_stream(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    marks = events.select(
        "*", F.coalesce(is_block(F.col("name")), F.lit(False)).alias("_block"),
        F.coalesce(F.endswith("text", F.lit("\n")), F.lit(False)).alias("_ends"), F.coalesce(F.col("text") == "", F.lit(False)).alias("_empty"),
    )
    out = passed(marks, keys, _Layout, ("type", "name", "_block", "_ends", "_empty"), "_level int, _pre int, _raw int, _fresh int")
    return out.withColumn("_fresh", F.col("_fresh") == 1).drop("_block", "_ends", "_empty")


def fragments(events: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``events`` with ``frag``: what each event adds to the pretty HTML. It depends on earlier events only.

    ``events`` may be a stream whose events of a document come in order; joined in that order, the fragments are the
    document's HTML, but for a newline at its end.
    """
    mark, unmark, text = (F.col("type") == k for k in ("mark", "unmark", "text"))
    name = F.coalesce("name", F.lit(""))
    out = _layout_of_stream(events, keys) if events.isStreaming else _layout(events, keys)
    block = is_block(name) & (F.col("_pre") == 0)
    plain = (F.col("_pre") <= 0) & (F.col("_raw") <= 0)
    indent = F.repeat(F.lit("  "), F.greatest(F.col("_level"), F.lit(0)).cast("int"))
    fresh = F.col("_fresh")
    own_line = lambda tag: F.concat(F.when(fresh, "").otherwise("\n"), indent, tag, F.lit("\n"))
    body = F.when(F.col("_raw") > 0, F.col("text")).otherwise(escape_text(F.col("text")))
    # a lone dollar or backslash in the replacement would be read as a group; indentation has neither
    lines = F.regexp_replace(body, F.lit("\n(?=[^\n])"), F.concat(F.lit("\n"), indent))
    flowing = F.concat(F.when(fresh & (F.col("text") != "") & ~F.startswith("text", F.lit("\n")), indent).otherwise(""), lines)
    opening, closing = open_tag(name, F.col("attributes")), close_tag(name)
    frag = (
        F.when(text, F.when(plain, flowing).otherwise(body))
        .when(mark & block, own_line(opening))
        .when(mark, F.concat(F.when(fresh & (F.col("_pre") == 0), indent).otherwise(""), opening))
        .when(block, own_line(closing))
        .otherwise(closing)
    )
    return out.withColumn("frag", frag).drop("_level", "_pre", "_raw", "_fresh")


def _with_all(out: DataFrame, keys: tuple[str, ...], documents: DataFrame | None) -> DataFrame:
    if documents is None:
        return out
    return documents.select(*keys).distinct().join(out, list(keys), "left").withColumn("html", F.coalesce("html", F.lit("")))


def render(events: DataFrame, keys: tuple[str, ...] = ("doc_id",), documents: DataFrame | None = None) -> DataFrame:
    """Pretty HTML of each document, without a newline at its end. ``documents`` adds those without events, as ''."""
    out = fragments(events, keys).groupBy(*keys).agg(F.regexp_replace(joined_in_order(F.col("frag")), r"\n\z", "").alias("html"))
    return _with_all(out, keys, documents)


def to_html_compact(events: DataFrame, keys: tuple[str, ...] = ("doc_id",), documents: DataFrame | None = None) -> DataFrame:
    """HTML of each document without added white space, as a DOM's inner HTML."""
    frag = F.when(F.col("type") == "mark", open_tag(F.col("name"), F.col("attributes"))).when(F.col("type") == "unmark", close_tag(F.col("name"))).otherwise(escape_text(F.col("text")))
    out = events.groupBy(*keys).agg(joined_in_order(frag).alias("html"))
    return _with_all(out, keys, documents)
