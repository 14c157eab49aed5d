"""The event table: ordered text / mark / unmark rows by document."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

FIELDS = "seq int, type string, name string, is_tag boolean, attributes map<string,string>, text string"
EVENT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("seq", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("is_tag", T.BooleanType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
])

Event = tuple[str, str | None, bool | None, dict[str, str] | None, str | None]


def text_event(text: str) -> Event:
    return ("text", None, None, None, text)


def mark_event(name: str, is_tag: bool = False, attributes: dict[str, str] | None = None) -> Event:
    return ("mark", name, is_tag, attributes, None)


def unmark_event(name: str, is_tag: bool = False) -> Event:
    return ("unmark", name, is_tag, None, None)


class EventBuilder:
    """Writes events by hand. ``produce_tags`` is the default of ``is_tag``; no attributes are null, ``{}`` is empty."""

    def __init__(self, produce_tags: bool = False):
        self.produce_tags = produce_tags
        self.events: list[Event] = []

    def text(self, text: str) -> EventBuilder:
        self.events.append(text_event(text))
        return self

    __iadd__ = text

    def mark(self, name: str, is_tag: bool | None = None, attributes: dict[str, str] | None = None) -> EventBuilder:
        self.events.append(mark_event(name, self.produce_tags if is_tag is None else is_tag, attributes))
        return self

    def unmark(self, name: str, is_tag: bool | None = None) -> EventBuilder:
        self.events.append(unmark_event(name, self.produce_tags if is_tag is None else is_tag))
        return self

    @contextmanager
    def element(self, name: str, attributes: dict[str, str] | None = None, is_tag: bool | None = None):
        self.mark(name, is_tag, attributes)
        yield self
        self.unmark(name, is_tag)

    def tag(self, name: str, attributes: dict[str, str] | None = None):
        return self.element(name, attributes, True)

    def frame(self, spark: SparkSession, doc_id: int = 0) -> DataFrame:
        return events_frame(spark, {doc_id: self.events})


def events_frame(spark: SparkSession, documents: dict[int, list[Event]]) -> DataFrame:
    rows = [(d, i, *e) for d, events in documents.items() for i, e in enumerate(events)]
    return spark.createDataFrame(rows, EVENT)


def by_document(keys: tuple[str, ...] = ("doc_id",)):
    """The one window of all event operators: a document in order. Spark sorts once for all that share it."""
    return Window.partitionBy(*keys).orderBy("seq")


def coalesce_text(events: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Normal form: adjacent texts become one, empty texts go, ``seq`` counts from 0 again."""
    w = by_document(keys)
    kept = events.filter("type <> 'text' OR text <> ''")
    starts = (F.col("type") != "text") | (F.coalesce(F.lag("type").over(w), F.lit("")) != "text")
    run = F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    joined = kept.withColumn("run", run.cast("int")).groupBy(*keys, "run").agg(
        *[F.first(c).alias(c) for c in ("type", "name", "is_tag", "attributes")],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("joined"),
    )
    return joined.select(*keys, F.col("run").alias("seq"), "type", "name", "is_tag", "attributes", F.when(F.col("type") == "text", F.col("joined")).alias("text"))


def with_depth(events: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``depth``: open marks around an event. A mark and its unmark have the same; surplus unmarks are at 0."""
    w = by_document(keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(F.col("type") == "mark", 1).when(F.col("type") == "unmark", -1).otherwise(0)
    out = events.withColumn("_run", F.sum(delta).over(upto))
    clamped = F.col("_run") - F.least(F.lit(0), F.min("_run").over(upto))
    return out.withColumn("depth", (clamped - (F.col("type") == "mark").cast("int")).cast("int")).drop("_run")


def unbalanced(events: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents whose marks and unmarks don't pair up: more of one than the other, or an unmark too early."""
    delta = F.when(F.col("type") == "mark", 1).when(F.col("type") == "unmark", -1).otherwise(0)
    run = F.sum(delta).over(by_document(keys).rowsBetween(Window.unboundedPreceding, 0))
    return events.select(*keys, run.alias("run"), delta.alias("delta")).groupBy(*keys).agg(F.sum("delta").alias("left_open"), F.min("run").alias("lowest")).filter("left_open <> 0 OR lowest < 0")
