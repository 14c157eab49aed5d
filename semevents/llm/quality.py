"""Quality classifier: boosted trees over statistics of the whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import batched, remainder, widened
from .tokens import BLOCK, words

#: The most labelled rows that the classifier is fitted on; those with the smallest hash of the id are taken.
TRAIN_ROWS = 20_000
_MARKS = np.array([ord(c) for c in "!#$%&*|\"'()<>{}[]=_/\\.,;:?-"])


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text: byte shares, word and line shapes, repetition."""
    out = []
    for a, b, w in words(column):
        x = np.zeros((b - a, 14 + len(_MARKS)))
        size = np.diff(w.offsets).astype(float)
        some = np.maximum(size, 1)
        hist = np.zeros((b - a) * 256, dtype=np.int64)
        for at in range(0, len(w.raw), BLOCK):
            raw = w.raw[at : at + BLOCK]
            row = np.searchsorted(w.offsets[1:], np.arange(at, at + len(raw)), "right") if len(w.raw) > BLOCK else np.repeat(np.arange(b - a), np.diff(w.offsets))
            hist += np.bincount(row * 256 + raw, minlength=len(hist))
        hist = hist.reshape(b - a, 256)
        upper, lower, digits = hist[:, 65:91].sum(1), hist[:, 97:123].sum(1), hist[:, 48:58].sum(1)
        high, space, lines = hist[:, 128:].sum(1), hist[:, [32, 9, 13]].sum(1), hist[:, 10] + 1
        n = w.ends - w.begins
        many = np.maximum(n, 1)
        owner = w.row_of_word()
        distinct = np.zeros(b - a)
        pairs = np.zeros(b - a)
        if len(w.hash):
            for into, value in ((distinct, w.hash), (pairs, np.append(w.hash[1:], 0) * np.uint64(31) + w.hash)):
                order = np.lexsort((value, owner))
                v, o = value[order], owner[order]
                new = np.append(True, (v[1:] != v[:-1]) | (o[1:] != o[:-1]))
                into += np.bincount(o[new], minlength=b - a)
        x[:, 0], x[:, 1], x[:, 2] = np.log1p(size), np.log1p(n), (size - space) / many
        x[:, 3], x[:, 4], x[:, 5], x[:, 6] = upper / some, lower / some, digits / some, high / some
        x[:, 7], x[:, 8] = space / some, lines / many
        x[:, 9], x[:, 10] = distinct / many, pairs / many
        x[:, 11] = upper / np.maximum(upper + lower, 1)
        x[:, 12] = (hist[:, 33:48].sum(1) + hist[:, 58:65].sum(1) + hist[:, 91:97].sum(1) + hist[:, 123:127].sum(1)) / some
        x[:, 13] = hist[:, :9].sum(1) / some
        x[:, 14:] = hist[:, _MARKS] / many[:, None]
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, 14 + len(_MARKS)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn=None, rows: int = TRAIN_ROWS) -> boosting.Boosted:
    """Fit on at most ``rows`` labelled documents for whose id ``learn`` (a Column) holds.

    Rows with a null id, label or text teach nothing; of rows that repeat an id one does (that with the smallest
    statistics). Statistics are made on the workers; the driver gets a row of numbers for each id of the sample.
    """
    labels = labels.select(F.col(id_col), F.col(label_col).cast("double").alias("_y")).filter(F.col(id_col).isNotNull() & F.col("_y").isNotNull())
    if learn is not None:
        labels = labels.filter(learn)
    picked = labels.groupBy(id_col).agg(F.max("_y").alias("_y")).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    sample = batched(docs).select(id_col, text_col).filter(F.col(text_col).isNotNull()).join(F.broadcast(picked), id_col)  # at most `rows` rows

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), type=pa.list_(pa.float64()))], ["id", "y", "x"])

    each = sample.select(text_col, F.col(id_col).cast("string"), "_y").mapInArrow(stats, "id string, y double, x array<double>")
    got = each.groupBy("id").agg(F.first("y").alias("y"), F.min("x").alias("x")).select("y", "x").toArrow()  # a row an id: at most `rows`
    y = got["y"].to_numpy()
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(len(y), 14 + len(_MARKS))
    order = np.lexsort([*x.T, y])  # the same forest whatever order the rows came in
    return boosting.fit(x[order], y[order])


def score_quality(docs: DataFrame, model: boosting.Boosted, text_col: str = "text", score_col: str = "score", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``score_col``: the probability of label 1 for each whole text.

    Null and empty texts are scored by their (empty) statistics, repeated rows alike; all columns are kept (but for
    the text, if so asked), one that has the name of the score is replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # trees x nodes, whatever the input
    docs = batched(docs).drop(score_col)
    k = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != k]
    schema = widened(docs.select(*[docs.columns[i] for i in kept]), **{score_col: "double"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(statistics(batch.column(k)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(s, type=pa.float64())], names=[*[batch.schema.names[i] for i in kept], score_col])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; a null doc_id is not held out and not learned."""
    held_out = F.coalesce(remainder("doc_id", modulus) == held, F.lit(False))
    model = train(docs, labels, learn=~held_out)
    scored = score_quality(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep_text=False)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
