"""Comparing event streams."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame

from .functions.codec import to_json


def assert_same_events(actual: DataFrame | None, expected: DataFrame | None, keys: tuple[str, ...] = ("doc_id",)) -> None:
    """Both null, or the same events in the same order; else AssertionError with a unified diff. For tests: it collects."""
    if actual is None or expected is None:
        if actual is not expected:
            raise AssertionError("one side is null: " + ("actual" if actual is None else "expected"))
        return
    lines = lambda df: [" ".join(map(str, (*[r[k] for k in keys], r["json"]))) for r in to_json(df, keys).orderBy(*keys, "seq").collect()]
    have, want = lines(actual), lines(expected)
    if have != want:
        raise AssertionError("\n".join(difflib.unified_diff(want, have, "expected", "actual", lineterm="")))


def differing(actual: DataFrame, expected: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Events that only one side has, at any scale: rows with ``side``."""
    from pyspark.sql import functions as F

    a, b = to_json(actual, keys), to_json(expected, keys)
    return a.exceptAll(b).withColumn("side", F.lit("actual")).unionByName(b.exceptAll(a).withColumn("side", F.lit("expected")))
