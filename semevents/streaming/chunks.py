"""Chunks of documents as a stream: the kernel's state lives in Spark's state store between micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.kernel import MarkdownKernel
from ..model import FIELDS

STATE = "state string"


def parse_stream(chunks: DataFrame, key: str = "doc_id", timeout_ms: int | None = None, keep_ms: int | None = None, most_early: int = 100_000) -> DataFrame:
    """Events as soon as they are certain. ``chunks``: key, chunk_seq (from 0), chunk, eof (true on the last chunk).

    Chunks of a document may come in any order within and across micro-batches: those that are early wait in the
    state (more than ``most_early`` of a document are an error that names the missing one), those that were there already are
    dropped. ``eof`` ends a document; with ``timeout_ms`` so does silence. That it has ended is remembered, for ``keep_ms`` if
    given: chunks that come later are dropped. Empty chunks say nothing.
    """
    kind = chunks.schema[key].dataType.simpleString()
    columns = [key, "seq", "type", "name", "is_tag", "attributes", "text"]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved = json.loads(state.get[0]) if state.exists else {"next": 0, "early": {}, "kernel": None, "ended": False}
        if saved["ended"]:
            if state.hasTimedOut:
                state.remove()
            return
        kernel = MarkdownKernel.restore(saved["kernel"]) if saved["kernel"] else MarkdownKernel()
        out, first, ended = [], kernel.seq, state.hasTimedOut
        early = saved["early"]
        if not ended:
            for frame in frames:
                for n, chunk, eof in zip(frame["chunk_seq"], frame["chunk"], frame["eof"], strict=True):
                    if int(n) >= saved["next"]:
                        early.setdefault(str(int(n)), [chunk if isinstance(chunk, str) else "", bool(eof)])
            while not ended and str(saved["next"]) in early:
                chunk, ended = early.pop(str(saved["next"]))
                saved["next"] += 1
                out += kernel.feed(chunk)
            if len(early) > most_early and not ended:
                raise ValueError(f"{len(early)} chunks of document {k[0]} wait for chunk {saved['next']}")
        if ended:
            out += kernel.finish()
            state.update((json.dumps({"ended": True}),))
        else:
            saved["kernel"] = kernel.state()
            state.update((json.dumps(saved),))
        if keep_ms if ended else timeout_ms:
            state.setTimeoutDuration(keep_ms if ended else timeout_ms)
        yield pd.DataFrame([(k[0], first + i, t, n, g, a, x) for i, (t, n, g, a, x) in enumerate(out)], columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms or keep_ms else GroupStateTimeout.NoTimeout
    return chunks.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {FIELDS}", STATE, "append", timeout)
