"""LM scoring from a log-frequency Bloom filter.

All n-gram counts of the training texts are quantised on a log scale, and an n-gram of level q is put into the filter
as (n-gram, 1) ... (n-gram, q). A count is read back by asking for level 1, 2, ... until the filter says no. The
filter is built in segments: an n-gram's segment is the top of its hash, and one task after one shuffle sets the
bits of a segment. No n-gram is left out, so the filter grows with the corpus. As long as it is no larger than
BROADCAST_BYTES, workers get it whole; beyond that the distinct n-grams of each chunk of text are dealt to the
segments, asked there and sent back. Both ways give the same levels.

Each token's three levels (of the token before, of the pair, of the token) are written once. The weights are fitted on
those of all training tokens, and scores are sums over them.

Scores are interpolated: P(w|v) = a c(vw) / c(v) + (1 - a) P(w) with P(w) = (c(w) + 1) / (Z + V + 1), c being counts
as read back and Z their sum over the vocabulary, so that the unigrams add up to one. The weight a depends on the
level of v; it is fitted by expectation-maximisation, each token being left out of its own counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, release, remainder, saved
from .tokens import U, _offsets, mix, words

#: Filter bits for each training token, probes for each level, levels for each doubling of a count.
BITS, PROBES, PER_DOUBLING = 8, 4, 2
#: The largest filter that is sent to the workers whole.
BROADCAST_BYTES = 128 << 20
#: There are 2 ** SEGMENT_BITS segments, more if one would have more than SEGMENT_TOKENS tokens' bits.
SEGMENT_BITS, SEGMENT_TOKENS = 11, 1 << 20
#: Bits that a segment has at least, so that one frequent token's levels can't fill it in a small corpus.
LEAST_SEGMENT = 2048
#: Tokens that make up at least one in so many of all tokens go to the workers with their exact counts: there can't
#: be more than so many. The others are joined.
HEADS = 1 << 20
#: Rounds in which texts are dealt to the filter's segments, all rows in one of them: a round's questions are deleted before
#: the next one, so that they take a part of the disk only.
ROUNDS = 4
#: n-grams that a counting task holds before it passes them on: 12 bytes each, some five times that while they are sorted.
HELD = 1 << 19
END, BEGIN = U(0xE4D0), U(0xB361)
_PAIR = U(0xC2B2AE3D27D4EB4F)
_ALL = (1 << 64) - 1


def _tokens(w) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row and its end, row after row, and where each row ends."""
    n = np.diff(w.ends, prepend=0) + 1
    ends = np.cumsum(n)
    out = np.full(int(ends[-1]) if len(ends) else 0, END, dtype=np.uint64)
    keep = np.ones(len(out), dtype=bool)
    keep[ends - 1] = False
    out[keep] = w.hash
    return out, ends


def _before(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    prev = np.empty_like(tokens)
    prev[1:] = tokens[:-1]
    prev[np.concatenate(([0], ends[:-1]))] = BEGIN
    return prev


def pairs(prev: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(prev * _PAIR + tokens)


def level(count: np.ndarray) -> np.ndarray:
    """1 for a count of 1, then PER_DOUBLING more each time it doubles."""
    return 1 + np.floor(PER_DOUBLING * np.log2(np.maximum(count, 1)) + 1e-9).astype(np.int64)


def _middles() -> np.ndarray:
    """What a level stands for: the mean of the whole counts that have it; 0 for level 0."""
    q = np.arange(0, 64 * PER_DOUBLING)
    low, high = np.ceil(2 ** ((q - 1) / PER_DOUBLING) - 1e-9), np.ceil(2 ** (q / PER_DOUBLING) - 1e-9) - 1
    out = (low + np.maximum(high, low)) / 2
    out[0] = 0
    return out


MIDDLE = _middles()


def probe(bits: np.ndarray, size: int, grams: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
    """The level of each n-gram: repeated membership probes until one fails. ``base``: where their segments begin."""
    out = np.zeros(len(grams), dtype=np.uint8)
    at = np.arange(len(grams))
    q = 0
    while len(at) and q < len(MIDDLE) - 1:
        q += 1
        for j in range(PROBES):
            pos = place(grams[at], q, j, size)
            if base is not None:
                pos += base[at]
            at = at[(bits[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 == 1]
        out[at] = q
    return out


@dataclass
class Filter:
    """Bits in 2 ** ``top`` segments of ``size`` bits."""

    top: int
    size: int
    bits: np.ndarray = field(repr=False)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        return probe(self.bits, self.size, grams, segment(grams, self.top) * self.size)


def segment(grams: np.ndarray, top: int) -> np.ndarray:
    return (grams >> U(64 - top)).astype(np.int64)


def place(grams: np.ndarray, q: int | np.ndarray, j: int, size: int) -> np.ndarray:
    """Where in its segment probe ``j`` of (n-gram, level) is."""
    extra = (j + 1) * 0xD1B54A32D192ED03
    if isinstance(q, np.ndarray):
        salt = q.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(extra & _ALL)
    else:
        salt = U((q * 0x9E3779B97F4A7C15 + extra) & _ALL)
    return (((mix(grams ^ salt) >> U(32)) * U(size)) >> U(32)).astype(np.int64)


class Asked:
    """The distinct n-grams of some rows' tokens (see _tokens), and how their levels go back to the tokens."""

    def __init__(self, tokens: np.ndarray, ends: np.ndarray):
        self.uniq, self.inv = np.unique(tokens, return_inverse=True)
        self.two, self.back = np.unique(pairs(_before(tokens, ends), tokens), return_inverse=True)
        self.begins = np.concatenate(([0], ends[:-1])).astype(np.int64)

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All distinct n-grams in order, and where among them those of ``uniq`` and ``two`` are."""
        one = mix(self.uniq)
        all_, at = np.unique(np.concatenate((one, self.two)), return_inverse=True)
        return all_, at[: len(one)], at[len(one) :]

    def codes(self, single: np.ndarray, both: np.ndarray) -> np.ndarray:
        """Levels of the token before, of the pair and of the token, for each token; there are as many beginnings as ends."""
        out = np.empty((len(self.inv), 3), dtype=np.uint8)
        out[:, 1], out[:, 2] = both[self.back], single[self.inv]
        out[1:, 0] = out[:-1, 2]
        out[self.begins, 0] = single[np.searchsorted(self.uniq, END)]
        return out


@dataclass
class Heads:
    """Exact counts of frequent tokens."""

    tokens: np.ndarray = field(repr=False)
    counts: np.ndarray = field(repr=False)


@dataclass
class Counted:
    """``total`` tokens, ``distinct`` tokens, ``mass`` (Z), exact counts (h, c), the broadcast heads, and the filter: its
    segments as a table (seg, bits), and broadcast if it is small enough."""

    total: int
    distinct: int
    mass: float
    counts: DataFrame
    heads: Broadcast
    top: int
    size: int
    segments: DataFrame
    shared: Broadcast | None

    def single(self) -> np.ndarray:
        """P(w) by level."""
        return (np.minimum(MIDDLE, self.total) + 1) / (self.mass + self.distinct + 1)


@dataclass
class Trained:
    """What was counted, and the weights a by the level of v."""

    counted: Counted
    weight: np.ndarray = field(repr=False)


def _count_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            h, c = _summed(held)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for batch in batches:
            for _, _, w in words(batch.column(0)):
                h, c = np.unique(_tokens(w)[0], return_counts=True)
                held.append((h, c.astype(np.uint32)))
                size += len(held[-1][0])
                if size > HELD:
                    yield out()
                    size = 0
        yield out()

    return docs.select(text_col).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _summed(held: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and the sums of their counts; ``held`` is emptied."""
    if not held:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.concatenate([x[0] for x in held])
    c = np.concatenate([x[1] for x in held])
    held.clear()
    order = np.argsort(h)
    h, c = h[order], c[order]
    del order
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
    return h[first], np.add.reduceat(c, first, dtype=np.int64) if len(h) else c.astype(np.int64)


def _segments(docs: DataFrame, text_col: str, top: int, size: int) -> DataFrame:
    """(seg, bits): the filter's segments, those without an n-gram left out."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list] = {True: [], False: []}
        total = 0

        def out():
            rows: dict[str, list] = {"seg": [], "one": [], "h": [], "c": []}
            for one, some in held.items():
                h, c = _summed(some)
                seg = segment(h, top)
                cuts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1], [True]))) if len(seg) else np.empty(0, np.int64)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    part = c[a:b]
                    rows["seg"].append(seg[a])
                    rows["one"].append(one)
                    rows["h"].append(h[a:b].tobytes())
                    rows["c"].append(part.astype(np.uint8 if part.max() < 256 else np.int64).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows["seg"], pa.int64()), pa.array(rows["one"], pa.bool_()), pa.array(rows["h"], pa.binary()), pa.array(rows["c"], pa.binary())], ["seg", "one", "h", "c"])

        for batch in batches:
            for _, _, w in words(batch.column(0)):
                tokens, ends = _tokens(w)
                for one, grams in ((True, mix(tokens)), (False, pairs(_before(tokens, ends), tokens))):
                    h, c = np.unique(grams, return_counts=True)
                    held[one].append((h, c.astype(np.uint32)))
                    total += len(h)
                if total > HELD:
                    yield out()
                    total = 0
        yield out()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((size + 7) // 8, dtype=np.uint8)
        by: dict[bool, list] = {True: [], False: []}
        seg, many = None, 0
        for batch in batches:
            seg = batch.column(0)[0].as_py()
            for one, h, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                grams = np.frombuffer(h, dtype=np.uint64)
                by[one].append((grams, np.frombuffer(c, dtype=np.uint8 if len(c) == len(grams) else np.int64)))
                many += len(grams)
                if many > HELD:
                    by = {k: [_summed(x)] for k, x in by.items()}
                    many = 0
        for held in by.values():
            h, c = _summed(held)
            q = level(c)
            while len(h):
                for j in range(PROBES):
                    pos = place(h, q, j, size)
                    np.bitwise_or.at(bits, pos >> 3, np.left_shift(1, pos & 7).astype(np.uint8))
                h, q = h[q > 1], q[q > 1] - 1
        yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), pa.array([bits.tobytes()], pa.binary())], ["seg", "bits"])

    return docs.select(text_col).mapInArrow(gather, "seg long, one boolean, h binary, c binary").groupBy("seg").applyInArrow(build, "seg long, bits binary")


def count(docs: DataFrame, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> Counted:
    """Counts of all texts of ``docs``. Null texts are empty texts, an empty table has no tokens.

    What reaches the driver: HEADS tokens at most, and the filter if it has ``broadcast_bytes`` at most.
    """
    table = saved(_count_tokens(batched(docs), text_col), tidy=True)

    def middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([int(c.sum())]), pa.array([len(c)]), pa.array([float(MIDDLE[level(c)].sum())])], ["n", "v", "z"])

    sums = table.select("c").mapInArrow(middles, "n long, v long, z double").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("z").alias("z")).first()
    total, distinct, mass = sums["n"] or 0, sums["v"] or 0, sums["z"] or 0.0
    head = table.filter(F.col("c") * HEADS >= total).toArrow()
    h, c = head["h"].to_numpy().view(np.uint64), head["c"].to_numpy()
    order = np.argsort(h)
    top = max(SEGMENT_BITS, ceil(log2(max(total, 1) / SEGMENT_TOKENS)))
    size = max(LEAST_SEGMENT // 8, ceil(BITS * total / (8 << top))) * 8
    sc = docs.sparkSession.sparkContext
    segments = saved(_segments(docs, text_col, top, size), tidy=True)
    shared = None
    if size << top <= broadcast_bytes * 8:
        bits = np.zeros((1 << top, size // 8), dtype=np.uint8)
        for row in segments.toLocalIterator():
            bits[row["seg"]] = np.frombuffer(row["bits"], dtype=np.uint8)
        shared = sc.broadcast(Filter(top, size, bits.reshape(-1)))
    return Counted(total, distinct, mass, table, sc.broadcast(Heads(h[order], c[order])), top, size, segments, shared)


class Looked:
    """The table of looked-up rows: each row's number of tokens and levels, exact counts of its frequent tokens, its other
    tokens; and the input's columns but for the text, under names of their own (``kept``: own name by input name)."""

    def __init__(self, rows: DataFrame, kept: dict[str, str]):
        self.rows, self.kept = rows, kept

    def filter(self, condition) -> Looked:
        """Rows for which a condition on the table's own names holds."""
        return Looked(self.rows.filter(condition), self.kept)


_ROW = "_key string, _n long, _known long, _log double, _tail array<long>, _times array<int>"


def look(docs: DataFrame, model: Counted, text_col: str = "text") -> Looked:
    """Every row of ``docs`` with its tokens' levels, written once: rows get a key that must not be made a second time."""
    rest = [c for c in docs.columns if c != text_col]
    kept = {c: f"_c{i}" for i, c in enumerate(rest)}
    source = batched(docs).select(*[F.col(f"`{c}`").alias(n) for c, n in kept.items()], F.col(text_col).alias("_text"))
    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in source.drop("_text").schema), _ROW])
    k = len(rest)
    heads, shared = model.heads, model.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = heads.value
        whole = shared.value if shared is not None else None
        unit = uuid.uuid4().hex
        done = 0
        logs = np.log10(head.counts + 1.0)
        for batch in batches:
            for a, b, w in words(batch.column(k)):
                tokens, ends = _tokens(w)
                n = b - a
                x = Asked(tokens, ends)
                found = np.searchsorted(head.tokens, x.uniq)
                found[found == len(head.tokens)] = 0
                known = head.tokens[found] == x.uniq if len(head.tokens) else np.zeros(len(x.uniq), bool)
                log = np.where(known, logs[found], 0.0)[x.inv] if len(head.tokens) else np.zeros(len(tokens))
                sums = lambda v: np.add.reduceat(v, x.begins)  # noqa: E731, B023
                # tokens that are no heads: distinct by row, with how often they are there
                row = np.repeat(np.arange(n), ends - x.begins)
                rare = np.flatnonzero(~known[x.inv])
                order = rare[np.lexsort((x.inv[rare], row[rare]))]
                r, t = row[order], x.inv[order]
                first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (t[1:] != t[:-1]))) if len(r) else np.empty(0, np.int64)
                times = np.diff(np.append(first, len(r)))
                cuts = np.searchsorted(r[first], np.arange(n + 1)).astype(np.int32)
                lists = lambda v: pa.ListArray.from_arrays(pa.array(cuts), v)  # noqa: E731, B023
                part = batch.slice(a, n)
                columns = [
                    *[part.column(i) for i in range(k)],
                    pa.array([f"{unit}-{done + i}" for i in range(n)]),
                    pa.array((ends - x.begins).astype(np.int64)), pa.array(sums(known[x.inv].astype(np.int64))), pa.array(sums(log)),
                    lists(pa.array(x.uniq[t[first]].view(np.int64))), lists(pa.array(times.astype(np.int32))),
                ]
                if whole is not None:
                    body, each = x.codes(whole.levels(mix(x.uniq)), whole.levels(x.two)), 3
                else:
                    body, each = tokens, 8
                yield pa.RecordBatch.from_arrays([*columns, _cells(body, ends, each), pa.array([f"{unit}-{done}"] * n)], names=[*kept.values(), "_key", "_n", "_known", "_log", "_tail", "_times", "_body", "_unit"])
                done += n

    looked = lambda part: saved(part.mapInArrow(run, f"{fields}, _body binary, _unit string"))
    if shared is not None:
        return Looked(looked(source), kept)
    turn = F.pmod(F.xxhash64("_text"), F.lit(ROUNDS))
    parts = [_dealt(looked(source.filter(turn == i)), model, fields) for i in range(ROUNDS)]
    return Looked(reduce(DataFrame.unionByName, parts), kept)


def _cells(values: np.ndarray, ends: np.ndarray, each: int) -> pa.Array:
    """A binary value for each row: its tokens' ``each`` bytes."""
    cuts = np.concatenate(([0], ends)) * each
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _dealt(rows: DataFrame, model: Counted, fields: str) -> DataFrame:
    """The table ``rows`` with levels in place of tokens, written; ``rows`` is deleted. Each unit's distinct n-grams are
    asked where their segment is, and their levels come back in the order of the n-grams.

    The questions to a segment stream past its bits, so one that is asked very often takes no more room.
    """
    top, size = model.top, model.size

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, first, tokens, ends in _parts(batch.column(0), batch.column(1), batch.column(2)):
                grams = Asked(tokens, ends).grams()[0]
                seg = segment(grams, top)
                begin = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
                cut = pa.py_buffer((np.append(begin, len(grams)) * 8).astype(np.int32))
                data = pa.Array.from_buffers(pa.binary(), len(begin), [None, cut, pa.py_buffer(grams)])
                same = lambda v: pa.array(np.full(len(begin), v, np.int32))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(seg[begin]), same(1), pa.array([unit] * len(begin)), same(first), same(len(ends)), data], ["seg", "kind", "unit", "first", "rows", "data"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return answers(batches, size)

    asked = rows.select("_unit", "_key", "_body").mapInArrow(ask, "seg long, kind int, unit string, first int, rows int, data binary")
    held = model.segments.select("seg", F.lit(0).alias("kind"), F.lit("").alias("unit"), F.lit(0).alias("first"), F.lit(0).alias("rows"), F.col("bits").alias("data"))
    replies = saved(held.unionByName(asked).repartition("seg").sortWithinPartitions("seg", "kind").mapInArrow(answer, "unit string, first int, rows int, seg long, levels binary"), tidy=True)
    names = [f.name for f in rows.drop("_unit").schema]
    at = names.index("_body")

    def put(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.select([*names, "_unit"])
        place = np.array([int(k.rsplit("-", 1)[1]) for k in left["_key"].to_pylist()])
        left = left.take(pa.array(np.argsort(place)))
        right = right.sort_by([("first", "ascending"), ("seg", "ascending")])  # as they were asked: by n-gram
        first, many = right["first"].to_numpy(), right["rows"].to_numpy()
        body = left["_body"].combine_chunks()
        begin = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        codes, cuts = [], []
        for a, b in zip(begin, [*begin[1:], len(first)], strict=True):
            tokens, ends = _joined(body.slice(int(first[a]), int(many[a])))
            x = Asked(tokens, ends)
            _, single, two = x.grams()
            levels = np.frombuffer(b"".join(right["levels"].slice(int(a), int(b - a)).to_pylist()), dtype=np.uint8)
            codes.append(x.codes(levels[single], levels[two]))
            cuts.append(np.diff(ends, prepend=0))
        return left.set_column(at, "_body", _cells(np.concatenate(codes), np.cumsum(np.concatenate(cuts)), 3))

    out = saved(rows.groupBy("_unit").cogroup(replies.groupBy("unit")).applyInArrow(put, f"{fields}, _body binary, _unit string"), tidy=True)
    release(rows, replies)
    return out


def answers(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(unit, first, rows, seg, levels) for questions in order of segments, each segment's bits (kind 0) before them.

    All that a batch asks a segment is asked at once: a unit has few n-grams in each of many segments.
    """
    own, bits = None, None
    for batch in batches:
        seg, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy() == 1
        cuts = _offsets(batch.column(5)).astype(np.int64)
        data = np.frombuffer(batch.column(5).buffers()[2] or b"", dtype=np.uint8)
        levels = np.zeros(int(np.diff(cuts)[asks].sum()) // 8, dtype=np.uint8)
        done = 0
        begin = np.flatnonzero(np.append(True, seg[1:] != seg[:-1])) if len(seg) else []
        for a, b in zip(begin, [*begin[1:], len(seg)], strict=True):
            if seg[a] != own:
                own, bits = seg[a], None
            if not asks[a]:  # a segment's bits come first
                bits = data[cuts[a] : cuts[a + 1]].copy()
                a += 1
            asked = data[cuts[a] : cuts[b]].copy().view(np.uint64)
            if bits is not None and len(asked):
                levels[done : done + len(asked)] = probe(bits, size, asked)
            done += len(asked)
        each = np.append(0, np.cumsum(np.diff(cuts)[asks] // 8)).astype(np.int32)
        replies = pa.Array.from_buffers(pa.binary(), len(each) - 1, [None, pa.py_buffer(each), pa.py_buffer(levels)])
        mask = pa.array(asks)
        yield pa.RecordBatch.from_arrays([*[batch.column(i).filter(mask) for i in (2, 3, 4, 0)], replies], ["unit", "first", "rows", "seg", "levels"])


def _joined(body: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of rows, and where each row ends."""
    cuts = _offsets(body).astype(np.int64)
    data = np.frombuffer(body.buffers()[2], dtype=np.uint8)[cuts[0] : cuts[-1]]
    return data.copy().view(np.uint64), (cuts[1:] - cuts[0]) // 8


def _parts(unit: pa.Array, key: pa.Array, body: pa.Array) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
    """Rows that follow each other in one unit: its name, which of its rows is the first, tokens and ends. A unit that is
    cut by batches asks in parts."""
    names = unit.to_pylist()
    first = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1])] if names else []
    for a, b in zip(first, [*first[1:], len(names)], strict=True):
        row = int(key[a].as_py().rsplit("-", 1)[1]) - int(names[a].rsplit("-", 1)[1])
        yield names[a], row, *_joined(body.slice(a, b - a))


def _triples(body: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' level triples as numbers, and where each row begins. Every row has a token."""
    cuts = _offsets(body).astype(np.int64)
    x = np.frombuffer(body.buffers()[2], dtype=np.uint8)[cuts[0] : cuts[-1]].reshape(-1, 3).astype(np.int32)
    return x[:, 0] << 14 | x[:, 1] << 7 | x[:, 2], (cuts[:-1] - cuts[0]) // 3


def fit_weights(looked: Looked, model: Counted) -> np.ndarray:
    """The weights a by level, by expectation-maximisation over the triples of all rows. Levels without a token have 0."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 21, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_triples(batch.column(0))[0], minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])

    got = looked.rows.select("_body").mapInArrow(seen, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()  # 2 ** 21 rows at most
    return weights_of(got["k"].to_numpy(), got["n"].to_numpy(), model.single())


def weights_of(k: np.ndarray, n: np.ndarray, single: np.ndarray, steps: int = 50) -> np.ndarray:
    before, both = k >> 14, MIDDLE[(k >> 7) & 127]
    others = np.maximum(both - 1, 0)  # the token itself is left out
    ratio = others / np.maximum(np.maximum(MIDDLE[before], both) - 1, 1) / single[k & 127]
    size = np.bincount(before, weights=n, minlength=len(MIDDLE))
    share = np.full(len(MIDDLE), 0.5)
    for _ in range(steps):
        part = share[before] * ratio / (share[before] * ratio + 1 - share[before])
        share = np.minimum(np.bincount(before, weights=n * part, minlength=len(MIDDLE)) / np.maximum(size, 1), 0.99)
    return share


def log_table(model_single: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """log10 P(w|v) for every triple of levels."""
    k = np.arange(1 << 21)
    before, both = k >> 14, MIDDLE[(k >> 7) & 127]
    share = weight[before]
    return np.log10(share * both / np.maximum(np.maximum(MIDDLE[before], both), 1) + (1 - share) * model_single[k & 127])


def train(docs: DataFrame, text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> Trained:
    """The model of all texts of ``docs``: counts, filter and weights, each of all rows."""
    model = count(docs, text_col, broadcast_bytes)
    return Trained(model, fit_weights(look(docs.select(text_col), model, text_col), model))


def score(docs: DataFrame, model: Trained, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    Null texts are empty texts: one token, the end. ``base_score`` uses exact counts. Repeated rows are scored
    alike; columns of those names are replaced, others kept, but for the text.
    """
    docs = docs.drop("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return score_looked(look(docs, model.counted, text_col), model)


def score_looked(looked: Looked, trained: Trained) -> DataFrame:
    model = trained.counted
    table = looked.rows.sparkSession.sparkContext.broadcast((model.single(), trained.weight))
    keep = [*looked.kept.values(), "_key", "_n", "_known", "_log"]
    k = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = log_table(*table.value)
        for batch in batches:
            if batch.num_rows:
                triples, begins = _triples(batch.column(k))
                yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(np.add.reduceat(logs[triples], begins))], names=[*keep, "_score"])

    schema = looked.rows.select(*keep).withColumn("_score", F.lit(0.0)).schema
    scored = looked.rows.select(*keep, "_body").mapInArrow(run, schema)
    tail = looked.rows.select("_key", F.explode(F.arrays_zip("_tail", "_times")).alias("x")).select("_key", F.col("x._tail").alias("h"), F.col("x._times").alias("t"))
    rare = model.counts.filter(F.col("c") * HEADS < model.total)  # none of these is frequent: no hot key
    exact = tail.join(rare, "h").groupBy("_key").agg(F.sum("t").alias("_more"), F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("_add"))
    size = float(model.total + model.distinct + 1)
    return scored.join(exact, "_key", "left").select(
        *[F.col(n).alias(c) for c, n in looked.kept.items()], F.col("_n").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("_log") + F.coalesce("_add", F.lit(0.0)) - F.col("_n") * F.log10(F.lit(size))).alias("base_score"),
        F.col("_score").alias("score"),
    )


def classify(docs: DataFrame, modulus: int = 7, held: int = 2, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of ``docs`` scored by a model of the rows that aren't held out; a null doc_id is neither held out
    nor learned from. The texts are looked up once, for the weights and the scores."""
    rem = remainder("doc_id", modulus)
    model = count(docs.filter(rem != held), broadcast_bytes=broadcast_bytes)
    learns = F.coalesce(rem != held, F.lit(False))
    looked = look(docs.select("doc_id", F.coalesce(rem == held, F.lit(False)).alias("held_out"), learns.alias("learns"), "text"), model)
    trained = Trained(model, fit_weights(looked.filter(looked.kept["learns"]), model))
    return score_looked(looked, trained).drop("learns")
