"""N-gram Jaccard join by chosen paths.

Texts are sets of word five-grams. Equal sets are collapsed first. A set is embedded as WIDTH minhash tokens
(i, minimum under hash i), of which two sets share about their Jaccard similarity. The chosen-path recursion deals
sets into buckets: at a node every set goes to the children of those of its tokens that a hash of the node and the
token samples, 1/threshold children on average, so that similar sets go on together and others part. A small
bucket is searched by brute force over the embedded sets; of a large one the sets near to a pivot are linked to it, and unless
few others are left, which are searched against the whole bucket, it is split again; what is still large at the
last depth is searched by brute force in blocks. Independent runs from the root repeat this until the target recall,
which holds for pairs that meet in large buckets only, too.

Buckets give candidate groups only. Within each group the true sets are compared, all with all, in blocks of
bounded size, so that links and their numbers are exact for every pair of one group.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import count
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, saved
from .components import components
from .tokens import U, mix, shingles, words

WORDS, THRESHOLD = 5, 0.8
WIDTH = 64
#: The part of pairs at the threshold that some run must bring together.
RECALL = 0.9999
#: Buckets up to this size are searched by brute force by one task.
SMALL = 1000
DEPTH = 4
#: Sets of a large bucket that may become its pivot.
PIVOTS = 4
#: How much oftener than at the root a large bucket's split samples a token, to make up for pairs that splits part.
SPLIT = 1.25
#: Documents of a group that are compared at a time.
BLOCK = 1000
#: Bits for each text that the filter before the comparison of texts has, and its largest size.
FILTER_BITS, FILTER_BYTES = 12, 32 << 20
#: Embedded sets that share less of their tokens than the threshold by this many standard deviations aren't candidates.
SLACK = 4.5
_RNG = np.random.Generator(np.random.PCG64(77))
_A = _RNG.integers(1, 2**63, WIDTH, dtype=np.uint64) * U(2) + U(1)
_B = _RNG.integers(0, 2**63, WIDTH, dtype=np.uint64)


def embed(s: np.ndarray) -> np.ndarray:
    """WIDTH minhash values of a set of hashes."""
    out = np.full(WIDTH, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(s), 8192):
        h = (s[a : a + 8192, None] * _A + _B) >> U(32)
        np.minimum(out, h.min(axis=0).astype(np.uint32), out=out)
    return out


def runs(threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has met with the target probability, even if all its buckets are so
    large that they are split down to the last depth. How many tokens a pair shares is binomial."""
    some = []
    for k in range(WIDTH + 1):
        meets = 1.0
        for above in reversed(range(depth)):  # at a node: one of the k tokens is sampled and the pair meets below it
            meets = 1 - (1 - min(1, meets * (SPLIT if above else 1) / (threshold * WIDTH))) ** k
        some.append((comb(WIDTH, k) * threshold**k * (1 - threshold) ** (WIDTH - k), 1 - meets))
    return next(n for n in count(1) if sum(p * miss**n for p, miss in some) <= 1 - recall)


def _children(nodes: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child nodes: of each node's set the tokens that its hash samples. tokens: rows x WIDTH, uint32."""
    named = mix(tokens.astype(np.uint64) + (np.arange(WIDTH, dtype=np.uint64) << U(32)))
    child = mix(nodes[:, None] * U(0x9E3779B97F4A7C15) ^ named)
    row, col = np.nonzero((child >> U(11)).astype(np.float64) * 2.0**-53 < 1 / (threshold * WIDTH))
    return row, mix(child[row, col])


def _roots(run: int) -> np.ndarray:
    return mix(np.arange(1, run + 1, dtype=np.uint64) * U(0xA0761D6478BD642F))


def _described(docs: DataFrame, id_col: str, text_col: str, run: int, threshold: float) -> DataFrame:
    """(doc_id, th, h1, h2, sketch, paths): two hashes name the set (null: no words), th the text."""
    roots = _roots(run)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, more, sketches, paths = [], [], [], []
            for _, _, w in words(batch.column(2)):
                for a, b in zip(w.begins, w.ends, strict=True):
                    s = shingles(w.hash[a:b], WORDS)
                    if not len(s):
                        keys.append(None)
                        more.append(None)
                        sketches.append(None)
                        paths.append(None)
                        continue
                    m = mix(s)
                    keys.append(int(mix(np.bitwise_xor.reduce(m, keepdims=True) + m.sum(keepdims=True) * U(31)).view(np.int64)[0]))
                    more.append(int(mix(mix(m + U(7)).sum(keepdims=True)).view(np.int64)[0]))
                    e = embed(s)
                    sketches.append(e.tobytes())
                    paths.append(np.unique(_children(roots, np.broadcast_to(e, (len(roots), WIDTH)), threshold)[1]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(more, pa.int64()), pa.array(sketches, pa.binary()), pa.array(paths, pa.list_(pa.int64()))],
                names=["doc_id", "th", "h1", "h2", "sketch", "paths"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(
        describe, "doc_id long, th long, h1 long, h2 long, sketch binary, paths array<long>"
    )


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _least(threshold: float) -> int:
    """Tokens that candidates share at least."""
    return int(WIDTH * threshold - SLACK * (WIDTH * threshold * (1 - threshold)) ** 0.5)


def _sketch_edges(keys: np.ndarray, e: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Joining edges between rows ``left`` and ``right`` whose embedded sets share ``least`` tokens."""
    label = np.arange(len(keys))
    out = []
    columns = np.ascontiguousarray(e.T)
    step = max(1, (1 << 20) // max(1, len(right)))
    for a in range(0, len(left), step):
        part = left[a : a + step]
        same = np.zeros((len(part), len(right)), dtype=np.uint8)
        for c in columns:
            same += c[part][:, None] == c[right]
        near = same >= least
        for r in np.flatnonzero(near.any(axis=1)):
            i, ks = part[r], right[near[r]]
            for k in ks[label[ks] != label[i]]:
                if label[k] != label[i]:
                    out.append((keys[i], keys[k]))
                    label[label == label[k]] = label[i]
    return out


def _candidates(table: pa.Table, threshold: float) -> pa.Table:
    """Brute force within a bucket, or between two blocks of one."""
    keys, first = np.unique(table["key"].to_numpy(), return_index=True)
    e = np.frombuffer(b"".join(table["sketch"].take(pa.array(first)).to_pylist()), dtype=np.uint32).reshape(-1, WIDTH)
    part = table["part"].to_numpy()[first]
    low, high = (int(table[c][0].as_py()) for c in ("lo", "hi"))
    left, right = (np.flatnonzero(part == p) for p in (low, high))
    edges = _sketch_edges(keys, e, left, right, _least(threshold))
    return pa.table({"a": pa.array([x[0] for x in edges], pa.int64()), "b": pa.array([x[1] for x in edges], pa.int64())})


def _blocks(df: DataFrame, size: str, block: int) -> DataFrame:
    """Rows dealt to (lo, hi) pairs of parts of a group of ``size`` rows, parts of about ``block`` rows."""
    parts = F.ceil(F.col(size) / block).cast("int")
    return (
        df.withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("key", F.lit(5)), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("lo", F.least("part", "other"))
        .withColumn("hi", F.greatest("part", "other"))
    )


def _others(table: pa.Table, threshold: float) -> pa.Table:
    """Brute force between the rows that aren't near to their bucket's pivot and a part of the bucket."""
    keys, first = np.unique(table["key"].to_numpy(), return_index=True)
    e = np.frombuffer(b"".join(table["sketch"].take(pa.array(first)).to_pylist()), dtype=np.uint32).reshape(-1, WIDTH)
    left = np.flatnonzero(~table["near"].to_numpy()[first])
    edges = _sketch_edges(keys, e, left, np.arange(len(keys)), _least(threshold))
    return pa.table({"a": pa.array([x[0] for x in edges], pa.int64()), "b": pa.array([x[1] for x in edges], pa.int64())})


def _around_pivots(large: DataFrame, threshold: float, small: int) -> tuple[DataFrame, DataFrame]:
    """Candidate edges of large buckets (some repeated), and the rows (node, key, size, sketch) of those that must be split.

    Mostly a bucket is large because very many near copies meet in it, which no split parts. Of PIVOTS sets that with the most
    sets near to it becomes the bucket's pivot, and those are linked to it, so they are one candidate group. Where no
    more than ``small`` sets are left over, they are compared with the whole bucket in parts, and the bucket is done: no pair
    of it is lost, and its rows are copied only as often as there are left-over sets in proportion.
    """
    picks = [F.min_by(F.struct("key", "sketch"), F.xxhash64("key", F.lit(j))).alias(f"p{j}") for j in range(PIVOTS)]
    pivots = saved(large.groupBy("node").agg(*picks))
    least = _least(threshold)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = lambda c: np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint32).reshape(-1, WIDTH)
        for batch in batches:
            own = sketch(batch.column(3))
            hits = [pa.array((own == sketch(batch.column(4 + j))).sum(axis=1) >= least) for j in range(PIVOTS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *hits], names=["node", "key", "size", "sketch", *[f"m{j}" for j in range(PIVOTS)]])

    met = large.join(pivots, "node").select("node", "key", "size", "sketch", *[F.col(f"p{j}.sketch").alias(f"s{j}") for j in range(PIVOTS)])
    fields = "node long, key long, size long, sketch binary, " + ", ".join(f"m{j} boolean" for j in range(PIVOTS))
    met = saved(met.mapInArrow(near, fields))
    sums = met.groupBy("node").agg(*[F.sum(F.col(f"m{j}").cast("long")).alias(f"n{j}") for j in range(PIVOTS)])
    most = F.greatest(*[f"n{j}" for j in range(PIVOTS)])
    best = F.coalesce(*[F.when(F.col(f"n{j}") == most, F.lit(j)) for j in range(PIVOTS)])
    chosen = saved(sums.join(pivots, "node").select("node", best.alias("best"), most.alias("many"), F.coalesce(*[F.when(best == j, F.col(f"p{j}.key")) for j in range(PIVOTS)]).alias("pivot")))
    at = met.join(chosen, "node").select(
        "node", "key", "size", "sketch", "pivot", (F.col("size") - F.col("many")).alias("rest"), F.coalesce(*[F.when(F.col("best") == j, F.col(f"m{j}")) for j in range(PIVOTS)]).alias("near")
    )
    at = saved(at)
    edges = at.filter("near AND key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b"))
    parts = F.ceil(F.col("size") / small).cast("int")
    own = F.array(F.pmod(F.xxhash64("key", F.lit(5)), parts).cast("int"))
    dealt = at.filter(F.col("rest").between(1, small)).select("node", "key", "sketch", "near", F.explode(F.when(F.col("near"), own).otherwise(F.sequence(F.lit(0), parts - 1))).alias("part"))
    others = dealt.groupBy("node", "part").applyInArrow(lambda t: _others(t, threshold), "a long, b long")
    return edges.unionByName(others), at.filter(F.col("rest") > small).select("node", "key", "size", "sketch")


def _groups(sets: DataFrame, threshold: float, small: int, depth: int) -> DataFrame:
    """Candidate edges between sets (key, sketch, paths) from the chosen-path recursion; some repeat."""
    spark = sets.sparkSession
    rows = sets.select(F.explode("paths").alias("node"), "key")
    sketches = sets.select("key", "sketch")
    edges = None
    for level in range(depth):
        # written by itself: its size is known, so that Spark broadcasts it while it is small, and beyond that the join has a
        # plain exchange on each side, where a heavy node's rows can be split
        sizes = saved(rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"))
        full = saved(rows.join(sizes, "node").join(sketches.hint("merge"), "key").select("node", "key", "size", "sketch"))
        last = level == depth - 1
        left = None
        now = full.filter(F.col("size") <= small)
        large = full.filter(F.col("size") > small)
        if not large.isEmpty():
            near, left = _around_pivots(large, threshold, small)
            edges = near if edges is None else edges.unionByName(near)
            if last:
                now = now.unionByName(left.select(*now.columns))
        dealt = _blocks(now, "size", small).select("node", "lo", "hi", "part", "key", "sketch")
        found = dealt.groupBy("node", "lo", "hi").applyInArrow(lambda t: _candidates(t, threshold), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
        if last or left is None or left.isEmpty():
            break

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 4096):
                    part = batch.slice(a, 4096)
                    e = np.frombuffer(b"".join(part.column(2).to_pylist()), dtype=np.uint32).reshape(-1, WIDTH)
                    row, node = _children(part.column(0).to_numpy().view(np.uint64), e, threshold / SPLIT)
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), part.column(1).take(pa.array(row))], ["node", "key"])

        rows = left.select("node", "key", "sketch").mapInArrow(split, "node long, key long")
    return edges if edges is not None else spark.createDataFrame([], "a long, b long")


def _verified(table: pa.Table, threshold: float) -> pa.Table:
    """Exact links between two parts of a group: for each set its links, and edges that join what is linked."""
    keys, first = np.unique(table["key"].to_numpy(), return_index=True)
    take = pa.array(first)
    part, copies = table["part"].to_numpy()[first], table["copies"].to_numpy()[first]
    low, high = (int(table[c][0].as_py()) for c in ("lo", "hi"))
    texts = table["text"].take(take).combine_chunks()
    sets = [shingles(w.hash[a:b], WORDS) for _, _, w in words(texts) for a, b in zip(w.begins, w.ends, strict=True)]
    size = np.array([len(s) for s in sets])
    left, right = (np.flatnonzero(part == p) for p in (low, high))
    owner = np.repeat(right, size[right])
    pool = np.concatenate([sets[i] for i in right]) if len(right) else np.empty(0, np.uint64)
    order = np.argsort(pool, kind="stable")
    pool, owner = pool[order], owner[order]
    links = np.zeros(len(keys), dtype=np.int64)
    u = _Union(len(keys))
    a_side, b_side = [], []
    for i in left:
        lo, hi = np.searchsorted(pool, sets[i], "left"), np.searchsorted(pool, sets[i], "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(owner[at], minlength=len(keys))
        near = np.flatnonzero(common >= threshold * (size[i] + size - common) - 1e-9)
        near = near[(near != i) & (common[near] > 0)]
        links[i] += copies[near].sum()
        if low != high:
            links[near] += copies[i]
        for k in near:
            if u.join(i, k):
                a_side.append(keys[i])
                b_side.append(keys[k])
    own = np.flatnonzero(links)
    return pa.table({
        "a": pa.array([*a_side, *keys[own]], pa.int64()), "b": pa.array([*b_side, *keys[own]], pa.int64()),
        "links": pa.array([*[0] * len(a_side), *links[own]], pa.int64()),
    })


def _likely(bodies: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``bodies`` whose ``_th`` may be among the members' texts, so that few texts are shuffled.

    A Bloom filter of FILTER_BITS bits for each member, sent to the workers, but of no more than FILTER_BYTES: the more
    members there are beyond that, the more other texts pass too. The join that follows is exact however many do.
    """
    n = members.count()
    size = min(max(8, ceil(n * FILTER_BITS / (8 << 8))), FILTER_BYTES >> 8) * 8

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, dtype=bool)
        seg = None
        for batch in batches:
            seg = batch.column(1)[0].as_py()
            h = mix(batch.column(0).to_numpy().view(np.uint64))
            for j in range(3):
                out[_spot(h, j, size)] = True
        yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([np.packbits(out).tobytes()], pa.binary())], ["seg", "bits"])

    th = members.select(F.col("where.th").alias("th"))
    by_segment = th.withColumn("seg", F.pmod("th", F.lit(256)).cast("int")).groupBy("seg").applyInArrow(bits, "seg int, bits binary")
    whole = np.zeros((256, size // 8), dtype=np.uint8)
    for row in by_segment.toLocalIterator():  # FILTER_BYTES at most
        whole[row["seg"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    shared = bodies.sparkSession.sparkContext.broadcast(whole.reshape(-1))

    @F.pandas_udf("boolean")
    def may_be(th: pd.Series) -> pd.Series:
        raw = th.to_numpy()
        h = mix(raw.view(np.uint64))
        out = np.ones(len(raw), dtype=bool)
        for j in range(3):
            at = (raw % 256) * size + _spot(h, j, size)
            out &= (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(out)

    return bodies.filter(may_be("_th"))


def _spot(h: np.ndarray, j: int, size: int) -> np.ndarray:
    return ((mix(h + U(j + 1)) >> U(32)) % U(size)).astype(np.int64)


def _resolved(docs: DataFrame, id_col: str, text_col: str, threshold: float, recall: float, small: int, depth: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, h1, h2) of every row, and for every set (h1, h2) its class_id, n_links, where a text of it is, and
    whether it stands for its class."""
    described = saved(_described(batched(docs), id_col, text_col, runs(threshold, recall, depth), threshold))
    worded = described.filter("h1 IS NOT NULL")
    # one row per set: a number of its own, how many copies, the smallest id, and where to find a text of it
    sets = saved(
        worded.groupBy("h1", "h2").agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("where"),
            F.first("sketch").alias("sketch"), F.first("paths").alias("paths"),
        ).withColumn("key", F.monotonically_increasing_id())
    )
    group = components(_groups(sets, threshold, small, depth)).select(F.col("node").alias("key"), F.col("root").alias("grp"))
    members = saved(group.join(sets.select("key", "copies", "where"), "key"))
    sized = members.join(saved(members.groupBy("grp").agg(F.count("*").alias("size"))), "grp")
    text = F.coalesce(F.col(text_col), F.lit(""))
    wanted = sized.select("grp", "key", "copies", "size", F.col("where.doc_id").alias("d"), F.col("where.th").alias("th"))
    bodies = _likely(docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_th"), text.alias("text")), members)
    found = bodies.hint("merge").join(wanted, bodies["_id"].eqNullSafe(wanted["d"]) & (bodies["_th"] == wanted["th"])).select("grp", "key", "copies", "size", "text")
    dealt = _blocks(found, "size", block).select("grp", "lo", "hi", "part", "key", "copies", "text")
    checked = saved(dealt.groupBy("grp", "lo", "hi").applyInArrow(lambda t: _verified(t, threshold), "a long, b long, links long"))
    links = checked.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    root = components(checked.filter("a <> b").select("a", "b")).select(F.col("node").alias("key"), "root")
    named = sets.select("key", "h1", "h2", "copies", "first", "where").join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("first").alias("class_id"), F.min_by("key", "where").alias("stands"))
    info = named.join(least, "root").join(links, "key", "left").select(
        "h1", "h2", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "where", (F.col("key") == F.col("stands")).alias("stands")
    )
    return described, info


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: id, class_id (the smallest id of its class), n_links.

    Two documents are linked if the sets of five words in a row (A-Z in lower case; all words, if fewer) of their
    whole texts have a Jaccard similarity of ``threshold`` or more. A class is what links connect. ``n_links`` counts the
    documents that a document is linked to, copies included. Texts without words (null, empty, blank) are linked to
    nothing, each is a class of its own. Repeated rows are copies. Null ids are allowed: the class id is the
    smallest id that isn't null, null if there is none. Other columns are ignored; an empty table gives none.
    """
    described, info = _resolved(docs, id_col, text_col, threshold, recall, small, depth, block)
    with_words = described.filter("h1 IS NOT NULL").select("doc_id", "h1", "h2").join(info, ["h1", "h2"]).select("doc_id", "class_id", "n_links")
    without = described.filter("h1 IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(without).withColumnRenamed("doc_id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, small: int = SMALL, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each class (see ``near_duplicates``): that with the smallest id (null last).

    Of repeated rows one stays. Rows without words all stay. Columns stay as they are.
    """
    _, info = _resolved(docs, id_col, text_col, threshold, recall, small, depth, block)
    key = [f"_{uuid.uuid4().hex}_{i}" for i in range(3)]  # names that no column of the input has
    named = lambda d, th: [F.coalesce(d, F.lit(0)).alias(key[0]), d.isNull().alias(key[1]), th.alias(key[2])]
    stays = info.filter("stands").select(*named(F.col("where.doc_id"), F.col("where.th")))
    worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.filter(worded).select("*", *named(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))))
    # plain equality of all three, so that the copies of a row are dropped where the join has put them
    kept = marked.hint("merge").join(stays, key, "left_semi").dropDuplicates(key)
    return kept.drop(*key).unionByName(docs.filter(~worded))
