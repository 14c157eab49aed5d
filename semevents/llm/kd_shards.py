"""Sharding by a k-d tree over document metadata (DataFrame functions only).

A node that has to hold k shards is cut along its widest metadata dimension at the weighted quantile that gives
floor(k/2) of its k shards to the left, the weight being bytes, until each leaf is one shard and so reaches the
target bytes. Quantiles are found by distributed histograms that are refined around the boundary, so what reaches
the driver is bounded by nodes x bins whatever the input; the tree itself is one nested CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Rows that one (shard, block) numbers by itself when slots are dealt.
SLOT_BLOCK = 4096
BINS = 1024
#: Refinements after which a cut is taken as it is: bins are then finer than doubles can tell apart.
ROUNDS = 8


@dataclass
class Node:
    shards: int
    first: int
    dim: str | None = None
    at: float | None = None
    kids: list[Node] = field(default_factory=list)


def _walk(node: Node, leaf) -> Column:
    """The nested CASE that sends a row to its leaf; ``leaf`` maps a leaf node to a literal."""
    if node.at is None:
        return leaf(node)
    return F.when(F.col(node.dim) < F.lit(node.at), _walk(node.kids[0], leaf)).otherwise(_walk(node.kids[1], leaf))


def _leaves(node: Node) -> list[Node]:
    return [node] if node.at is None else [x for k in node.kids for x in _leaves(k)]


def grow(meta: DataFrame, dims: list[str], shards: int) -> Node:
    """The tree for ``meta`` (columns ``dims``, ``weight``)."""
    root = Node(shards, 0)
    whole = None
    while True:
        open_nodes = [n for n in _leaves(root) if n.shards > 1 and n.dim is None]
        if not open_nodes:
            return root
        number = {id(n): i for i, n in enumerate(open_nodes)}
        at = meta.withColumn("node", _walk(root, lambda n: F.lit(number.get(id(n), -1)))).filter("node >= 0")
        extents = {
            r["node"]: r
            for r in at.groupBy("node").agg(
                F.sum("weight").alias("w"),
                *[F.min(d).alias(f"lo_{d}") for d in dims],
                *[F.max(d).alias(f"hi_{d}") for d in dims],
            ).collect()
        }
        if whole is None and 0 in extents:
            whole = {d: max(extents[0][f"hi_{d}"] - extents[0][f"lo_{d}"], 1e-300) for d in dims}
        search = {}
        for i, n in enumerate(open_nodes):
            if i not in extents:  # no rows: its shards stay empty but for the first
                n.dim = ""
                continue
            e = extents[i]
            n.dim = max(dims, key=lambda d: (e[f"hi_{d}"] - e[f"lo_{d}"]) / whole[d])
            lo, hi = e[f"lo_{n.dim}"], e[f"hi_{n.dim}"]
            search[i] = {"lo": lo, "width": (hi - lo) * (1 + 1e-9) or 1.0, "left": 0, "w": e["w"], "goal": e["w"] * (n.shards // 2) / n.shards, "best": None}
        _cuts(at, open_nodes, search)
        for i, n in enumerate(open_nodes):
            if n.dim:
                n.at = float(search[i]["best"])
                half = n.shards // 2
                n.kids = [Node(half, n.first), Node(n.shards - half, n.first + half)]


def _cuts(at: DataFrame, nodes: list[Node], search: dict[int, dict]) -> None:
    """Refine each node's boundary until the bin around its quantile holds one row."""
    active = dict(search)
    for _ in range(ROUNDS):
        if not active:
            return
        pick = lambda f, kind: F.element_at(F.create_map(*[x for i, s in active.items() for x in (F.lit(i), f(i, s))]), F.col("node")).cast(kind)
        rows = (
            at.filter(F.col("node").isin(list(active)))
            .withColumn("x", pick(lambda i, s: F.col(nodes[i].dim), "double") - pick(lambda i, s: F.lit(float(s["lo"])), "double"))
            .withColumn("bin", F.col("x") / pick(lambda i, s: F.lit(float(s["width"])), "double") * BINS)
            .filter((F.col("x") >= 0) & (F.col("bin") < BINS))  # rows elsewhere in the node, however far away
            .withColumn("bin", F.floor("bin").try_cast("int"))
            .groupBy("node", "bin")
            .agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
            .collect()
        )
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(r["node"], []).append((r["bin"], r["w"], r["n"]))
        done = []
        for i, s in active.items():
            run, step = s["left"], s["width"] / BINS
            for b, w, n in sorted(by.get(i, [])):
                if run + w >= s["goal"]:
                    below, above = s["lo"] + b * step, s["lo"] + (b + 1) * step
                    s["best"] = below if s["goal"] - run < run + w - s["goal"] else above
                    if n == 1 or step <= max(abs(s["lo"]), 1) * 1e-16:
                        done.append(i)
                    s.update(lo=below, width=step, left=run)
                    break
                run += w
            else:
                s["best"] = s["best"] if s["best"] is not None else s["lo"] + s["width"]
                done.append(i)
        for i in done:
            active.pop(i)


def kd_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tags: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Size is the text's UTF-8 bytes (null: none) plus 16. Dimensions are the size, the id and the ``tags`` (null
    is a value of its own; a missing tag column is left out). Equal values are told apart by a hash of the row and its
    number in the written table, so that copies, rows that repeat in everything, and one source with a third of all
    rows are cut like any other. Null ids are kept. An empty table gives an empty result; extra columns are
    ignored. Shards are near equal in bytes: each cut is off by half a row's bytes at most.
    """
    rows, dims = measured(docs, id_col, text_col, tags)
    tree = grow(rows.select(F.col("size").alias("weight"), *dims), dims, shards)
    blocks = max(1, ceil(rows.count() / (shards * SLOT_BLOCK)))
    placed = rows.select(
        "doc_id", "size", "text_crc32", "u",
        _walk(tree, lambda n: F.lit(n.first)).alias("shard"),
        F.pmod(F.xxhash64("u", F.lit(7)), F.lit(blocks)).alias("block"),
    )
    return _slots(placed, id_col)


def measured(docs: DataFrame, id_col: str, text_col: str, tags: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """The written rows (doc_id, size, text_crc32, u) with their dimensions, and the dimensions' names."""
    tags = tuple(t for t in tags if t in docs.columns)
    body = F.col(text_col).cast("binary")
    meta = saved(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 16).alias("size"),
            F.crc32(F.coalesce(body, F.lit(b""))).alias("text_crc32"),
            *[(F.crc32(F.coalesce(F.col(t).cast("string"), F.lit("\0")).cast("binary")) % 1024).cast("double").alias(f"tag_{t}") for t in tags],
            F.monotonically_increasing_id().alias("row"),
        )
    )
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size", "row"), 12) / F.lit(float(1 << 52))).alias("u")
    rows = meta.select("*", u).select(
        "doc_id", "size", "text_crc32", "u",
        (F.col("size") + F.col("u")).alias("d_size"),
        *[(F.col(f"tag_{t}") + F.col("u")).alias(f"d_{t}") for t in tags],
        (F.coalesce("doc_id", F.lit(0)).cast("double") + F.col("u")).alias("d_id"),
    )
    return rows, ["d_size", *[f"d_{t}" for t in tags], "d_id"]


def _slots(placed: DataFrame, id_col: str) -> DataFrame:
    """Gapless numbers within each shard: a number within a small block plus the rows of the blocks before it."""
    from pyspark.sql import Window

    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "block").orderBy("u", "doc_id", "text_crc32")
    return (
        placed.withColumn("k", F.row_number().over(own))
        .join(counts, ["shard", "block"])
        .select(
            F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("base") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )
