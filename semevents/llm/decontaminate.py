"""Benchmark decontamination by latent semantic retrieval.

Items and texts are cut into passages. Terms are the items' words, weighted by how rare they are among all passages
of the corpus. A distributed randomised SVD of all TF-IDF passages gives a latent space; every window of every text is
put into it and compared by cosine with every passage of the items. Candidates are then checked word by word: the
longest common subsequence of the item and the text around the window, and the item's answer (its last words, or a
column of its own). A close match is a leak by itself, a looser one (a paraphrase) if the answer is there as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import InitVar, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, widened
from .tokens import U, words

#: Words of a passage; a window is two of them that follow each other.
PASSAGE = 16
LATENT, EXTRA, POWER = 64, 16, 2
#: Terms whose sums a worker sends in one row.
BLOCK_TERMS = 64
COSINE = 0.4
CLOSE, LOOSE, ANSWER = 0.7, 0.5, 0.8
#: Words at an item's end that count as its answer, if it has none of its own.
ANSWER_WORDS = 8
#: Items that are searched for at a time. More are taken in turns, one after the other for each batch of texts.
ITEMS = 5000


@dataclass
class Item:
    item_id: int
    terms: np.ndarray
    answer: np.ndarray
    masks: dict[int, int] = field(default_factory=dict)
    answer_masks: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        for terms, into in ((self.terms, self.masks), (self.answer, self.answer_masks)):
            for i, t in enumerate(terms.tolist()):
                into[t] = into.get(t, 0) | 1 << i


def common_subsequence(masks: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence of n words (masks: where each is) and ``other``, bit-parallel."""
    whole = (1 << n) - 1
    row = whole
    for t in other:
        hit = masks.get(t)
        if hit:
            both = row & hit
            row = (row + both | row - both) & whole
    return n - row.bit_count()


@dataclass
class Terms:
    """The items' words: sorted hashes, and a bitmap that most other words fail."""

    hashes: np.ndarray
    bitmap: np.ndarray = field(init=False, repr=False)

    def __post_init__(self):
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[self.hashes >> U(44)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of words that are terms, and which."""
        at = np.flatnonzero(self.bitmap[h >> U(44)])
        k = np.searchsorted(self.hashes, h[at])
        k[k == len(self.hashes)] = 0
        good = self.hashes[k] == h[at] if len(self.hashes) else np.zeros(0, bool)
        return at[good], k[good]


def _passages(w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage of each word, row of each passage, and first passage of each row (texts start a new one)."""
    n = w.ends - w.begins
    count = -(-n // PASSAGE)
    first = np.cumsum(count) - count
    of_word = np.repeat(first, n) + (np.arange(int(n.sum())) - np.repeat(w.begins, n)) // PASSAGE
    return of_word, np.repeat(np.arange(len(n)), count), first


def _read_items(benchmark: DataFrame, id_col: str, text_col: str, answer_col: str | None) -> tuple[list[Item], np.ndarray]:
    got = benchmark.select(id_col, text_col, *([answer_col] if answer_col else [])).filter(F.col(text_col).isNotNull()).toArrow()
    texts = [w.hash[a:b] for _, _, w in words(got[text_col], bare=True) for a, b in zip(w.begins, w.ends, strict=True)]
    answers = [w.hash[a:b] for _, _, w in words(got[answer_col], bare=True) for a, b in zip(w.begins, w.ends, strict=True)] if answer_col else [t[-ANSWER_WORDS:] for t in texts]
    vocabulary = np.unique(np.concatenate([*texts, *answers, np.empty(0, np.uint64)]))
    at = lambda h: np.searchsorted(vocabulary, h)
    items = [Item(i, at(t), at(a)) for i, t, a in zip(got[id_col].to_pylist(), texts, answers, strict=True) if len(t)]
    return items, vocabulary


def _frequencies(docs: DataFrame, terms, text_col: str, size: int) -> tuple[np.ndarray, int]:
    """In how many passages of the corpus each term is, and how many passages there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = terms.value
        df, n = np.zeros(size + 1, dtype=np.int64), 0
        for batch in batches:
            for _, _, w in words(batch.column(0), bare=True):
                passage, row, _ = _passages(w)
                df[size] += len(row)
                at, k = t.find(w.hash)
                if len(at):
                    df[:size] += np.bincount(np.unique(passage[at] * size + k) % size, minlength=size)
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(df[k])], ["k", "n"])

    got = docs.select(text_col).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size + 1, dtype=np.int64)
    df[got["k"].to_numpy()] = got["n"].to_numpy()
    return df[:size], int(df[size])


def _rows(passage: np.ndarray, k: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """TF-IDF rows of length one: row, term, value of each entry, and rows."""
    cell, tf = np.unique(passage * len(idf) + k, return_counts=True)
    row, term = np.divmod(cell, len(idf))
    _, row = np.unique(row, return_inverse=True)
    value = tf * idf[term]
    n = int(row.max()) + 1 if len(row) else 0
    norm = np.sqrt(np.bincount(row, weights=value**2, minlength=n))
    return row, term, value / np.maximum(norm[row], 1e-12), n


def _times(entries, m: np.ndarray) -> np.ndarray:
    """A m for sparse rows A."""
    row, term, value, n = entries
    out = np.zeros((n, m.shape[1]))
    if n:
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out[row[first]] = np.add.reduceat(value[:, None] * m[term], first, axis=0)
    return out


def _back(entries, y: np.ndarray, size: int) -> np.ndarray:
    """A' y for sparse rows A."""
    row, term, value, n = entries
    out = np.zeros((size, y.shape[1]))
    if n:
        order = np.argsort(term, kind="stable")
        t = term[order]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        out[t[first]] = np.add.reduceat(value[order, None] * y[row[order]], first, axis=0)
    return out


def _slots(w, own: np.ndarray, at: np.ndarray, k: np.ndarray, row: np.ndarray, none: int) -> np.ndarray:
    """The terms in each passage's places; ``none`` where a word is no term."""
    slots = np.full((len(row), PASSAGE), none, dtype=np.int32)
    slots[own, (at - w.begins[row[own]]) % PASSAGE] = k
    return slots


def _step(slots: np.ndarray, weighted: np.ndarray, idf: np.ndarray, total: np.ndarray) -> int:
    """Add A'A q to ``total`` but for its rows' factor idf, and return the rows, A being the passages' TF-IDF rows of length
    one. ``weighted``: q times idf, and a row of zeros for no term."""
    order = np.sort(slots, axis=1)
    again = order[:, 1:] == order[:, :-1]
    times = np.ones(slots.shape, dtype=np.int32)
    for j in range(1, PASSAGE):
        times[:, j] += again[:, j - 1] * times[:, j - 1]
    # a term that is there n times adds (n idf) ** 2: the first n odd numbers add up to n ** 2
    square = (np.append(idf**2, 0.0).take(order) * (2 * times - 1)).sum(axis=1)
    y = np.empty((len(slots), weighted.shape[1]), dtype=np.float32)
    for a in range(0, len(slots), 128):  # so few that what is gathered stays in the processor's cache
        y[a : a + 128] = weighted.take(slots[a : a + 128], axis=0).sum(axis=1)
    y /= np.maximum(square, 1e-12).astype(np.float32)[:, None]
    flat = slots.ravel()
    place = np.argsort(flat if len(idf) >= 1 << 15 else flat.astype(np.int16), kind="stable")
    term = flat[place]
    some = int(np.searchsorted(term, len(idf)))
    for a in range(0, some, 2048):
        t = term[a : min(a + 2048, some)]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        total[t[first]] += np.add.reduceat(y.take(place[a : a + len(t)] // PASSAGE, axis=0), first, axis=0)
    return int((square > 0).sum())


def _fit(docs: DataFrame, terms, items: list[Item], idf: np.ndarray, text_col: str) -> np.ndarray:
    """The latent space: terms x LATENT, by randomised SVD of all passages of the corpus and of the items.

    Power steps over the items' passages give a first space; one step over every passage gives the space that is used.
    Workers send sums of terms x (LATENT + EXTRA) numbers, whose size the items bound, a few terms a row. The items'
    passages weigh as much as the corpus passages together.
    """
    size = len(idf)
    own = [i.terms[a : a + PASSAGE] for i in items for a in range(0, len(i.terms), PASSAGE)]
    mine = _rows(np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate(own), idf)
    width = min(LATENT + EXTRA, size)
    q = np.linalg.qr(np.random.Generator(np.random.PCG64(11)).normal(size=(size, width)))[0]
    for _ in range(POWER):
        q = np.linalg.qr(_back(mine, _times(mine, q), size))[0]
    shared = docs.sparkSession.sparkContext.broadcast((np.append(q * idf[:, None], np.zeros((1, width)), axis=0).astype(np.float32), idf))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = terms.value
        weighted, idf = shared.value
        total, n = np.zeros((size, width)), 0
        for batch in batches:
            for _, _, w in words(batch.column(0), bare=True):
                passage, row, _ = _passages(w)
                at, k = t.find(w.hash)
                slots = _slots(w, passage[at], at, k, row, size)
                for a in range(0, len(slots), 1 << 16):  # a very long text takes no more room
                    n += _step(slots[a : a + (1 << 16)], weighted, idf, total)
        if n:
            cuts = range(0, size, BLOCK_TERMS)
            yield pa.RecordBatch.from_arrays([pa.array(list(cuts), pa.int64()), pa.array([n] * len(cuts), pa.int64()), pa.array([total[a : a + BLOCK_TERMS].tobytes() for a in cuts], pa.binary())], ["k", "n", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, n, total = 0, 0, None
        for batch in batches:
            k = batch.column(0)[0].as_py()
            n += sum(batch.column(1).to_pylist())
            for x in batch.column(2).to_pylist():
                total = np.frombuffer(x) + (0 if total is None else total)
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["k", "n", "m"])

    got = docs.select(text_col).mapInArrow(part, "k long, n long, m binary").groupBy("k").applyInArrow(add, "k long, n long, m binary").collect()  # terms x (LATENT + EXTRA) numbers
    y = _back(mine, _times(mine, q), size)
    if got:
        corpus = np.concatenate([np.frombuffer(r["m"]).reshape(-1, width) for r in sorted(got, key=lambda r: r["k"])])
        y = corpus * idf[:, None] + y * (got[0]["n"] / mine[3])
    # of all symmetric matrices that map q to y, y (q'y)^-1 y' has the least rank
    inner = q.T @ y
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > 1e-9 * values[-1]
    return np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)[0][:, :LATENT]


def flag_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, keep_text: bool = True, cosine: float = COSINE) -> DataFrame:
    """``docs`` with ``leaks``: item_id, cosine, lcs (share of the item's words in order), answer (share of its answer).

    An item has leaked into a text if the longest common subsequence of it and the text around a window that is
    near to it has CLOSE of the item's words, or LOOSE of them and ANSWER of the answer's. Each item counts once for
    a text, with its best place. Whole texts are searched. Null and empty texts have no leaks, nor have any if the
    benchmark is empty; items that are null or without words leak nowhere; a repeated item is reported under each
    of its rows' ids. Rows are kept as they are, repeated ones alike; a column named ``leaks`` is replaced.

    Words are those of all items, document frequencies and latent space those of every passage of the texts and items; they
    are held by the driver and each worker, so the benchmark's words must fit there. Rows need no id; ``id_col`` is not read.
    """
    docs = batched(docs).drop("leaks")
    kind = "array<struct<item_id:bigint,cosine:double,lcs:double,answer:double>>"
    items, vocabulary = _read_items(benchmark, item_col, item_text_col, answer_col)
    kept = [c for c in docs.columns if keep_text or c != text_col]
    if not items:
        return docs.select(*kept, F.array().cast(kind).alias("leaks"))
    terms = docs.sparkSession.sparkContext.broadcast(Terms(vocabulary))  # the items' words
    df, passages = _frequencies(docs, terms, text_col, len(vocabulary))
    idf = np.log((1 + passages) / (1 + df)) + 1e-3
    space = (_fit(docs, terms, items, idf, text_col) * idf[:, None]).astype(np.float32)
    out, made = docs, []
    for a in range(0, len(items), ITEMS):
        name = f"_{uuid.uuid4().hex}"  # a name that no column of the input has
        made.append(name)
        out = _search(out, terms, items[a : a + ITEMS], space, df, text_col, name, kind, cosine)
    return out.select(*kept, F.sort_array(F.flatten(F.array(*made))).alias("leaks"))


def _cuts(n: int) -> list[int]:
    """Where the passages of an item of n words begin. A short tail is the end of a passage of the item's last words."""
    out = list(range(0, max(1, n - PASSAGE // 2), PASSAGE))
    return out if out[-1] + PASSAGE >= n else [*out, n - PASSAGE]


def _search(docs: DataFrame, terms, items: list[Item], space: np.ndarray, df: np.ndarray, text_col: str, name: str, kind: str, least: float) -> DataFrame:
    starts = [(i, a) for i, item in enumerate(items) for a in _cuts(len(item.terms))]
    latent = np.stack([space[items[i].terms[a : a + PASSAGE]].sum(axis=0) for i, a in starts])
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    latent = latent / np.maximum(norm, 1e-12)
    shared = docs.sparkSession.sparkContext.broadcast((items, space, Passages(latent, starts, items, len(space), df)))  # ITEMS items, and the space
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = terms.value
        items, space, passages = shared.value
        for batch in batches:
            for a, b, w in words(batch.column(k), bare=True):
                found = _leaks(w, t, items, space, passages, least)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([found.get(i, []) for i in range(b - a)], pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())])))],
                    names=[*batch.schema.names, name],
                )

    return docs.mapInArrow(run, widened(docs, **{name: kind}))


@dataclass
class Passages:
    """The items' passages: latent vectors of length one and (item, first word); the items' distinct terms, the rarest first
    (``common``: in how many passages of the corpus each term is), how often each is in its item, and sizes. ``none`` is no
    term at all; ``first`` terms are looked at first, beside which an item has ``others`` words."""

    latent: np.ndarray
    starts: list[tuple[int, int]]
    items: InitVar[list[Item]]
    none: int
    common: InitVar[np.ndarray]
    item: np.ndarray = field(init=False)
    offset: np.ndarray = field(init=False)
    sizes: np.ndarray = field(init=False)
    terms: np.ndarray = field(init=False)
    times: np.ndarray = field(init=False)

    def __post_init__(self, items: list[Item], common: np.ndarray):
        self.item, self.offset = np.array(self.starts).T
        self.sizes = np.array([len(i.terms) for i in items])
        each = [np.unique(i.terms, return_counts=True) for i in items]
        each = [(t[o], times[o]) for t, times in each for o in [np.argsort(common[t], kind="stable")]]  # the rarest first
        self.terms = np.full((len(items), max(len(t) for t, _ in each)), self.none)
        self.times = np.zeros(self.terms.shape, dtype=np.int32)
        for n, (t, times) in enumerate(each):
            self.terms[n, : len(t)] = t
            self.times[n, : len(t)] = times
        some = np.cumsum(self.times, axis=1)
        self.times = self.times.astype(np.min_scalar_type(int(self.times.max(initial=0))))  # small numbers are multiplied faster
        self.first = int((some <= 0.6 * self.sizes[:, None]).sum(axis=1).max()) + 1
        self.others = self.sizes - some[:, min(self.first, some.shape[1]) - 1]

    def _words(self, hit: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (hit.view(np.uint8) * self.times[n, : hit.shape[1]]).sum(axis=1, dtype=np.int32)

    def shared(self, following: np.ndarray, low: np.ndarray, high: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The share of item i's words that passages low to high have, in any order: no common subsequence is longer.
        ``following``: for each passage and term the passage from there on that has the term next."""
        out = np.zeros(len(i))
        step = max(1, 250_000 // self.terms.shape[1])  # so few that what is gathered stays in the processor's cache
        flat, width = following.reshape(-1), following.shape[1]
        for a in range(0, len(i), step):
            n, lo, hi = i[a : a + step], low[a : a + step, None] * width, high[a : a + step, None]
            # the rarest terms alone mostly tell that the others would not do, even if all were there
            hit = flat.take(lo + self.terms[n, : self.first], mode="clip") <= hi
            may = np.flatnonzero(self._words(hit, n) + self.others[n] >= LOOSE * self.sizes[n])
            hit = flat.take(lo[may] + self.terms[n[may]], mode="clip") <= hi[may]
            out[a + may] = self._words(hit, n[may]) / self.sizes[n[may]]
        return out


def _leaks(w, t: Terms, items: list[Item], space: np.ndarray, passages: Passages, least: float) -> dict[int, list[dict]]:
    passage, row, first = _passages(w)
    at, k = t.find(w.hash)
    if not len(at):
        return {}
    own = passage[at]
    slots = _slots(w, own, at, k, row, len(space))  # words that are no terms add nothing
    padded = np.concatenate((space, np.zeros((1, space.shape[1]), dtype=np.float32)))
    sums = np.zeros((len(row) + 1, space.shape[1]), dtype=np.float32)
    for lo in range(0, len(row), 128):
        sums[lo : min(lo + 128, len(row))] = padded.take(slots[lo : lo + 128], axis=0, mode="clip").sum(axis=1)
    follows = np.append(row[1:] == row[:-1], False)
    sums[:-1][follows] += sums[1:][follows]  # a window: a passage and the next one of its text
    best: dict[tuple[int, int], dict] = {}
    ids = np.full(len(w.hash), -1)
    ids[at] = k
    begins, ends = w.begins, w.ends
    step = max(64, min(4096, (4 << 20) // passages.none))
    for lo in range(0, len(row), step):
        x = sums[lo : min(lo + step, len(row))]
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        near = (x @ passages.latent.T) / np.maximum(norm, 1e-12)
        ps, qs = np.nonzero(near >= least)
        if not len(ps):
            continue
        docs, i, offset = row[lo + ps], passages.item[qs], passages.offset[qs]
        place = (lo + ps - first[docs]) * PASSAGE - offset  # in the text, where the item begins if the passage begins the window
        # windows and passages that put an item at the same place of a text are one case; the first stands for it
        wide = int((ends - begins).max()) + 2 * int(passages.sizes.max())
        cases = np.sort(np.unique((docs * len(items) + i) * wide + place + int(passages.sizes.max()), return_index=True)[1])
        ps, qs, docs, i, place = ps[cases], qs[cases], docs[cases], i[cases], place[cases]
        left = np.maximum(0, place - PASSAGE // 2)
        right = np.minimum((ends - begins)[docs], place + 2 * PASSAGE + passages.sizes[i])
        low, high = first[docs] + left // PASSAGE, first[docs] + (right - 1) // PASSAGE
        base, top = int(low.min()), int(high.max()) + 1
        kind = np.int16 if top - base < 32_000 else np.int32
        following = np.full((top - base, passages.none + 1), np.iinfo(kind).max, dtype=kind)
        a, b = np.searchsorted(own, [base, top])
        following[own[a:b] - base, k[a:b]] = own[a:b] - base
        for r in range(len(following) - 2, -1, -1):
            np.minimum(following[r], following[r + 1], out=following[r])
        most = passages.shared(following, low - base, high - base, i)
        for c in np.flatnonzero(most >= LOOSE):
            p, q, doc, n = ps[c], qs[c], int(docs[c]), int(i[c])
            item = items[n]
            old = best.get((doc, n))
            if old is not None and most[c] <= old["lcs"]:
                continue
            size = len(item.terms)
            span = ids[int(begins[doc] + left[c]) : int(begins[doc] + right[c])]
            around = span[span >= 0].tolist()
            lcs = common_subsequence(item.masks, size, around) / size
            if lcs < LOOSE or old is not None and lcs <= old["lcs"]:
                continue
            answer = common_subsequence(item.answer_masks, len(item.answer), around) / max(1, len(item.answer))
            if lcs >= CLOSE or answer >= ANSWER:
                best[doc, n] = {"item_id": item.item_id, "cosine": float(near[p, q]), "lcs": lcs, "answer": answer}
    out: dict[int, list[dict]] = {}
    for (doc, _), hit in sorted(best.items(), key=lambda x: (x[0][0], x[1]["item_id"])):
        out.setdefault(doc, []).append(hit)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer): a row for each item that has leaked into a document."""
    flagged = flag_leaks(docs.select("doc_id", "text"), benchmark, keep_text=False)
    return flagged.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.*")
