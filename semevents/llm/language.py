"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum,
over all ways to cut it into pieces, of the product of their probabilities: the forward algorithm gives it in one
pass. Words are runs of letters in lower case, with the vocabulary's word start before them. Piece probabilities
are learned by expectation-maximisation with the same forward (and the backward) sums.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batched, remainder, saved, widened
from .pieces import SPACE, load

#: The most documents that piece probabilities are learned from; those with the smallest hash of the id are taken.
TRAIN_DOCS = 3000
STEPS = 2
SMOOTH = 0.05
#: Words whose probabilities a worker remembers; beyond it, it forgets all.
REMEMBER = 300_000
#: Longer words are summed with rescaling, one by one. Up to this length products of the smallest probabilities stay in range.
LONG = 30
_WORD = re.compile(r"[^\W\d_]+")
_GRID: dict[str, Grid] = {}


class Grid:
    """All pieces in words, as arrays."""

    def __init__(self, model: bytes):
        own = load(model)
        ids = sorted(own.text)
        self.size = len(ids) + 1  # the last is a character that no piece is
        self.find = ahocorasick.Automaton()  # reports the row and the length of a piece in one number
        for k, i in enumerate(ids):
            self.find.add_word(own.text[i], k << 16 | len(own.text[i]))
        self.find.make_automaton()
        self.lone = np.ones(sys.maxunicode + 1, dtype=bool)  # characters that are no piece
        self.lone[[ord(c) for c in own.single] + [ord("\n")]] = False

    @staticmethod
    def of(model: bytes) -> Grid:
        key = hashlib.sha256(model).hexdigest()
        if key not in _GRID:
            _GRID[key] = Grid(model)
        return _GRID[key]

    def matches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """word, start, end, piece of every piece in every word, by end and word; and the words' lengths (with the start)."""
        joined = "\n".join([SPACE + w for w in words])
        sizes = np.array([len(w) + 1 for w in words])
        found = np.fromiter(chain.from_iterable(self.find.iter(joined)), dtype=np.int64).reshape(-1, 2)
        at, piece, size = found[:, 0], found[:, 1] >> 16, found[:, 1] & 0xFFFF
        extra = np.flatnonzero(self.lone[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)])
        if len(extra):
            at = np.concatenate((at, extra))
            piece = np.concatenate((piece, np.full(len(extra), self.size - 1)))
            size = np.concatenate((size, np.ones(len(extra), dtype=np.int64)))
            order = np.argsort(at, kind="stable")
            at, piece, size = at[order], piece[order], size[order]
        begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        w = np.repeat(np.arange(len(words)), sizes + 1)[at]
        end = at - begin[w] + 1
        order = np.argsort(end.astype(np.min_scalar_type(int(sizes.max()))), kind="stable")
        return w[order], (end - size)[order], end[order], piece[order], sizes

    def log_probability(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log of the summed probability of each word by language; p: pieces x languages."""
        out = np.zeros((len(words), p.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for a in range(0, len(short), 20_000):
            part = short[a : a + 20_000]
            out[part] = np.log(self._forward([words[i] for i in part], p))
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._long(w, p)
        return out

    def _forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        w, start, end, piece, sizes = self.matches(words)
        alpha = np.zeros((int(sizes.max()) + 1, len(words), p.shape[1]))
        alpha[0] = 1
        cuts = np.searchsorted(end, np.arange(1, len(alpha) + 1))
        for k in range(1, len(alpha)):
            s = slice(cuts[k - 1], cuts[k])
            own = w[s]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            if len(first):
                alpha[k, own[first]] = np.add.reduceat(alpha[start[s], own] * p[piece[s]], first, axis=0)
        return alpha[sizes, np.arange(len(words))]

    def _long(self, word: str, p: np.ndarray) -> np.ndarray:
        """A ring of the last sums only, rescaled as it goes, so that neither memory nor range runs out."""
        _, start, end, piece, sizes = self.matches([word])
        n = int(sizes[0])
        far = int((end - start).max()) + 1
        ring = np.zeros((far, p.shape[1]))
        ring[0] = 1
        scale = np.zeros(p.shape[1])
        cuts = np.searchsorted(end, np.arange(1, n + 2))
        for k in range(1, n + 1):
            s = slice(cuts[k - 1], cuts[k])
            ring[k % far] = (ring[start[s] % far] * p[piece[s]]).sum(axis=0)
            if k % 16 == 0:
                most = ring.max(axis=0)
                ring /= most
                scale += np.log(most)
        return np.log(ring[n % far]) + scale

    def expected(self, words: list[str], lang: np.ndarray, count: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language: forward times backward sums."""
        long = [i for i, x in enumerate(words) if len(x) > LONG]
        if long:
            short = [i for i, x in enumerate(words) if len(x) <= LONG]
            out = self.expected([words[i] for i in short], lang[short], count[short], p) if short else np.zeros(p.shape)
            for i in long:
                piece, use = self._expected_long(words[i], p[:, lang[i]])
                out[:, lang[i]] += np.bincount(piece, weights=use * count[i], minlength=len(out))
            return out
        w, start, end, piece, sizes = self.matches(words)
        prob = p[piece, lang[w]]
        top = int(sizes.max()) + 1
        alpha, beta = np.zeros((top, len(words))), np.zeros((top, len(words)))
        alpha[0] = 1
        beta[sizes, np.arange(len(words))] = 1
        cuts = np.searchsorted(end, np.arange(1, top + 1))
        for k in range(1, top):
            s = slice(cuts[k - 1], cuts[k])
            alpha[k] = np.bincount(w[s], weights=alpha[start[s], w[s]] * prob[s], minlength=len(words))
        order = np.argsort(-start, kind="stable")
        back = np.searchsorted(-start[order], -np.arange(top), "left"), np.searchsorted(-start[order], -np.arange(top), "right")
        for k in range(top - 2, -1, -1):
            s = order[back[0][k] : back[1][k]]
            beta[k] += np.bincount(w[s], weights=beta[end[s], w[s]] * prob[s], minlength=len(words))
        use = alpha[start, w] * prob * beta[end, w] / alpha[sizes[w], w] * count[w]
        return np.bincount(piece * p.shape[1] + lang[w], weights=use, minlength=p.size).reshape(p.shape)


    def _expected_long(self, word: str, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces wherever they stand in one word of any length, and how often each is used there: sums of logarithms."""
        _, start, end, piece, sizes = self.matches([word])
        n, log = int(sizes[0]), np.log(p[piece])
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0
        cuts = np.searchsorted(end, np.arange(n + 2))
        for k in range(1, n + 1):
            s = slice(cuts[k], cuts[k + 1])
            alpha[k] = np.logaddexp.reduce(alpha[start[s]] + log[s])
        order = np.argsort(start, kind="stable")
        cuts = np.searchsorted(start[order], np.arange(n + 2))
        for k in range(n - 1, -1, -1):
            s = order[cuts[k] : cuts[k + 1]]
            if len(s):
                beta[k] = np.logaddexp.reduce(beta[end[s]] + log[s])
        return piece, np.exp(alpha[start] + log + beta[end] - alpha[n])


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def train(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, rows: int | None = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities (pieces x languages), from at most ``rows`` documents with a language, or from
    all of them (None).

    Rows with a null id, text or language teach nothing. What reaches the driver is pieces x languages numbers.
    """
    sc = docs.sparkSession.sparkContext
    sample = batched(docs).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    if learn is not None:
        sample = sample.filter(learn)
    if rows is not None:
        picked = sample.select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(rows).distinct()
        sample = sample.join(F.broadcast(picked), id_col)  # at most `rows` ids
    sample = sample.select(text_col, F.col(lang_col).alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[lang].update(words_of(text))
            for lang, c in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "n"])

    table = saved(sample.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    if not langs:
        return [], np.zeros((Grid.of(model).size, 0))
    size = Grid.of(model).size
    p = np.full((size, len(langs)), 1.0 / size)
    vocabulary = sc.broadcast(model)
    for step in range(STEPS + 1):
        shared = sc.broadcast((p, langs, step))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            grid = Grid.of(vocabulary.value)
            p, langs, step = shared.value
            at = {x: i for i, x in enumerate(langs)}
            total = np.zeros(p.shape)
            for batch in batches:
                for a in range(0, batch.num_rows, 20_000):
                    part = batch.slice(a, 20_000)
                    ws, n = part.column(1).to_pylist(), part.column(2).to_numpy().astype(float)
                    k = np.array([at[x] for x in part.column(0).to_pylist()])
                    if step:
                        total += grid.expected(ws, k, n, p)
                    else:  # to begin with, each piece counts wherever it stands
                        w, _, _, piece, _ = grid.matches(ws)
                        total += np.bincount(piece * len(langs) + k[w], weights=n[w], minlength=p.size).reshape(p.shape)
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, k])], ["lang", "piece", "n"])

        got = table.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()
        use = np.zeros(p.shape)
        use[got["piece"].to_numpy(), got["lang"].to_numpy()] = np.round(got["n"].to_numpy(), 9)
        p = (use + SMOOTH) / (use + SMOOTH).sum(axis=0)
    return langs, p


def identify(docs: DataFrame, model: bytes, langs: list[str], p: np.ndarray, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (the best language's share of the summed probability, 0 to 1).

    The whole text counts. A null text, or one without a letter, is ``und`` with score 0; equal languages go to the
    first by name. Columns of those names are replaced, others kept (the text only if so asked);
    repeated rows are scored alike.
    """
    docs = batched(docs).drop("lang_pred", "lang_score")
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((model, langs, p))  # pieces x languages, whatever the input
    k = docs.columns.index(text_col)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != k]
    schema = widened(docs.select(*[docs.columns[i] for i in kept]), lang_pred="string", lang_score="double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, langs, p = shared.value
        grid = Grid.of(model)
        at: dict[str, int] = {}
        table = np.zeros((1024, len(langs)))
        for whole in batches:
            for a in range(0, max(whole.num_rows, 1), 1000):
                batch = whole.slice(a, 1000)
                pred, score = [], []
                if len(at) > REMEMBER:
                    at.clear()
                texts = [words_of(t) if t else [] for t in batch.column(k).to_pylist()]
                new = sorted(set(chain.from_iterable(texts)).difference(at))
                if new and langs:
                    base = len(at)
                    while len(table) < base + len(new):
                        table = np.concatenate((table, np.zeros_like(table)))
                    table[base : base + len(new)] = grid.log_probability(new, p)
                    at.update(zip(new, range(base, base + len(new)), strict=True))
                for t in texts:
                    if not t or not langs:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    total = table[np.fromiter(map(at.__getitem__, t), np.int64, len(t))].sum(axis=0)
                    best = int(total.argmax())
                    pred.append(langs[best])
                    score.append(float(1 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*[whole.schema.names[i] for i in kept], "lang_pred", "lang_score"])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, model: bytes, modulus: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``; a null doc_id is not held out and not learned."""
    held_out = F.coalesce(remainder("doc_id", modulus) == held, F.lit(False))
    langs, p = train(docs, model, learn=~held_out)
    out = identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, langs, p, keep_text=False)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
