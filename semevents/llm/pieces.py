"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once; at each position it reports, over its output links, every piece that ends there,
and each report relaxes the best score at that position. Scores are the vocabulary's own. Where no piece covers a
character, the vocabulary's byte pieces spell it. Texts are cut where no piece can cross (before white space), which
leaves the best path as it is and lets words that repeat be looked up.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import batched, widened

SPACE = "▁"
#: Words whose pieces a worker remembers; beyond it, it forgets all and starts anew.
REMEMBER = 300_000
#: What an unknown character costs beside the lowest score of the vocabulary.
PENALTY = 10.0


class Pieces:
    """A vocabulary of scored pieces, with an automaton over them."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor()
        sp.LoadFromSerializedProto(model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.text = {i: sp.id_to_piece(i) for i in plain}
        self.byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        self.back = {i: bytes([b]) for b, i in self.byte.items()}
        score = {i: sp.get_score(i) for i in plain}
        self.lowest = min(score.values(), default=0.0) - PENALTY
        self.find = ahocorasick.Automaton()
        for i in plain:
            self.find.add_word(self.text[i], (len(self.text[i]), score[i], i))
        self.find.make_automaton()
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.text.values()):
            raise ValueError("a piece crosses the start of a word; texts can't be cut there")
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|\n+|{SPACE}+")
        self.single = frozenset(p for p in self.text.values() if len(p) == 1)
        self.known: dict[str, tuple[bytes, float]] = {}
        spelled = [self.back.get(i, self.text.get(i, "").replace(SPACE, " ").encode()) for i in range(n)]
        self.sizes = np.array([len(x) for x in spelled], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.letters = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def best(self, word: str) -> tuple[list[int], float]:
        """The best segmentation of ``word``: ids and score. Of equal scores the longer last piece stays."""
        n = len(word)
        score = [0.0] + [-np.inf] * n
        back = [(0, -1)] * (n + 1)
        if self.single.issuperset(word):  # every position can be reached by pieces
            for end, (size, s, i) in self.find.iter(word):
                end += 1
                at = score[end - size] + s
                if at > score[end]:
                    score[end], back[end] = at, (end - size, i)
        else:
            ends: list[list] = [[] for _ in range(n + 1)]
            for end, found in self.find.iter(word):
                ends[end + 1].append(found)
            for end in range(1, n + 1):
                for size, s, i in ends[end]:
                    at = score[end - size] + s
                    if at > score[end]:
                        score[end], back[end] = at, (end - size, i)
                if word[end - 1] not in self.single and score[end - 1] + self.lowest > score[end]:
                    score[end], back[end] = score[end - 1] + self.lowest, (end - 1, -1)
        ids: list[int] = []
        end = n
        while end:
            start, i = back[end]
            ids.extend([i] if i >= 0 else [self.byte[b] for b in reversed(word[start:end].encode())])
            end = start
        return ids[::-1], score[n]

    def _word(self, word: str) -> tuple[bytes, float]:
        ids, s = self.best(word)
        out = np.array(ids, dtype="<i4").tobytes(), s
        if len(word) <= 64:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            self.known[word] = out
        return out

    def encode(self, text: str) -> tuple[bytes, float]:
        """The ids of a text as little-endian 32-bit integers, and their score. An empty text has no ids.

        A space before the text is taken as read. A literal U+2581 is spelled in bytes, so that it comes back.
        """
        if not text:
            return b"", 0.0
        get, own = self.known.get, self._word
        parts = (" " + text).split(SPACE)
        mark = np.array([self.byte[b] for b in SPACE.encode()], dtype="<i4").tobytes() if len(parts) > 1 else b""
        done, total = [], 0.0
        for part in parts:
            got = [get(w) or own(w) for w in self.cut.findall(part.replace(" ", SPACE))]
            done.append(b"".join([x[0] for x in got]))
            total += sum([x[1] for x in got])
        return mark.join(done), total + (len(parts) - 1) * self.lowest

    def decode(self, ids: np.ndarray) -> str:
        """The text that ``ids`` spell, without the space that encoding puts before it."""
        if not len(ids):
            return ""
        size = self.sizes[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.letters[at].tobytes().decode("utf-8", "replace")[1:]


_LOADED: dict[str, Pieces] = {}


def load(model: bytes) -> Pieces:
    """One automaton for each vocabulary and process."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_pieces(docs: DataFrame, model: bytes, text_col: str = "text", keep_ids: bool = True, digest: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``ids`` (array<int>), ``n_pieces`` and ``piece_score``; nulls count as empty texts: no ids.

    ``digest`` adds ``ids_crc32`` (of the ids as little-endian 32-bit integers) and ``round_trip`` (decoding gives
    the text back). Columns of those names are replaced, others kept (the text only if so asked);
    repeated rows are encoded alike.
    """
    added = (["ids"] if keep_ids else []) + ["n_pieces", "piece_score"] + (["ids_crc32", "round_trip"] if digest else [])
    docs = batched(docs).drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file
    k = docs.columns.index(text_col)
    kinds = {"ids": "array<int>", "n_pieces": "int", "piece_score": "double", "ids_crc32": "bigint", "round_trip": "boolean"}
    kept = [i for i in range(len(docs.columns)) if keep_text or i != k]
    schema = widened(docs.select(*[docs.columns[i] for i in kept]), **{c: kinds[c] for c in added})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        own = load(shared.value)
        for whole in batches:
            for at in range(0, max(whole.num_rows, 1), 500):
                batch = whole.slice(at, 500)
                texts = [t or "" for t in batch.column(k).to_pylist()]
                got = [own.encode(t) for t in texts]
                out = {"n_pieces": pa.array([len(b) // 4 for b, _ in got], pa.int32()), "piece_score": pa.array([s for _, s in got], pa.float64())}
                if keep_ids:
                    ends = np.concatenate(([0], np.cumsum([len(b) // 4 for b, _ in got]))).astype(np.int32)
                    out["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(b for b, _ in got), dtype="<i4"), pa.int32()))
                if digest:
                    out["ids_crc32"] = pa.array([zlib.crc32(b) for b, _ in got], pa.int64())
                    out["round_trip"] = pa.array([own.decode(np.frombuffer(b, dtype="<i4")) == t for (b, _), t in zip(got, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], *[out[c] for c in added]], names=[*[whole.schema.names[i] for i in kept], *added])

    return docs.mapInArrow(run, schema)


def decode_pieces(docs: DataFrame, model: bytes, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col``: what the ids of each row spell; null for null."""
    docs = docs.drop(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    k = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(shared.value)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, dtype=np.int64)) for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return docs.mapInArrow(run, widened(docs, **{text_col: "string"}))
