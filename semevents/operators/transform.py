"""Rule-based rewriting of events, with modes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import passed

_OUT = "struct<type:string,name:string,attributes:map<string,string>,text:string>"


def _out(kind: str, name: str | None = None, attributes: dict[str, str] | None = None, text: Column | str | None = None) -> Column:
    pairs = [x for k, v in (attributes or {}).items() for x in (F.lit(k), F.lit(v))]
    given = F.create_map(*pairs).cast("map<string,string>") if kind == "mark" else F.lit(None).cast("map<string,string>")
    body = text if isinstance(text, Column) else F.lit(text)
    return F.struct(F.lit(kind).alias("type"), F.lit(name).cast("string").alias("name"), given.alias("attributes"), body.cast("string").alias("text")).cast(_OUT)


@dataclass
class Body:
    """What a rule writes: texts and elements before and after the children."""

    before: list[Column] = field(default_factory=list)
    after: list[Column] = field(default_factory=list)
    child_mode: str | None = None
    called: bool = False

    def _add(self, *items: Column) -> Body:
        (self.after if self.called else self.before).extend(items)
        return self

    def text(self, text: str | Column) -> Body:
        """A literal, or a column over the mark's name, is_tag and attributes."""
        return self._add(_out("text", text=text))

    def children(self, mode: str | None = None) -> Body:
        self.child_mode, self.called = mode, True
        return self

    def element(self, name: str, attributes: dict[str, str] | None = None, body: Body | None = None) -> Body:
        """An element around ``body``, and so around the children if the body has them."""
        body = body or Body()
        self._add(_out("mark", name, attributes), *body.before)
        if body.called:
            self.children(body.child_mode)
        return self._add(*body.after, _out("unmark", name))


@dataclass
class Transformer:
    """Ordered rules; the first that matches wins. One text rule, of which the last one set counts."""

    rules: list[tuple[Column, str | None, Body]] = field(default_factory=list)
    text_rule: Callable[[Column], Column] | None = None

    def match(self, what: str | Column, body: Body, mode: str | None = None) -> Transformer:
        """``what``: a name, or a predicate over name, is_tag and attributes. Mode null matches any mode."""
        self.rules.append((F.col("name") == what if isinstance(what, str) else what, mode, body))
        return self

    def match_text(self, rule: Callable[[Column], Column]) -> Transformer:
        """``rule``: from the text to what replaces it; null drops the text."""
        self.text_rule = rule
        return self


class _Rules:
    """One document's pass: the open marks' rules and modes, and where the output is."""

    def __init__(self, shapes: list[tuple[str | None, str | None, int, int]]):
        self.shapes = shapes
        self.open: list[list] = []
        self.seq = 0

    def step(self, kind: str, fits: list[int] | None, kept: bool) -> tuple[int | None, int]:
        rule, at = None, self.seq
        if kind == "text":
            self.seq += bool(kept)
        elif kind == "mark":
            mode = self.open[-1][1] if self.open else None
            rule = next((i for i in fits or () if self.shapes[i][0] in (None, mode)), None)
            self.open.append([rule, mode if rule is None else self.shapes[rule][1]])
            self.seq += 0 if rule is None else self.shapes[rule][2]
        elif self.open:
            rule = self.open.pop()[0]
            self.seq += 0 if rule is None else self.shapes[rule][3]
        return rule, at

    def state(self) -> dict:
        return {"open": self.open, "seq": self.seq}

    def restore(self, state: dict) -> None:
        self.open, self.seq = state["open"], state["seq"]


def transform(events: DataFrame, transformer: Transformer, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Events rewritten by rules; ``events`` may be a stream (whose events of a document come in order).

    A mark without a rule goes with its unmark, its children stay in their mode. Output is not from tags; an unmark takes
    the rule of the mark that it closes, unmarks without a mark go. Catalyst decides which rules' conditions fit and writes the
    output; in between one pass in order keeps the open marks' rules and modes, however deep they nest.
    """
    rules = transformer.rules
    fits = F.filter(F.array(*[F.when(condition, F.lit(i)) for i, (condition, _, _) in enumerate(rules)]).cast("array<int>"), lambda i: i.isNotNull())
    text = transformer.text_rule(F.col("text")) if transformer.text_rule else F.col("text")
    is_mark, is_text = F.col("type") == "mark", F.col("type") == "text"
    known = events.select(
        *keys, "seq", "type", "name", "is_tag", "attributes", F.when(is_text, text).alias("text"),
        F.when(is_mark, fits).alias("_fits"), F.coalesce(is_text & text.isNotNull(), F.lit(False)).alias("_kept"),
    )
    shapes = [(mode, body.child_mode, len(body.before), len(body.after)) for _, mode, body in rules]
    out = passed(known, keys, lambda: _Rules(shapes), ("type", "_fits", "_kept"), "_rule int, _at int")
    empty = F.array().cast(f"array<{_OUT}>")
    written = F.when(F.col("_kept"), F.array(_out("text", text=F.col("text")))).otherwise(empty)
    for i, (_, _, body) in enumerate(rules):
        for kind, items in (("mark", body.before), ("unmark", body.after)):
            if items:
                written = F.when((F.col("type") == kind) & (F.col("_rule") == i), F.array(*items)).otherwise(written)
    spread = out.select(*keys, "_at", F.posexplode(written).alias("k", "e"))
    return spread.select(
        *keys, (F.col("_at") + F.col("k")).cast("int").alias("seq"), F.col("e.type").alias("type"), F.col("e.name").alias("name"),
        F.when(F.col("e.type") != "text", F.lit(False)).alias("is_tag"), F.col("e.attributes").alias("attributes"), F.col("e.text").alias("text"),
    )
