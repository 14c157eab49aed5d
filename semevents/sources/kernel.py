"""The Markdown kernel: a line-oriented block layer over an inline layer, fed chunk by chunk, without Spark.

The block layer decides what a line is as soon as its beginning tells; then the line's text streams through the inline
layer, which holds back no more than a tail that could still become something else. All state is plain data, so that
it fits into one JSON string between micro-batches.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from ..model import Event, mark_event, text_event, unmark_event

# Spans in the order in which the end of a block closes them.
CLOSING = ["math", "code", "mark", "sup", "sub", "del", "em", "strong"]
# Toggling delimiter runs.
TOGGLES = {"*": ["em"], "**": ["strong"], "_": ["em"], "__": ["strong"], "~": ["sub"], "~~": ["del"], "==": ["mark"]}
PLAIN = re.compile(r"[^\\`*_~^=$!\[<]+")
RUN = re.compile(r"\*+|_+|~+|=+")
NAME = r"[\w.-]+:[\w.-]+"
ATTRIBUTE = re.compile(r"""([\w:.-]+)=["']([^"']*)["']""")
SEPARATOR = re.compile(r"\|[-:|\s]+\|")
HEADING, NUMBER, TASK = re.compile(r"(#{1,6}) "), re.compile(r"\d+\. "), re.compile(r"- \[([ x])\] ")
FENCE, BREAK = re.compile(r"```([a-zA-Z0-9]*)"), re.compile(r"-{3,}")
#: Beginnings that may become something other than a paragraph, a task, an item.
UNDECIDED = re.compile(r"#{1,6}|`{1,2}|```[a-zA-Z0-9]*|-+|- |- \[[ x]?\]?|\d+\.?|>|\$\$?")
MAYBE_TASK, MAYBE_BULLET, MAYBE_NUMBER = re.compile(r"- \[[ x]?\]?"), re.compile(r"-|- |- \[[ x]?\]?"), re.compile(r"\d+\.?")
VERSION = 1


@lru_cache
def _tag_patterns(tag_names: tuple[str, ...]) -> tuple[re.Pattern, re.Pattern]:
    """An open tag, and what may become one."""
    names = "|".join([NAME, *map(re.escape, tag_names)])
    return re.compile(rf"<({names})((?:\s[^>]*)?)(/?)>"), re.compile(rf"<[\w.:-]*/?$|<(?:{names})\s[^>]*$")


class Inline:
    """Toggled spans over streamed text."""

    def __init__(self, emit):
        self.emit = emit
        self.tail = ""
        self.raw = ""
        self.open: list[str] = []

    def feed(self, text: str) -> None:
        self.tail += text
        self._run(False)

    def settle(self) -> None:
        """The line ends: what is held back is decided, spans stay open; code and math end with the line."""
        self._run(True)
        if self.raw:
            if self.tail:
                self.emit(text_event(self.tail))
            self._toggle("math" if self.raw == "$" else "code")
            self.raw = ""
        self.tail = ""

    def flush(self) -> None:
        self.settle()
        for name in CLOSING:
            while name in self.open:
                self._toggle(name)

    def _toggle(self, name: str) -> None:
        if name in self.open:
            self.open.remove(name)
            self.emit(unmark_event(name))
        else:
            self.open.append(name)
            self.emit(mark_event(name))

    def _text(self, text: str) -> None:
        if text:
            self.emit(text_event(text))

    def _open(self, name: str) -> None:
        self.open.append(name)
        self.emit(mark_event(name))

    def _run(self, last: bool) -> None:
        """Tokens one after the other; what is used up is cut off once, so that the work is linear in the text."""
        s, at = self.tail, 0
        while at < len(s):
            used = self._raw(s, at) if self.raw else self._token(s, at, last)
            if not used:
                break
            at += used
        self.tail = s[at:]

    def _raw(self, s: str, at: int) -> int:
        end = s.find(self.raw, at)
        if end < 0:
            if self.raw == "``":
                return 0
            self._text(s[at:])
            return len(s) - at
        body = s[at:end]
        if self.raw == "``" and len(body) > 1 and body[0] == body[-1] == " ":
            body = body[1:-1]
        self._text(body)
        self._toggle("math" if self.raw == "$" else "code")
        used, self.raw = end + len(self.raw) - at, ""
        return used

    def _token(self, s: str, at: int, last: bool) -> int:
        """Characters that the token at ``at`` takes; 0 if more must be seen first."""
        c = s[at]
        follows = s[at + 1 : at + 2]
        if c in "*_~=":
            return self._delimiters(s, at, last)
        if c == "\\":
            self._text(follows)
            return 2 if follows else int(last)
        if c == "`":
            if not follows and not last:
                return 0
            if not follows:
                self._text(c)
                return 1
            self.raw = "``" if follows == "`" else "`"
            self._toggle("code")
            return len(self.raw)
        if c == "$":
            self.raw = c
            self._toggle("math")
            return 1
        if c == "^":
            self._toggle("sup")
            return 1
        if c == "<":
            return self._autolink(s, at, last)
        if c == "[" or c == "!" and follows == "[":
            return self._link(s, at, last, c == "!")
        if c == "!":
            if not follows and not last:
                return 0
            self._text(c)
            return 1
        m = PLAIN.match(s, at)
        self._text(m[0])
        return m.end() - at

    def _delimiters(self, s: str, at: int, last: bool) -> int:
        run = RUN.match(s, at)[0]
        n = len(run)
        after = s[at + n : at + n + 1]
        if not after and not last:
            return 0
        names = TOGGLES.get(run)
        escaped = after == "\\" or run[0] != "*" and after and after in "`*"
        if run in ("***", "___"):
            both = [x for x in ("em", "strong") if x in self.open]
            if not after and not both:
                names = None
            elif len(both) == 2:
                names = ["em", "strong"]
            elif run == "___":
                if not escaped:  # opens both, even if one is open
                    self._open("strong")
                    self._open("em")
                    return n
            elif both:
                names = [both[0], "strong" if both[0] == "em" else "em"]  # the open one closes, the other opens
            else:
                names = ["strong", "em"]
        elif not after and names and names[0] not in self.open:
            names = None  # nothing follows that it could open
        if names is None or escaped:
            self._text(run)
        else:
            for name in names:
                self._toggle(name)
        return n

    def _autolink(self, s: str, at: int, last: bool) -> int:
        end = s.find(">", at)
        if end < 0:
            if last:
                self._text(s[at:])
                return len(s) - at
            return 0
        body = s[at + 1 : end]
        if "://" in body or "@" in body:
            self.emit(mark_event("a", attributes={"href": body if "://" in body else f"mailto:{body}"}))
            self._text(body)
            self.emit(unmark_event("a"))
        else:
            self._text(f"<{body}>")
        return end + 1 - at

    def _link(self, s: str, at: int, last: bool, image: bool) -> int:
        begin = at + (2 if image else 1)
        close = s.find("]", begin)
        follows = s[close + 1 : close + 2] if close >= 0 else ""
        end = s.find(")", close + 2) if follows == "(" else -1
        if close >= 0 and follows not in ("(", ""):
            self._text(s[at : close + 1])
            return close + 1 - at
        if end < 0:
            if not last:
                return 0
            self._text(s[at:])
            return len(s) - at
        label, target = s[begin:close], s[close + 2 : end].strip()
        if image:
            self.emit(mark_event("img", attributes={"src": target, "alt": label}))
            self.emit(unmark_event("img"))
            return end + 1 - at
        url, quote, title = target.partition(' "')
        attributes = {"href": url.strip()}
        if quote and title.removesuffix('"').strip():
            attributes["title"] = title.removesuffix('"').strip()
        self.emit(mark_event("a", attributes=attributes))
        self._text(label)
        self.emit(unmark_event("a"))
        return end + 1 - at


def attributes_of(source: str) -> dict[str, str] | None:
    return dict(ATTRIBUTE.findall(source)) or None


class MarkdownKernel:
    """Parses one document. ``feed`` and ``finish`` return the events that have become certain.

    ``tag_names`` are names without a colon that open custom markup too; ``normalize_newlines`` reads CRLF as LF.
    """

    def __init__(self, tag_names: tuple[str, ...] = (), normalize_newlines: bool = False):
        self.tag_names, self.normalize_newlines = tuple(tag_names), normalize_newlines
        self.out: list[Event] = []
        self.inline = Inline(self._emit)
        self.mode = "start"
        self.pending = ""
        self.inside = ""  # the element whose line streams through the inline layer
        self.held: str | None = None
        self.tag = ""
        self.joined = False
        self.seq = 0
        self._open_tag, self._maybe_tag = _tag_patterns(self.tag_names)

    def state(self) -> str:
        keep = {k: getattr(self, k) for k in ("tag_names", "normalize_newlines", "mode", "pending", "inside", "held", "tag", "joined", "seq")}
        return json.dumps({"version": VERSION, "tail": self.inline.tail, "raw": self.inline.raw, "open": self.inline.open} | keep)

    @classmethod
    def restore(cls, state: str) -> MarkdownKernel:
        s = json.loads(state)
        if s.pop("version") != VERSION:
            raise ValueError("the state is of another version")
        k = cls(tuple(s.pop("tag_names")), s.pop("normalize_newlines"))
        k.inline.tail, k.inline.raw, k.inline.open = s.pop("tail"), s.pop("raw"), s.pop("open")
        for name, value in s.items():
            setattr(k, name, value)
        return k

    def feed(self, chunk: str) -> list[Event]:
        self.pending += chunk
        if self.normalize_newlines:
            hold = "\r" if self.pending.endswith("\r") else ""
            self.pending = self.pending.removesuffix("\r").replace("\r\n", "\n") + hold
        self._advance(False)
        return self._taken()

    def finish(self) -> list[Event]:
        self._advance(True)
        self._close()
        return self._taken()

    def parse(self, text: str) -> list[Event]:
        return self.feed(text) + self.finish()

    def _taken(self) -> list[Event]:
        out, self.out = self.out, []
        self.seq += len(out)
        return out

    def _emit(self, e: Event) -> None:
        self.out.append(e)

    def _mark(self, name: str, attributes: dict[str, str] | None = None) -> None:
        self._emit(mark_event(name, False, attributes))

    def _unmark(self, *names: str) -> None:
        for name in names:
            self._emit(unmark_event(name))

    # -- lines ---------------------------------------------------------------------------------------------------

    def _advance(self, eof: bool) -> None:
        """Lines, or what is there of them; what is used up is cut off once, so that the work is linear in the text."""
        s, at = self.pending, 0
        while at < len(s):
            if self.mode == "custom":
                used = self._custom(s, at, eof)
                at += abs(used)
                if used <= 0:
                    break
                continue
            end = s.find("\n", at)
            if self.inside:
                text = s[at : end if end >= 0 else len(s)]
                if text:
                    self.inline.feed(text)
                if end >= 0 or eof:
                    self._line_ends()
                at = end + 1 if end >= 0 else len(s)
                continue
            line = s[at : end if end >= 0 else len(s)]
            used = getattr(self, f"_in_{self.mode}")(line, end >= 0 or eof, end >= 0)
            if used is None:
                break
            at += used
        self.pending = s[at:]
        if eof and self.inside:  # the text ended within a line, before it
            self._line_ends()

    def _stream(self, inside: str, used: int, line: str, split: bool = False) -> int:
        """The rest of the line belongs to ``inside``. ``split``: its first character is an event of its own."""
        self.inside = inside
        if split and used < len(line):
            self.inline.feed(line[used])
            used += 1
        return used

    def _line_ends(self) -> None:
        if self.inside == "quote":
            self.inline.settle()
        else:
            self.inline.flush()
            self._unmark(self.inside)
        self.inside = ""

    def _paragraph(self, line: str, split: bool = False) -> int:
        self._mark("p")
        return self._stream("p", 0, line, split)

    def _in_start(self, line: str, whole: bool, newline: bool) -> int | None:
        """Characters that are used up (more than the line: its newline as well), or None if more must be seen."""
        if not line:
            return 1 if newline else None
        c = line[0]
        if c not in "#`->|$<0123456789":
            return self._paragraph(line, True)
        heading = HEADING.match(line)
        if heading:
            self._mark(f"h{len(heading[1])}")
            return self._stream(f"h{len(heading[1])}", heading.end(), line)
        if line.startswith("> "):
            self._mark("blockquote")
            self._mark("p")
            self.mode = "quote"
            return self._stream("quote", 2, line)
        item = self._item(line, whole)
        if item:
            self.mode = item[0]
            self._mark(item[0])
            return self._begin_item(item, line)
        if newline:
            done = self._whole_line(line)
            if done is not None:
                return done
        tag = self._open_tag.match(line)
        if tag:
            return self._begin_tag(tag)
        if whole or not self._undecided(line):
            return self._paragraph(line)
        return None

    def _undecided(self, line: str) -> bool:
        return bool(
            UNDECIDED.fullmatch(line)
            or line[0] == "|" or self._maybe_tag.match(line)
        )

    def _whole_line(self, line: str) -> int | None:
        fence = FENCE.fullmatch(line)
        if fence:
            self._mark("pre", {"class": f"code lang-{fence[1]}" if fence[1] else "code"})
            self.mode = "code"
        elif BREAK.fullmatch(line):
            self._mark("hr")
            self._unmark("hr")
        elif line == "$$":
            self._mark("math", {"display": "block"})
            self.mode, self.joined = "math", False
        elif line[0] == "|":
            self._mark("table")
            self._mark("thead")
            self.mode = "head"
            self._row(line, "th")
        else:
            return None
        return len(line) + 1

    @staticmethod
    def _item(line: str, whole: bool) -> tuple[str, int, bool | None] | None:
        """(list, characters of the marker, checked) if the line surely begins a list item."""
        number = NUMBER.match(line)
        if number and (len(line) > number.end() or not whole):
            return "ol", number.end(), None
        task = TASK.match(line)
        if task:
            return "ul", task.end(), task[1] == "x"
        if line.startswith("- ") and len(line) > 2 and (whole or not MAYBE_TASK.fullmatch(line)):
            return "ul", 2, None
        return None

    def _begin_item(self, item: tuple[str, int, bool | None], line: str) -> int:
        self._mark("li")
        if item[2] is not None:
            self._mark("input", {"type": "checkbox"} | ({"checked": "true"} if item[2] else {}))
            self._unmark("input")
        return self._stream("li", item[1], line)

    def _list(self, kind: str, line: str, whole: bool, newline: bool) -> int | None:
        if not line:
            return 1 if newline else None
        item = self._item(line, whole)
        if item and item[0] == kind:
            return self._begin_item(item, line)
        if not whole and (MAYBE_BULLET if kind == "ul" else MAYBE_NUMBER).fullmatch(line):
            return None
        self._unmark(kind)
        self.mode = "start"
        return 0

    def _in_ul(self, line: str, whole: bool, newline: bool) -> int | None:
        return self._list("ul", line, whole, newline)

    def _in_ol(self, line: str, whole: bool, newline: bool) -> int | None:
        return self._list("ol", line, whole, newline)

    def _in_quote(self, line: str, whole: bool, newline: bool) -> int | None:
        if not line or line in (">", "> ") and whole:
            return len(line) + 1 if newline or line and whole else None
        if line[0] != ">":
            self.inline.flush()
            self._unmark("p", "blockquote")
            self.mode = "start"
            return 0
        if not whole and line in (">", "> ", "> -"):
            return None
        if line.startswith("> - "):
            self.inline.flush()
            self._unmark("p")
            self._mark("ul")
            self._mark("li")
            self.mode = "quoted"
            return self._stream("li", 4, line)
        self._emit(text_event("\n"))
        return self._stream("quote", 2 if line.startswith("> ") else 1, line)

    def _in_quoted(self, line: str, whole: bool, newline: bool) -> int | None:
        if not line or line in (">", "> ") and whole:
            return len(line) + 1 if newline or line and whole else None
        if line[0] == ">" and not whole and line in (">", "> ", "> -"):
            return None
        if line.startswith("> - "):
            self._mark("li")
            return self._stream("li", 4, line)
        self._unmark("ul")
        if line[0] == ">":
            self._mark("p")
            self.mode = "quote"
            return self._stream("quote", 2 if line.startswith("> ") else 1, line)
        self._unmark("blockquote")
        self.mode = "start"
        return 0

    def _in_code(self, line: str, whole: bool, newline: bool) -> int | None:
        if not whole:
            return None
        if line.rstrip() == "```":
            self._end_code()
        else:
            if self.held is not None:
                self._emit(text_event(self.held + "\n"))
            self.held = line
        return len(line) + 1

    def _end_code(self) -> None:
        if self.held:
            self._emit(text_event(self.held))
        self.held = None
        self._unmark("pre")
        self.mode = "start"

    def _in_math(self, line: str, whole: bool, newline: bool) -> int | None:
        if not whole:
            return None
        if line.strip() == "$$":
            self._unmark("math")
            self.mode = "start"
        elif line:
            self._emit(text_event("\n" + line if self.joined else line))
            self.joined = True
        return len(line) + 1

    def _in_head(self, line: str, whole: bool, newline: bool) -> int | None:
        if line[:1] == "|":
            if not whole:
                return None
            if SEPARATOR.fullmatch(line):
                self._unmark("thead")
                self._mark("tbody")
                self.mode = "body"
            else:
                self._row(line, "th")
            return len(line) + 1
        if not line and not whole:
            return None
        self._unmark("thead", "table")
        self.mode = "start"
        return 0

    def _in_body(self, line: str, whole: bool, newline: bool) -> int | None:
        if line[:1] == "|":
            if not whole:
                return None
            self._row(line, "td")
            return len(line) + 1
        if not line and not whole:
            return None
        self._unmark("tbody", "table")
        self.mode = "start"
        return 0

    def _row(self, line: str, cell: str) -> None:
        self._mark("tr")
        for text in line.strip().removeprefix("|").removesuffix("|").split("|"):
            self._mark(cell)
            if text.strip():
                self.inline.feed(text.strip())
            self.inline.flush()
            self._unmark(cell)
        self._unmark("tr")

    def _begin_tag(self, tag: re.Match) -> int:
        name, source, ends = tag[1], tag[2], bool(tag[3])
        if source.endswith("/"):
            source, ends = source[:-1], True
        self._emit(mark_event(name, True, attributes_of(source)))
        if ends:
            self._emit(unmark_event(name, True))
        else:
            self.mode, self.tag, self.joined = "custom", name, False
        return tag.end()

    def _custom(self, s: str, at: int, eof: bool) -> int:
        """Raw text up to the close tag; the newlines next to the tags are not part of it.

        Characters that are used up; as a negative number (or 0) if the close tag isn't there yet.
        """
        begin = at
        if not self.joined:
            begin += s.startswith("\n", at)
            self.joined = True
        close = f"</{self.tag}>"
        end = s.find(close, begin)
        if end >= 0:
            body = s[begin:end].removesuffix("\n")
            if body:
                self._emit(text_event(body))
            self._emit(unmark_event(self.tag, True))
            self.mode = "start"
            return end + len(close) - at
        hold = 0
        if not eof:
            hold = next((n for x in ("\n" + close, close) for n in range(min(len(x) - 1, len(s) - begin), 0, -1) if s.endswith(x[:n])), 0)
        body = s[begin : len(s) - hold]
        if body:
            self._emit(text_event(body))
        return -(len(s) - hold - at)

    def _close(self) -> None:
        if self.mode == "quote":
            self.inline.flush()
        if self.mode == "code":
            self._end_code()
        ends = {"ul": ["ul"], "ol": ["ol"], "quote": ["p", "blockquote"], "quoted": ["ul", "blockquote"], "math": ["math"], "head": ["thead", "table"], "body": ["tbody", "table"]}
        self._unmark(*ends.get(self.mode, []))
        if self.mode == "custom":
            self._emit(unmark_event(self.tag, True))
        self.mode = "start"
