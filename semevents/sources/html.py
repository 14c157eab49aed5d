"""HTML pages to events: tags, attributes in order, decoded text."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame

from ..model import Event, mark_event, text_event, unmark_event
from .markdown import parsed_by

# Elements without content, and the open elements that a start tag ends.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    **dict.fromkeys("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(), {"p"}),
}
HOLDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[Event] = []
        self.stack: list[str] = []

    def _end_implied(self, tag: str) -> None:
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth] in HOLDS.get(tag, {"button", "td", "th", "body", "html"}):
                return
            if self.stack[depth] in ENDS.get(tag, ()):
                while len(self.stack) > depth:
                    self.events.append(unmark_event(self.stack.pop(), True))
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._end_implied(tag)
        values: dict[str, str] = {}
        for k, v in attrs:
            values.setdefault(k, v or "")
        self.events.append(mark_event(tag, True, values or None))
        if tag in VOID:
            self.events.append(unmark_event(tag, True))
        else:
            self.stack.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while True:
                top = self.stack.pop()
                self.events.append(unmark_event(top, True))
                if top == tag:
                    return

    def handle_data(self, data: str) -> None:
        if data:
            self.events.append(text_event(data))


def html_events(html: str) -> list[Event]:
    """Balanced events of a page: void elements close at once, implied ends are added, comments are left out.

    What browsers do beyond that to mend pages (moving formatting elements or misplaced table content) is not done.
    """
    reader = _Reader()
    reader.feed(html)
    reader.close()
    while reader.stack:
        reader.events.append(unmark_event(reader.stack.pop(), True))
    return reader.events


def from_html(pages: DataFrame, keys: tuple[str, ...] = ("page_id",), html_col: str = "html") -> DataFrame:
    """Events of HTML pages; ``is_tag`` is true. Null pages have none."""
    return parsed_by(pages, keys, html_col, html_events)
