"""The Markdown kernel by itself: constructs, repairs, streaming."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from semevents.sources.kernel import MarkdownKernel


def show(events):
    out = []
    for kind, name, _, attributes, text in events:
        if kind == "text":
            out.append(text)
        elif kind == "mark":
            out.append(f"<{name}{''.join(f' {k}={v}' for k, v in (attributes or {}).items())}>")
        else:
            out.append(f"</{name}>")
    return "".join(out)


CASES = [
    ("# A\n\ntext", "<h1>A</h1><p>text</p>"),
    ("###### F\n####### G", "<h6>F</h6><p>####### G</p>"),
    ("#x\n##", "<p>#x</p><p>##</p>"),
    ("a\nb\n \n", "<p>a</p><p>b</p><p> </p>"),
    ("- a\n- b\n\n- c\nd", "<ul><li>a</li><li>b</li><li>c</li></ul><p>d</p>"),
    ("1. a\n22. b\n- c", "<ol><li>a</li><li>b</li></ol><ul><li>c</li></ul>"),
    ("- a\n  - b", "<ul><li>a</li></ul><p>  - b</p>"),
    ("- [x] a\n- [ ] b", "<ul><li><input type=checkbox checked=true></input>a</li><li><input type=checkbox></input>b</li></ul>"),
    ("- [ ] a\n- b\n- [x] c", "<ul><li><input type=checkbox></input>a</li><li>b</li><li><input type=checkbox checked=true></input>c</li></ul>"),
    ("- [t](u)", "<ul><li><a href=u>t</a></li></ul>"),
    ("> a\n> b\nc", "<blockquote><p>a\nb</p></blockquote><p>c</p>"),
    ("> a\n> - b\n> - c\n> d", "<blockquote><p>a</p><ul><li>b</li><li>c</li></ul><p>d</p></blockquote>"),
    ("> a\n>b", "<blockquote><p>a\nb</p></blockquote>"),
    ("> **a**\n> b", "<blockquote><p><strong>a</strong>\nb</p></blockquote>"),
    ("```\na\n\nb\n```\nc", "<pre class=code>a\n\nb</pre><p>c</p>"),
    ("```py\n*a*", "<pre class=code lang-py>*a*</pre>"),
    ("---\n--\n---", "<hr></hr><p>--</p><p>---</p>"),
    ("$$\na\nb\n$$\nc", "<math display=block>a\nb</math><p>c</p>"),
    ("$$\na\n$$", "<math display=block>a</math>"),
    ("| a | b |\n|--|:-:|\n| 1 | *2* |\nx", "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td><em>2</em></td></tr></tbody></table><p>x</p>"),
    ("| a |\n| b |", "<table><thead><tr><th>a</th></tr><tr><th>b</th></tr></thead></table>"),
    ("| a |", "<p>| a |</p>"),
    ('<a:b x="1" data-y=\'2\'>\nz <i> *\n</a:b>\nt', "<a:b x=1 data-y=2>z <i> *</a:b><p>t</p>"),
    ("<a:b/>x", "<a:b></a:b><p>x</p>"),
    ("<a:b>1 << 2</a:b>", "<a:b>1 << 2</a:b>"),
    ("<a:b>\nopen\n", "<a:b>open\n</a:b>"),
    ("<https://x> y", "<p><a href=https://x>https://x</a> y</p>"),
    ("<div> <m@x.y>", "<p><div> <a href=mailto:m@x.y>m@x.y</a></p>"),
    ("**b *i* b** c", "<p><strong>b <em>i</em> b</strong> c</p>"),
    ("***x*** y", "<p><strong><em>x</em></strong> y</p>"),
    ("*a ***b** c", "<p><em>a </em><strong>b</strong> c</p>"),
    ("snake_case_x", "<p>snake<em>case</em>x</p>"),
    ("* item x", "<p><em> item x</em></p>"),
    ("**a**\nb", "<p><strong>a</strong></p><p>b</p>"),
    ("**", "<p>**</p>"),
    ("**a\nb", "<p><strong>a</strong></p><p>b</p>"),
    ("**** ____ ~~~ ===", "<p>**** ____ ~~~ ===</p>"),
    ("~~d~~ H~2~O ==m== a=b x^2^", "<p><del>d</del> H<sub>2</sub>O <mark>m</mark> a=b x<sup>2</sup></p>"),
    ("`a*` ``b ` c`` `` d `` x", "<p><code>a*</code> <code>b ` c</code> <code>d</code> x</p>"),
    ("`a\nb`", "<p><code>a</code></p><p>b`</p>"),
    ("$x_1$ y", "<p><math>x_1</math> y</p>"),
    ('[t](u "T") ![a](s)', "<p><a href=u title=T>t</a> <img src=s alt=a></img></p>"),
    ("[un\nnext [a] b", "<p>[un</p><p>next [a] b</p>"),
    (r"\*a\* C:\p", "<p>*a* C:p</p>"),
    ("2024\n1. a\n2024", "<p>2024</p><ol><li>a</li></ol><p>2024</p>"),
    ("- a\n- \n-", "<ul><li>a</li></ul><p>- </p><p>-</p>"),
    ("", ""),
]


@pytest.mark.parametrize("source, expected", CASES)
def test_constructs(source, expected):
    assert show(MarkdownKernel().parse(source)) == expected


@pytest.mark.parametrize("source, expected", CASES)
def test_chunks_do_not_matter(source, expected):
    rng = random.Random(len(source))
    for _ in range(5):
        kernel, events, at = MarkdownKernel(), [], 0
        while at < len(source):
            n = rng.randint(1, 4)
            events += kernel.feed(source[at : at + n])
            kernel, at = MarkdownKernel.restore(kernel.state()), at + n
        assert show(events + kernel.finish()) == expected


def balanced(events):
    stack = []
    for kind, name, *_ in events:
        if kind == "mark":
            stack.append(name)
        elif kind == "unmark":
            assert name in stack
            stack.remove(name)
    return not stack


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab *_`~^=$![]()<>:/#->|1.\\\n x"))
def test_any_text_is_balanced_in_any_chunks(source):
    whole = MarkdownKernel().parse(source)
    assert balanced(whole)
    kernel = MarkdownKernel()
    pieces = [e for c in source for e in kernel.feed(c)] + kernel.finish()
    assert show(pieces) == show(whole)


def test_events_come_as_soon_as_they_are_certain():
    kernel = MarkdownKernel()
    got = [show(kernel.feed(c)) for c in ["#", " ", "H", "i", "\n", "T"]]
    assert got == ["", "<h1>", "H", "i", "</h1>", "<p>T"]
    kernel = MarkdownKernel()
    got = [show(kernel.feed(c)) for c in ["a ", "*", "b", "*", " c", "[", "t](", "u", ")"]]
    assert got == ["<p>a ", "", "<em>b", "", "</em> c", "", "", "", "<a href=u>t</a>"]


def test_options():
    assert show(MarkdownKernel(tag_names=("thinking",)).parse("<thinking>\nx\n</thinking>")) == "<thinking>x</thinking>"
    assert show(MarkdownKernel(normalize_newlines=True).parse("a\r\n\r\nb")) == "<p>a</p><p>b</p>"


@pytest.mark.parametrize("part", ["- item *x* y\n", "word *x* [l](u) `c` ", "<a:b>\nxx\n</a:b>\n", "> q\n", "| a | b |\n"])
def test_work_is_linear_in_the_text(part):
    """Characters that are cut off what is still to be read, counted: the same for each character of a longer text."""

    class Counted(str):
        copied = 0

        def __getitem__(self, at):
            out = str.__getitem__(self, at)
            Counted.copied += len(out)
            return Counted(out) if isinstance(at, slice) else out

        def __add__(self, other):
            return Counted(str.__add__(self, other))

        def __radd__(self, other):
            return Counted(str.__add__(other, self))

    def copied(n):
        Counted.copied = 0
        MarkdownKernel().parse(Counted(part * n))
        return Counted.copied / n

    assert copied(2000) < 1.5 * copied(200) + 10
