"""Event operators on Spark."""

from functools import partial

import pytest
from pyspark.sql import functions as F

from semevents.functions.codec import from_json, to_json, to_json_lines
from semevents.model import EventBuilder, coalesce_text, unbalanced, with_depth
from semevents.operators.extract import TagExtractor, extract, extract_with
from semevents.operators.render import render, to_html_compact
from semevents.operators.transform import Body, Transformer, transform
from semevents.plans.queries import html_to_markdown
from semevents.sources.html import from_html, html_events
from semevents.sources.markdown import parse, parse_chunks
from semevents.streaming.chunks import parse_stream
from semevents.testing import assert_same_events, differing


def html(df, column="html"):
    return df.collect()[0][column]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_builder_and_json(spark):
    b = EventBuilder()
    with b.element("p"):
        b.text('a "q" é </')
        with b.tag("x:y", {}):
            pass
    b.mark("z", attributes={"k": "v"})
    lines = [r["json"] for r in to_json(b.frame(spark)).orderBy("seq").collect()]
    assert lines == [
        '{"type":"mark","name":"p"}', '{"type":"text","text":"a \\"q\\" é </"}', '{"type":"mark","name":"x:y","isTag":true,"attributes":{}}',
        '{"type":"unmark","name":"x:y","isTag":true}', '{"type":"unmark","name":"p"}', '{"type":"mark","name":"z","attributes":{"k":"v"}}',
    ]
    again = from_json(to_json(b.frame(spark)))
    assert_same_events(again, b.frame(spark))
    assert differing(again, b.frame(spark)).count() == 0
    assert html(to_json_lines(b.frame(spark)), "jsonl") == "\n".join(lines)
    with pytest.raises(AssertionError):
        assert_same_events(again, None)
    assert EventBuilder(produce_tags=True).mark("a").events[0][2] is True


@pytest.mark.parametrize("bad", ['{"name":"p"}', '{"type":"x","name":"p"}', '{"type":"mark"}', '{"type":"text"}', '{"type":"text","text":"a"', '{"type":"text","text":"a","q":1}', "[]"])
def test_bad_json(spark, bad):
    with pytest.raises(Exception, match="not an event"):
        from_json(spark.createDataFrame([(0, 0, bad)], "doc_id bigint, seq int, json string")).collect()


def test_render(spark):
    b = EventBuilder()
    with b.element("ul", {"class": 'a "b" <c>'}):
        with b.element("li"):
            b.text("x\ny & <z>")
            with b.element("em"):
                b.text("e")
    with b.element("pre"), b.element("code"):
        b.text("a\n  b")
    with b.tag("n:s"):
        b.text("raw <b> & c")
    with b.element("hr"):
        pass
    assert html(render(b.frame(spark))) == (
        '<ul class="a &quot;b&quot; &lt;c&gt;">\n  <li>\n    x\n    y &amp; &lt;z&gt;<em>e</em>\n  </li>\n</ul>\n<pre>\n<code>a\n  b</code>\n</pre>\n'
        "<n:s>\nraw <b> & c\n</n:s>\n<hr></hr>"
    ).replace("<pre>\n<code>", "<pre>\n<code>")
    assert html(to_html_compact(b.frame(spark))).endswith("<n:s>raw &lt;b&gt; &amp; c</n:s><hr></hr>")
    empty = spark.createDataFrame([(7,)], "doc_id bigint")
    assert html(render(EventBuilder().frame(spark), documents=empty)) == ""


def test_parse_paths_agree(spark):
    d = docs(spark, "plain\n\ntwo & <", "# h\n*x* y", None, "a\nb")
    fast, slow = coalesce_text(parse(d)), coalesce_text(parse(d, prose=False))
    assert_same_events(fast, slow)
    assert unbalanced(fast).count() == 0
    chunks = spark.createDataFrame([(0, 1, "*x* y"), (0, 0, "# h\n")], "doc_id bigint, chunk_seq int, chunk string")
    assert_same_events(coalesce_text(parse_chunks(chunks)), coalesce_text(parse(docs(spark, "# h\n*x* y"))))


def test_depth(spark):
    rows = with_depth(parse(docs(spark, "> **a** b"))).orderBy("seq").collect()
    assert [(r["type"], r["depth"]) for r in rows] == [("mark", 0), ("mark", 1), ("mark", 2), ("text", 3), ("unmark", 2), ("text", 2), ("unmark", 1), ("unmark", 0)]


def test_extract(spark):
    e = parse(docs(spark, "x\n<ns:note lang='de' n=\"7\">\n1\n2\n</ns:note>\n<ns:note>later</ns:note>", "none", "<ns:note>", "<ns:note></ns:note>"))
    for found in (extract(e, "ns:note"), extract_with(e, [partial(TagExtractor, "ns:note")])):
        got = {r["doc_id"]: r for r in found.collect()}
        assert (got[0]["succeeded"], got[0]["content"], got[0]["attributes"]) == (True, "1\n2", {"lang": "de", "n": "7"})
        assert (got[1]["succeeded"], got[1]["is_extracting"], got[1]["content"], got[1]["events"]) == (False, False, None, [])
        assert (got[2]["succeeded"], got[3]["content"], got[3]["succeeded"]) == (True, None, True)
    b = EventBuilder().mark("t").text("a")
    r = extract(b.frame(spark), "t").collect()[0]
    assert (r["succeeded"], r["is_extracting"], r["content"]) == (False, True, "a")


def test_own_extractor(spark):
    class Longest(TagExtractor):
        """The longest text, whatever it stands in."""

        def process(self, seq, event):
            if event[0] == "text" and len(event[4]) > len(self.extracted[0][1][4] if self.extracted else ""):
                self.extracted = [(seq, event)]

    e = parse(docs(spark, "a\nlonger\nb", ""))
    assert {r["doc_id"]: r["content"] for r in extract_with(coalesce_text(e), [partial(Longest, "longest"), partial(TagExtractor, "z")]).filter("tag = 'longest'").collect()} == {0: "longer"}


def test_transform(spark):
    page = "<html><body><h1>T</h1><p>a\n  b <b>c<br></b><br>d</p><br><ul><li><a href='u'>x</a></li></ul><a href='v'>n</a></body></html>"
    e = from_html(spark.createDataFrame([(0, page)], "doc_id bigint, html string"), ("doc_id",))
    out = coalesce_text(transform(e, html_to_markdown()))
    assert [r["text"] for r in out.collect()] == ["== T ==\na b _c / _\nd\n\n+ (u) x\nn"]


def test_transform_of_deep_documents(spark):
    b = EventBuilder()
    for _ in range(3000):
        b.mark("d")
    b.text("t")
    for _ in range(3000):
        b.unmark("d")
    t = Transformer().match("d", Body().text("(").children("in").text(")"), mode="in").match("d", Body().text("<").children("in").text(">"))
    out = transform(b.frame(spark), t).orderBy("seq").collect()
    assert "".join(r["text"] for r in out) == "<" + "(" * 2999 + "t" + ")" * 2999 + ">" and [r["seq"] for r in out] == list(range(6001))


def test_transform_elements_and_order(spark):
    b = EventBuilder()
    with b.element("a"), b.element("b"):
        b.text("t")
    t = Transformer().match("a", Body().element("x", {"k": "v"}, Body().text("<").children("m").text(">"))).match("b", Body().text("m:"), mode="m").match("b", Body().text("other"))
    assert html(to_html_compact(transform(b.frame(spark), t))) == '<x k="v">&lt;m:t&gt;</x>'
    assert html(to_html_compact(transform(b.unmark("z").frame(spark), Transformer().match_text(lambda c: F.upper(c))))) == "T"


def test_html():
    names = [(e[0], e[1] or e[4]) for e in html_events("<p>a<p>b &amp; c<br><!-- x --><ul><li>1<li>2</ul></z>")]
    assert names == [
        ("mark", "p"), ("text", "a"), ("unmark", "p"), ("mark", "p"), ("text", "b & c"), ("mark", "br"), ("unmark", "br"), ("unmark", "p"), ("mark", "ul"),
        ("mark", "li"), ("text", "1"), ("unmark", "li"), ("mark", "li"), ("text", "2"), ("unmark", "li"), ("unmark", "ul"),
    ]


def test_html_unfinished_references(spark):
    pages = spark.createDataFrame([(1, "<h1>a &amp;&am</h1><p>b &amp</p><p>c &quo &</p>")], "page_id bigint, html string")
    out = to_html_compact(from_html(pages), ("page_id",)).first()["html"]
    assert out == "<h1>a &amp;&amp;am</h1><p>b &amp;</p><p>c &amp;quo &amp;</p>"
    assert [e[4] for e in html_events("<h1>a &am</h1><p>b &amp</p>") if e[0] == "text"] == ["a &am", "b &"]


def test_stream_is_batch(spark, tmp_path):
    schema = "doc_id bigint, chunk_seq int, chunk string, eof boolean"
    rows = [(0, 1, "lo\n- *a", False), (0, 0, "# Hel", False), (1, 0, "x", True), (0, 0, "dup", False), (0, 2, "* b", False), (0, 3, "", True), (1, 0, "again", True), (1, 5, "late", False)]
    for i, part in enumerate((rows[:1], rows[1:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert i < 3
    events = parse_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = coalesce_text(spark.read.parquet(str(tmp_path / "out")))
    assert_same_events(got, coalesce_text(parse(docs(spark, "# Hello\n- *a* b", "x"))))
