"""Queries over the test tables, and SQL that computes the same from the tables themselves."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codec import from_json, json_errors, to_json, to_json_lines
from ..model import EventBuilder, coalesce_text, events_frame, with_depth
from ..operators.extract import TagExtractor, extract, extract_with
from ..operators.render import fragments, render, to_html_compact
from ..operators.transform import Body, Transformer, transform
from ..scratch import scratch_path
from ..sources.html import from_html
from ..sources.markdown import parse
from ..streaming.chunks import parse_stream
from ..testing import differing

_CONTROL = r"([\\`*_~^=$!\[<#>|0-9-])"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc(df: DataFrame, key: str, text) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), text.alias("text"))


def _inside(events: DataFrame, name: str) -> DataFrame:
    """The text events that stand directly in an element of that name (normal form)."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    return coalesce_text(events).withColumn("parent", F.lag("name").over(w)).withColumn("opened", F.lag("type").over(w) == "mark").filter(
        (F.col("type") == "text") & F.col("opened") & (F.col("parent") == name)
    )


def prose_events(spark, sf_dir):
    """Plain paragraphs of documents by Catalyst, others by the kernel: events by document and type."""
    docs = _table(spark, sf_dir, "documents")
    events = parse(docs.withColumn("text", F.regexp_replace("text", _CONTROL, " ")))
    return events.groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def escaped_render(spark, sf_dir):
    """Every document with its control characters escaped: kernel and renderer must give the lines back."""
    docs = _table(spark, sf_dir, "documents")
    return render(parse(docs.withColumn("text", F.regexp_replace("text", _CONTROL, r"\\$1"))), documents=docs)


def md_headings(spark, sf_dir):
    r, n = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    docs = _doc(
        r.join(n, F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_regionkey", "r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), "\n## ").alias("x")),
        "r_regionkey", F.replace(F.concat(F.lit("# "), "r_name", F.lit("\n## "), "x", F.lit("\n")), F.lit("_"), F.lit("\\_")),
    )
    marks = parse(docs).filter("type = 'mark'")
    return marks.groupBy("doc_id", "name").agg(F.count("*").alias("n"))


def md_tables(spark, sf_dir):
    docs = _doc(_table(spark, sf_dir, "supplier"), "s_suppkey", F.concat(F.lit("| key | name |\n|---|:-:|\n| "), "s_suppkey", F.lit(" | "), "s_name", F.lit(" |\n")))
    cells = _inside(parse(docs), "td")
    return cells.select("doc_id", F.col("text").alias("cell"))


def md_tasks(spark, sf_dir):
    done = F.col("o_orderstatus") == "F"
    docs = _doc(_table(spark, sf_dir, "orders"), "o_orderkey", F.concat(F.when(done, "- [x] ").otherwise("- [ ] "), "o_orderpriority", F.lit("\n1. "), "o_orderkey"))
    boxes = parse(docs).filter("type = 'mark' AND name IN ('input', 'li', 'ol', 'ul')")
    return boxes.groupBy("name", F.coalesce(F.col("attributes")["checked"], F.lit("")).alias("checked")).agg(F.count("*").alias("n"))


def md_code_blocks(spark, sf_dir):
    docs = _doc(_table(spark, sf_dir, "events"), "event_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```\n")))
    return _inside(parse(docs), "pre").select("doc_id", F.col("text").alias("props"))


def md_spans(spark, sf_dir):
    docs = _doc(_table(spark, sf_dir, "customer"), "c_custkey", F.concat(F.lit("**"), "c_name", F.lit("** in ~~"), "c_mktsegment", F.lit("~~ ==x== `"), "c_nationkey", F.lit("`")))
    events = coalesce_text(parse(docs))
    w = Window.partitionBy("doc_id").orderBy("seq")
    inner = events.withColumn("inner", F.lead("text").over(w)).filter("type = 'mark' AND name <> 'p'")
    return inner.select("doc_id", "name", F.col("inner").alias("text"))


def md_links(spark, sf_dir):
    docs = _doc(_table(spark, sf_dir, "part"), "p_partkey", F.concat(F.lit("See ["), "p_name", F.lit("](https://x/"), "p_partkey", F.lit(' "'), "p_brand", F.lit('").')))
    links = parse(docs).filter("type = 'mark' AND name = 'a'")
    return links.select("doc_id", F.col("attributes")["href"].alias("href"), F.col("attributes")["title"].alias("title"))


def md_quotes(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations")
    key = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    docs = c.withColumn("k", key).select((F.col("conv_id") * 1000 + F.col("turn") * 10 + F.col("k")).alias("doc_id"), F.concat(F.lit("> "), F.regexp_replace(F.regexp_replace("text", _CONTROL, r"\\$1"), "\n", "\n> ")).alias("text"))
    out = extract(parse(docs), "blockquote")
    return out.select("doc_id", "succeeded", F.length("content").cast("long").alias("n_chars"), F.md5(F.col("content")).alias("content_md5"))


def md_math(spark, sf_dir):
    docs = _doc(_table(spark, sf_dir, "orders"), "o_orderkey", F.concat(F.lit("$$\n"), "o_custkey", F.lit("\n+ "), "o_orderpriority", F.lit("\n$$\n")))
    return _inside(parse(docs), "math").select("doc_id", "text")


def md_scripts(spark, sf_dir):
    """Sub- and superscript, strong emphasis and emphasis: what stands directly in each."""
    docs = _doc(_table(spark, sf_dir, "part"), "p_partkey", F.concat(F.lit("H~"), "p_size", F.lit("~O x^"), "p_size", F.lit("^ ***"), "p_name", F.lit("*** and *"), "p_brand", F.lit("* end")))
    events = coalesce_text(parse(docs))
    inner = events.withColumn("inner", F.lead("text").over(Window.partitionBy("doc_id").orderBy("seq")))
    return inner.filter("type = 'mark' AND name <> 'p'").select("doc_id", "name", F.col("inner").alias("text"))


def md_images(spark, sf_dir):
    """Images, autolinks and mail addresses."""
    k = F.col("s_suppkey")
    docs = _doc(_table(spark, sf_dir, "supplier"), "s_suppkey", F.concat(F.lit("!["), "s_name", F.lit("](https://i/"), k, F.lit(".png) <https://x/"), k, F.lit("> <u"), k, F.lit("@x.org> <no link>")))
    marks = parse(docs).filter("type = 'mark' AND name <> 'p'")
    return marks.select("doc_id", "name", F.coalesce(F.col("attributes")["href"], F.col("attributes")["src"]).alias("target"), F.col("attributes")["alt"].alias("alt"))


def md_breaks(spark, sf_dir):
    """Thematic breaks, blank lines, and a heading with too many marks."""
    docs = _doc(_table(spark, sf_dir, "customer"), "c_custkey", F.concat(F.lit("---\n\n"), "c_mktsegment", F.lit("\n\n-----\n####### "), "c_nationkey", F.lit("\n")))
    return parse(docs).filter("type <> 'text'").groupBy("doc_id", "type", "name").agg(F.count("*").alias("n"))


def md_quote_lists(spark, sf_dir):
    """A list in a quote: its items and the paragraph before it."""
    docs = _doc(_table(spark, sf_dir, "customer"), "c_custkey", F.concat(F.lit("> "), "c_name", F.lit("\n> - "), "c_mktsegment", F.lit("\n> - "), "c_nationkey", F.lit("\n")))
    events = parse(docs)
    return _inside(events, "li").unionByName(_inside(events, "p")).select("doc_id", F.col("parent").alias("name"), "text")


def markup_render(spark, sf_dir):
    """Namespaced markup between paragraphs: its content is neither escaped nor indented, the rest is."""
    docs = _doc(_table(spark, sf_dir, "events"), "event_id", F.concat(F.lit("a & b\n<doc:props kind=\"x&y\">\n"), "props", F.lit("\n</doc:props>\n")))
    return render(parse(docs))


def extract_absent(spark, sf_dir):
    """Only some documents hold the tag; of two in a document the first counts."""
    o, p = _table(spark, sf_dir, "orders"), F.col("o_orderpriority")
    tag = F.concat(F.lit("<doc:o>\n"), p, F.lit("\n</doc:o>\n"))
    docs = _doc(o, "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.concat(tag, F.lit("<doc:o>\nlater\n</doc:o>\n"))).otherwise(p))
    return extract(parse(docs), "doc:o").select("doc_id", "succeeded", "is_extracting", "content")


def json_scan(spark, sf_dir):
    """Events read from JSON texts: an element with an attribute around a text."""
    n = _table(spark, sf_dir, "nation").withColumn("e", F.array(
        F.concat(F.lit('{"type":"mark","name":"x:n","isTag":true,"attributes":{"r":"'), "n_regionkey", F.lit('"}}')),
        F.concat(F.lit('{"type":"text","text":"'), "n_name", F.lit('"}')), F.lit('{"type":"unmark","name":"x:n","isTag":true}'),
    ))
    events = from_json(n.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.posexplode("e").alias("seq", "json")))
    return events.select("doc_id", "seq", "type", "name", F.coalesce("is_tag", F.lit(False)).alias("is_tag"), F.col("attributes")["r"].alias("r"), "text")


def extract_tag(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    docs = _doc(o, "o_orderkey", F.concat(F.lit("Before\n<doc:order status=\""), "o_orderstatus", F.lit("\">\n"), "o_orderpriority", F.lit("\n</doc:order>\nAfter")))
    out = extract(parse(docs), "doc:order")
    return out.select("doc_id", "succeeded", "is_extracting", F.col("attributes")["status"].alias("status"), "content")


def json_roundtrip(spark, sf_dir):
    events = parse(_doc(_table(spark, sf_dir, "nation"), "n_nationkey", F.concat(F.lit("# "), F.replace("n_name", F.lit("_"), F.lit("\\_")), F.lit("\n- [x] a\n"))))
    return to_json(from_json(to_json(coalesce_text(events))))


def builder_events(spark, sf_dir):
    """Events written by hand: default tags, elements, empty and no attributes."""
    plain, tags = EventBuilder(), EventBuilder(produce_tags=True)
    with plain.element("p", {"class": "x"}):
        plain.text("a").mark("br").unmark("br")
        with plain.tag("n:t"):
            plain.text("b")
    with tags.element("q", {}):
        tags.text("c")
    return to_json(events_frame(spark, {0: plain.events, 1: tags.events}))


def event_diff(spark, sf_dir):
    """Events that differ between two versions of a text, with the side that has them."""
    c = _table(spark, sf_dir, "customer")
    old = _doc(c, "c_custkey", F.col("c_name"))
    new = _doc(c, "c_custkey", F.concat("c_name", F.when(F.col("c_mktsegment") == "BUILDING", " x").otherwise("")))
    return differing(coalesce_text(parse(new)), coalesce_text(parse(old)))


def html_scan(spark, sf_dir):
    """An element tree from HTML: names in lower case, decoded attributes and text, no comments, void elements, implied ends."""
    html = F.concat(F.lit('<DIV Data-K="x&amp;y"><!-- c --><p>'), "p_name", F.lit("<br>&lt;"), "p_brand", F.lit("</div>"))
    pages = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), html.alias("html"))
    return to_json(coalesce_text(from_html(pages, ("doc_id",))))


def transform_elements(spark, sf_dir):
    """Rules by predicate and by name, modes, elements around children, a text rule; marks without a rule go."""
    docs = _doc(_table(spark, sf_dir, "nation"), "n_nationkey", F.concat(F.lit("# "), F.replace("n_name", F.lit("_"), F.lit("\\_")), F.lit("\n**"), "n_regionkey", F.lit("** X\n")))
    rules = (
        Transformer()
        .match(F.col("name").rlike("^h[1-6]$"), Body().element("x:h", {"k": "v"}, Body().text("<").children("m").text(">")))
        .match("strong", Body().element("b", body=Body().children()), mode="m")
        .match("strong", Body().element("i", body=Body().children()))
        .match_text(F.lower)
    )
    return to_html_compact(transform(parse(docs), rules))


def render_blocks(spark, sf_dir):
    """Pretty HTML of a list, code and a break: indentation, none in code, explicit ends, one newline dropped."""
    docs = _doc(_table(spark, sf_dir, "supplier"), "s_suppkey", F.concat(F.lit("- **"), "s_name", F.lit("** & x\n\n```sql\na < "), "s_suppkey", F.lit("\n  c\n```\n---\n")))
    return render(parse(docs))


def json_lines(spark, sf_dir):
    return to_json_lines(coalesce_text(parse(_doc(_table(spark, sf_dir, "region"), "r_regionkey", F.concat(F.lit("**"), "r_name", F.lit("** x"))))))


def html_to_markdown() -> Transformer:
    """Titles, items, links, bold text and paragraphs of a page as lines of text."""
    target = F.concat(F.lit("("), F.coalesce(F.col("attributes")["href"], F.lit("")), F.lit(") "))
    return (
        Transformer()
        .match("h1", Body().text("== ").children("title").text(" ==\n"))
        .match("li", Body().text("+ ").children("item").text("\n"))
        .match("a", Body().text(target).children(), mode="item")
        .match("b", Body().text("_").children("bold").text("_"))
        .match("br", Body().text(" / "), mode="bold")
        .match("br", Body().text("\n"))
        .match("p", Body().children("body").text("\n"))
        .match_text(lambda t: F.regexp_replace(t, r"\s+", " "))
    )


def _written(events: DataFrame, key: str) -> DataFrame:
    """The texts of each document, joined."""
    return events.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("markdown"))


def transform_to_markdown(spark, sf_dir):
    html = F.concat(F.lit("<h1>"), "n_name", F.lit("</h1><ul><li><a href=x>"), "n_regionkey", F.lit("</a></ul><a href=y>z</a><b>1<br>2</b><br><p>a\n b"))
    pages = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), html.alias("html"))
    return _written(transform(from_html(pages, ("doc_id",)), html_to_markdown()), "doc_id")


def md_documents(spark, sf_dir):
    """The documents as they are: paragraphs and formulas."""
    marks = parse(_table(spark, sf_dir, "documents")).filter("type = 'mark' AND name IN ('p', 'math')")
    return marks.groupBy("doc_id", "name").agg(F.count("*").alias("n"))


# Markdown with K in place of a number, and the compact HTML of its events.
CASES = [
    ("a ``K ` x`` b", "<p>a <code>K ` x</code> b</p>"),
    ("`` `K` `` z", "<p><code>`K`</code> z</p>"),
    ("v $K*2*$ y", "<p>v <math>K*2*</math> y</p>"),
    ("__K__ and _e_ z", "<p><strong>K</strong> and <em>e</em> z</p>"),
    ("*a ***K** b", "<p><em>a </em><strong>K</strong> b</p>"),
    ("x ___K___ y", "<p>x <strong><em>K</em></strong> y</p>"),
    ("_a ___K___ b", "<p><em>a <strong><em>K</em></strong> b</em></p>"),
    ("a **** K ~~~ === ____ z", "<p>a **** K ~~~ === ____ z</p>"),
    ("`**K**` and $*K*$ [*K*](u) z", "<p><code>**K**</code> and <math>*K*</math> <a href=\"u\">*K*</a> z</p>"),
    ("![*K*](u) <http://h/*K*> z", "<p><img src=\"u\" alt=\"*K*\"></img> <a href=\"http://h/*K*\">http://h/*K*</a> z</p>"),
    ("[K](u \"t\") z [K", "<p><a href=\"u\" title=\"t\">K</a> z [K</p>"),
    ("> a ``K`` b\n> c", "<blockquote><p>a <code>K</code> b\nc</p></blockquote>"),
    ("```\nK", "<pre class=\"code\">K</pre>"),
    ("| K |\n|---|\n| *K* |", "<table><thead><tr><th>K</th></tr></thead><tbody><tr><td><em>K</em></td></tr></tbody></table>"),
    ("| K |\n", "<table><thead><tr><th>K</th></tr></thead></table>"),
    ("<x:y k=\"K\" l='2'>\nK *", "<x:y k=\"K\" l=\"2\">K *</x:y>"),
    ("$$\nK", "<math display=\"block\">K</math>"),
    ("**K", "<p><strong>K</strong></p>"),
    ("- K\n- L", "<ul><li>K</li><li>L</li></ul>"),
    ("  - K", "<p>  - K</p>"),
    ("- K\n  - L", "<ul><li>K</li></ul><p>  - L</p>"),
    ("~K~ ^K^ ~~K~~ ==K== z", "<p><sub>K</sub> <sup>K</sup> <del>K</del> <mark>K</mark> z</p>"),
    ("1. [x] K\n2. L", "<ol><li>[x] K</li><li>L</li></ol>"),
]


def _cases(spark, sf_dir) -> DataFrame:
    cases = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "c int, t string")
    docs = _table(spark, sf_dir, "nation").join(F.broadcast(cases))  # a few fixed cases for each row
    return docs.select((F.col("n_nationkey") * 1000 + F.col("c")).cast("long").alias("doc_id"), F.replace("t", F.lit("K"), F.col("n_nationkey").cast("string")).alias("text"))


def md_cases(spark, sf_dir):
    """Spans in spans, literal runs, precedence, open ends, lists that aren't nested."""
    return to_html_compact(parse(_cases(spark, sf_dir)))


def _tagged(spark, sf_dir) -> DataFrame:
    html = F.concat(F.lit('<a><b>'), "n_name", F.lit('</b><b>z</b></a>'))
    return from_html(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), html.alias("html")), ("doc_id",))


def _rules() -> Transformer:
    return Transformer().match("a", Body().text("A")).match("b", Body().element("i", body=Body().children()), mode="m").match("b", Body().element("u", body=Body().children())).match("b", Body().text("never"))


def transform_cases(spark, sf_dir):
    """The first rule that fits, a rule without children(), more unmarks than marks, output that is not from tags."""
    events = _tagged(spark, sf_dir)
    more = events.groupBy("doc_id").agg(F.max("seq").alias("m")).select(
        "doc_id", (F.col("m") + 1).cast("int").alias("seq"), F.lit("unmark").alias("type"), F.lit("z").alias("name"), F.lit(True).alias("is_tag"), F.lit(None).cast("map<string,string>").alias("attributes"), F.lit(None).cast("string").alias("text")
    )
    return to_json(transform(events.unionByName(more), _rules()))


def _nested(spark, sf_dir) -> DataFrame:
    """A tag in itself, left open in every third document."""
    html = F.concat(F.lit('<t k="1"><b>x</b>'), "n_name", F.lit('<t k="2">y</t>z</t><s>'), "n_regionkey", F.lit("</s>"))
    events = from_html(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), html.alias("html")), ("doc_id",))
    return events.filter("doc_id % 3 <> 0 OR seq < 6")


def _extraction(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "tag", "succeeded", "is_extracting", F.col("attributes")["k"].alias("k"), "content", F.size("events").alias("n"))


def extract_nested(spark, sf_dir):
    """Marks of the same name in a tag, other marks, tags left open; the events themselves stay as they were."""
    events = _nested(spark, sf_dir)
    n = events.groupBy("doc_id").agg(F.count("*").alias("all"))
    return _extraction(extract(events, "t")).join(n, "doc_id")


def extract_several(spark, sf_dir):
    """Several extractors in one pass."""
    return _extraction(extract_with(_nested(spark, sf_dir), [partial(TagExtractor, "t"), partial(TagExtractor, "s")]))


def render_lines(spark, sf_dir):
    """Lines of a text that stand in blocks are indented, empty ones aren't."""
    html = F.concat(F.lit("<div><p>a\n"), "n_name", F.lit("\n\nb</p></div><pre>c\n"), "n_regionkey", F.lit("</pre>"))
    pages = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), html.alias("html"))
    return render(from_html(pages, ("doc_id",)))


BAD_JSON = ['{"name":"K"}', '{"type":"x","name":"K"}', '{"type":"mark"}', '{"type":"text"}', '{"type":"text","text":"K"', '{"type":"text","text":"K","q":1}', "[K]", '{"type":"text","text":"K"}', '{"type":"unmark","name":"K","attributes":{}}']


def json_scan_errors(spark, sf_dir):
    """Lines that are no events, and why; one of them is."""
    lines = F.array(*[F.replace(F.lit(x), F.lit("K"), F.col("n_nationkey").cast("string")) for x in BAD_JSON])
    return json_errors(_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.posexplode(lines).alias("seq", "json")))


def _run_stream(spark, out: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream writes until its source is read, with the number of the micro-batch."""
    root = scratch_path(spark, "stream")
    write = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{root}/out")
    out.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema.add("batch", "long")).parquet(f"{root}/out")


def _event_stream(spark, events: DataFrame) -> DataFrame:
    """Events as a stream: written in three parts by place in the document, a micro-batch each."""
    path = scratch_path(spark, "stream")
    for part in range(3):
        events.filter((F.col("seq") >= 3 * part) & ((F.col("seq") < 3 * part + 3) if part < 2 else F.lit(True))).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


def stream_transform(spark, sf_dir):
    """The transform of events that come in several micro-batches."""
    return to_html_compact(_run_stream(spark, transform(_event_stream(spark, _tagged(spark, sf_dir)), _rules())))


def stream_extract(spark, sf_dir):
    """Extractors over events that come in several micro-batches: the last state of each document."""
    found = _run_stream(spark, extract_with(_event_stream(spark, _nested(spark, sf_dir)), [partial(TagExtractor, "t")]), "update")
    last = found.withColumn("last", F.max("batch").over(Window.partitionBy("doc_id"))).filter("batch = last")
    return _extraction(last)


def stream_render(spark, sf_dir):
    """HTML from fragments that are written as their events come."""
    docs = _doc(_table(spark, sf_dir, "supplier"), "s_suppkey", F.concat(F.lit("- **"), "s_name", F.lit("** & x\n\n```sql\na < "), "s_suppkey", F.lit("\n  c\n```\n---\n")))
    frags = _run_stream(spark, fragments(_event_stream(spark, parse(docs, prose=False))))
    return frags.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frag"))), lambda x: x["frag"]), "").alias("html"))


def stream_early(spark, sf_dir):
    """Chunks of documents that never end, empty ones between them: what is certain is there all the same."""
    schema = _table(spark, sf_dir, "nation").schema
    n = spark.readStream.schema(schema).parquet(f"{sf_dir}/nation.parque[t]")
    parts = F.array(F.lit("# He"), F.lit(""), F.concat("n_nationkey", F.lit("\n")), F.lit(""), F.lit("a *"), F.lit("b"))
    chunks = n.select(F.col("n_nationkey").cast("long").alias("doc_id"), F.posexplode(parts).alias("chunk_seq", "chunk"), F.lit(False).alias("eof"))
    out = _run_stream(spark, parse_stream(chunks)).groupBy("doc_id")
    return out.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.concat_ws(" ", "type", "name", "text").alias("e")))), lambda x: x["e"]), "|").alias("events"))


def depth_stats(spark, sf_dir):
    docs = _doc(_table(spark, sf_dir, "part"), "p_partkey", F.concat(F.lit("> a\n> - **"), "p_name", F.lit("**\n| a |\n|---|\n| *b* |\n")))
    deep = with_depth(parse(docs))
    return deep.groupBy("doc_id").agg(F.max("depth").alias("deepest"), F.sum((F.col("type") == "mark").cast("long")).alias("marks"))


def html_links(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages")
    marks = from_html(pages).filter("type = 'mark' AND name IN ('a', 'li', 'p')")
    return marks.groupBy("page_id", "name").agg(F.count("*").alias("n"))


def html_compact(spark, sf_dir):
    return to_html_compact(from_html(_table(spark, sf_dir, "pages")), ("page_id",))


def html_markdown(spark, sf_dir):
    out = _written(transform(from_html(_table(spark, sf_dir, "pages")), html_to_markdown(), ("page_id",)), "page_id")
    return out.select("page_id", F.md5("markdown").alias("md5"), F.length("markdown").cast("long").alias("n_chars"))


def marks_join_labels(spark, sf_dir):
    events = parse(_table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", _CONTROL, " "))).filter("type = 'mark'")
    n = events.groupBy("doc_id").agg(F.count("*").alias("n"))
    return n.join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.sum("n").alias("paragraphs"), F.count("*").alias("docs"))


def stream_events(spark, sf_dir):
    """Conversations as a stream of chunks (a turn each), through the stateful parser, to events by conversation."""
    schema = _table(spark, sf_dir, "conversations").schema
    last = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    turns = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parque[t]")
    chunks = turns.join(last, "conv_id").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_seq"),
        F.concat(F.regexp_replace("text", _CONTROL, " "), F.lit("\n")).alias("chunk"), (F.col("turn") == F.col("last")).alias("eof"),
    )
    root = scratch_path(spark, "stream")
    parse_stream(chunks).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/out").filter("type <> 'text'")
    return out.groupBy("doc_id", "type", "name").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    prose_events, escaped_render, md_headings, md_tables, md_tasks, md_code_blocks, md_spans, md_links, md_quotes, md_math, extract_tag, json_roundtrip,
    md_documents, md_cases, transform_cases, extract_nested, extract_several, render_lines, json_scan_errors, stream_transform, stream_extract, stream_render, stream_early,
    md_scripts, md_images, md_breaks, md_quote_lists, markup_render, extract_absent, json_scan, builder_events, event_diff, html_scan, transform_elements, render_blocks, json_lines, transform_to_markdown, depth_stats, html_links, html_compact, html_markdown, marks_join_labels, stream_events,
)}

_CLEAN = r"regexp_replace(text, '[\\`*_~^=$!\[<#>|0-9-]', ' ', 'g')"
_LINES = f"list_filter(string_split({_CLEAN}, chr(10)), lambda x: x <> '')"
_ESCAPED = "replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Pages as they are written, but for: the doctype and comments, void elements, paragraphs that begin in a bold one, ends
# that are missing, entities, and the script, whose text holds a tag.
_COMPACT = """replace(replace(replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(html, '<!DOCTYPE html>|<!--.*?-->', '', 'g'),
    'var t="</p>";', 'var t="&lt;/p&gt;";', 'g'), '<br>', '<br></br>'), '<meta charset="utf-8">', '<meta charset="utf-8"></meta>'),
    '<b>([^<]*)<br></br><(p|/article)>', '<b>\\1<br></br></b></p><\\2>', 'g'), '&middot;', chr(183)), '&copy;', chr(169)), '&quot;', '"')
    || CASE WHEN contains(html, '</html>') THEN '' ELSE '</body></html>' END"""

ORACLES = {
    "prose_events": f"""SELECT doc_id, u.type AS type, CAST(len(l) AS BIGINT) AS n FROM (SELECT doc_id, {_LINES} AS l FROM documents)
        CROSS JOIN (VALUES ('mark'), ('text'), ('unmark')) AS u(type) WHERE len(l) > 0""",
    "escaped_render": f"""SELECT doc_id, coalesce(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: x <> ''),
        lambda x: '<p>' || chr(10) || '  ' || {_ESCAPED} || chr(10) || '</p>'), chr(10)), '') AS html FROM documents""",
    "md_headings": """SELECT CAST(r_regionkey AS BIGINT) AS doc_id, 'h1' AS name, CAST(1 AS BIGINT) AS n FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
        UNION ALL SELECT CAST(n_regionkey AS BIGINT), 'h2', count(*) FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY ALL""",
    "md_tables": "SELECT s_suppkey AS doc_id, CAST(s_suppkey AS VARCHAR) AS cell FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier",
    "md_tasks": """SELECT 'input' AS name, CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE '' END AS checked, count(*) AS n FROM orders GROUP BY ALL
        UNION ALL SELECT 'li', '', 2 * count(*) FROM orders UNION ALL SELECT 'ul', '', count(*) FROM orders UNION ALL SELECT 'ol', '', count(*) FROM orders""",
    "md_code_blocks": "SELECT event_id AS doc_id, props FROM events WHERE props <> ''",
    "md_spans": """SELECT c_custkey AS doc_id, 'strong' AS name, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'del', c_mktsegment FROM customer
        UNION ALL SELECT c_custkey, 'mark', 'x' FROM customer UNION ALL SELECT c_custkey, 'code', CAST(c_nationkey AS VARCHAR) FROM customer""",
    "md_links": "SELECT p_partkey AS doc_id, 'https://x/' || p_partkey AS href, p_brand AS title FROM part",
    "md_quotes": """SELECT conv_id * 1000 + turn * 10 + row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS doc_id, true AS succeeded,
        CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS content_md5 FROM conversations""",
    "md_math": "SELECT o_orderkey AS doc_id, o_custkey || chr(10) || '+ ' || o_orderpriority AS text FROM orders",
    "extract_tag": "SELECT o_orderkey AS doc_id, true AS succeeded, false AS is_extracting, o_orderstatus AS status, o_orderpriority AS content FROM orders",
    "md_scripts": """SELECT p_partkey AS doc_id, 'sub' AS name, CAST(p_size AS VARCHAR) AS text FROM part UNION ALL SELECT p_partkey, 'sup', CAST(p_size AS VARCHAR) FROM part
        UNION ALL SELECT p_partkey, 'strong', NULL FROM part UNION ALL SELECT p_partkey, 'em', p_name FROM part UNION ALL SELECT p_partkey, 'em', p_brand FROM part""",
    "md_images": """SELECT s_suppkey AS doc_id, 'img' AS name, 'https://i/' || s_suppkey || '.png' AS target, s_name AS alt FROM supplier
        UNION ALL SELECT s_suppkey, 'a', 'https://x/' || s_suppkey, NULL FROM supplier UNION ALL SELECT s_suppkey, 'a', 'mailto:u' || s_suppkey || '@x.org', NULL FROM supplier""",
    "md_breaks": """SELECT c_custkey AS doc_id, u.type AS type, e.name AS name, CAST(2 AS BIGINT) AS n FROM customer
        CROSS JOIN (VALUES ('mark'), ('unmark')) AS u(type) CROSS JOIN (VALUES ('hr'), ('p')) AS e(name)""",
    "md_quote_lists": """SELECT c_custkey AS doc_id, 'p' AS name, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'li', c_mktsegment FROM customer
        UNION ALL SELECT c_custkey, 'li', CAST(c_nationkey AS VARCHAR) FROM customer""",
    "markup_render": """SELECT event_id AS doc_id, '<p>' || chr(10) || '  a &amp; b' || chr(10) || '</p>' || chr(10) || '<doc:props kind="x&amp;y">' || chr(10)
        || props || chr(10) || '</doc:props>' AS html FROM events""",
    "extract_absent": """SELECT o_orderkey AS doc_id, o_orderstatus = 'F' AS succeeded, false AS is_extracting, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS content FROM orders""",
    "json_scan": """SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(0 AS INTEGER) AS seq, 'mark' AS type, 'x:n' AS name, true AS is_tag, CAST(n_regionkey AS VARCHAR) AS r, NULL AS text FROM nation
        UNION ALL SELECT n_nationkey, 1, 'text', NULL, false, NULL, n_name FROM nation UNION ALL SELECT n_nationkey, 2, 'unmark', 'x:n', true, NULL, NULL FROM nation""",
    "json_roundtrip": """WITH e AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9]) AS seq, unnest(['{"type":"mark","name":"h1"}', '', '{"type":"unmark","name":"h1"}',
        '{"type":"mark","name":"ul"}', '{"type":"mark","name":"li"}', '{"type":"mark","name":"input","attributes":{"type":"checkbox","checked":"true"}}',
        '{"type":"unmark","name":"input"}', '{"type":"text","text":"a"}', '{"type":"unmark","name":"li"}', '{"type":"unmark","name":"ul"}']) AS json)
        SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(seq AS INTEGER) AS seq, CASE WHEN seq = 1 THEN '{"type":"text","text":"' || n_name || '"}' ELSE json END AS json FROM nation CROSS JOIN e""",
    "json_lines": """SELECT CAST(r_regionkey AS BIGINT) AS doc_id, '{"type":"mark","name":"p"}' || chr(10) || '{"type":"mark","name":"strong"}' || chr(10) || '{"type":"text","text":"' || r_name || '"}' || chr(10)
        || '{"type":"unmark","name":"strong"}' || chr(10) || '{"type":"text","text":" x"}' || chr(10) || '{"type":"unmark","name":"p"}' AS jsonl FROM region""",
    "builder_events": """SELECT CAST(d AS BIGINT) AS doc_id, CAST(s AS INTEGER) AS seq, j AS json FROM (VALUES
        (0, 0, '{"type":"mark","name":"p","attributes":{"class":"x"}}'), (0, 1, '{"type":"text","text":"a"}'), (0, 2, '{"type":"mark","name":"br"}'),
        (0, 3, '{"type":"unmark","name":"br"}'), (0, 4, '{"type":"mark","name":"n:t","isTag":true}'), (0, 5, '{"type":"text","text":"b"}'),
        (0, 6, '{"type":"unmark","name":"n:t","isTag":true}'), (0, 7, '{"type":"unmark","name":"p"}'), (1, 0, '{"type":"mark","name":"q","isTag":true,"attributes":{}}'),
        (1, 1, '{"type":"text","text":"c"}'), (1, 2, '{"type":"unmark","name":"q","isTag":true}')) AS e(d, s, j)""",
    "event_diff": """SELECT c_custkey AS doc_id, CAST(1 AS INTEGER) AS seq, '{"type":"text","text":"' || c_name || u.more || '"}' AS json, u.side AS side
        FROM customer CROSS JOIN (VALUES (' x', 'actual'), ('', 'expected')) AS u(more, side) WHERE c_mktsegment = 'BUILDING'""",
    "html_scan": """WITH e AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS seq, unnest(['{"type":"mark","name":"div","isTag":true,"attributes":{"data-k":"x&y"}}',
        '{"type":"mark","name":"p","isTag":true}', '', '{"type":"mark","name":"br","isTag":true}', '{"type":"unmark","name":"br","isTag":true}', '',
        '{"type":"unmark","name":"p","isTag":true}', '{"type":"unmark","name":"div","isTag":true}']) AS json)
        SELECT CAST(p_partkey AS BIGINT) AS doc_id, CAST(seq AS INTEGER) AS seq, CASE seq WHEN 2 THEN '{"type":"text","text":"' || p_name || '"}' WHEN 5 THEN '{"type":"text","text":"<' || p_brand || '"}' ELSE json END AS json
        FROM part CROSS JOIN e""",
    "transform_elements": """SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '<x:h k="v">&lt;' || lower(n_name) || '&gt;</x:h><i>' || n_regionkey || '</i> x' AS html FROM nation""",
    "render_blocks": """SELECT s_suppkey AS doc_id, '<ul>' || chr(10) || '  <li>' || chr(10) || '    <strong>' || s_name || '</strong> &amp; x' || chr(10) || '  </li>' || chr(10) || '</ul>' || chr(10)
        || '<pre class="code lang-sql">' || chr(10) || 'a &lt; ' || s_suppkey || chr(10) || '  c' || chr(10) || '</pre>' || chr(10) || '<hr></hr>' AS html FROM supplier""",
    "transform_to_markdown": """SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '== ' || n_name || ' ==' || chr(10) || '+ (x) ' || n_regionkey || chr(10) || 'z_1 / 2_' || chr(10) || 'a b' || chr(10) AS markdown FROM nation""",
    "md_documents": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), n AS (SELECT doc_id, count(*) AS p, sum(CAST(ceil(len(regexp_extract_all(l, '[$]')) / 2) AS BIGINT)) AS m FROM l WHERE l <> '' GROUP BY doc_id)
        SELECT doc_id, 'p' AS name, CAST(p AS BIGINT) AS n FROM n UNION ALL SELECT doc_id, 'math', CAST(m AS BIGINT) FROM n WHERE m > 0""",
    "md_cases": f"""SELECT CAST(n_nationkey * 1000 + c.i AS BIGINT) AS doc_id, replace(c.h, 'K', CAST(n_nationkey AS VARCHAR)) AS html FROM nation
        CROSS JOIN (VALUES {", ".join(f"({i}, {_quoted(h)})" for i, (_, h) in enumerate(CASES))}) AS c(i, h)""",
    "transform_cases": """WITH e AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS seq, unnest(['{"type":"text","text":"A"}', '{"type":"mark","name":"u","attributes":{}}', '', '{"type":"unmark","name":"u"}',
        '{"type":"mark","name":"u","attributes":{}}', '{"type":"text","text":"z"}', '{"type":"unmark","name":"u"}']) AS json)
        SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(seq AS INTEGER) AS seq, CASE WHEN seq = 2 THEN '{"type":"text","text":"' || n_name || '"}' ELSE json END AS json FROM nation CROSS JOIN e""",
    "extract_nested": """SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 't' AS tag, n_nationkey % 3 <> 0 AS succeeded, n_nationkey % 3 = 0 AS is_extracting, '2' AS k,
        'x' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'y' END AS content, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 4 ELSE 6 END AS INTEGER) AS n, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 6 ELSE 13 END AS BIGINT) AS "all" FROM nation""",
    "extract_several": """SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 't' AS tag, n_nationkey % 3 <> 0 AS succeeded, n_nationkey % 3 = 0 AS is_extracting, '2' AS k,
        'x' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'y' END AS content, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 4 ELSE 6 END AS INTEGER) AS n FROM nation
        UNION ALL SELECT n_nationkey, 's', n_nationkey % 3 <> 0, false, NULL, CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_regionkey AS VARCHAR) END, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 3 END FROM nation""",
    "render_lines": """SELECT CAST(n_nationkey AS BIGINT) AS doc_id, '<div>' || chr(10) || '  <p>' || chr(10) || '    a' || chr(10) || '    ' || n_name || chr(10) || chr(10) || '    b' || chr(10) || '  </p>' || chr(10) || '</div>' || chr(10)
        || '<pre>' || chr(10) || 'c' || chr(10) || n_regionkey || chr(10) || '</pre>' AS html FROM nation""",
    "json_scan_errors": """SELECT CAST(n_nationkey AS BIGINT) AS doc_id, CAST(e.seq AS INTEGER) AS seq, e.error AS error FROM nation CROSS JOIN (VALUES (0, 'its type is missing or unknown'), (1, 'its type is missing or unknown'),
        (2, 'a field is missing'), (3, 'a field is missing'), (4, 'it is no JSON object'), (5, 'a key is unknown'), (6, 'it is no JSON object'), (8, 'a key is unknown')) AS e(seq, error)""",
    "stream_transform": "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'A<u>' || n_name || '</u><u>z</u>' AS html FROM nation",
    "stream_extract": """SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 't' AS tag, n_nationkey % 3 <> 0 AS succeeded, n_nationkey % 3 = 0 AS is_extracting, '2' AS k,
        'x' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'y' END AS content, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 4 ELSE 6 END AS INTEGER) AS n FROM nation""",
    "stream_render": """SELECT s_suppkey AS doc_id, '<ul>' || chr(10) || '  <li>' || chr(10) || '    <strong>' || s_name || '</strong> &amp; x' || chr(10) || '  </li>' || chr(10) || '</ul>' || chr(10)
        || '<pre class="code lang-sql">' || chr(10) || 'a &lt; ' || s_suppkey || chr(10) || '  c' || chr(10) || '</pre>' || chr(10) || '<hr></hr>' AS html FROM supplier""",
    "stream_early": "SELECT CAST(n_nationkey AS BIGINT) AS doc_id, 'mark h1|text He|text ' || n_nationkey || '|unmark h1|mark p|text a|text  |mark em|text b' AS events FROM nation",
    "html_compact": f"SELECT page_id, {_COMPACT} AS html FROM pages",
    "html_markdown": f"""WITH c AS (SELECT page_id, regexp_replace({_COMPACT}, '\\s+', ' ', 'g') AS h FROM pages),
        r AS (SELECT page_id, replace(replace(replace(regexp_replace(h, '<li><a href="([^"]*)">', '+ (\\1) ', 'g'), '</li>', chr(10)), '<h1>', '== '), '</h1>', ' ==' || chr(10)) AS h FROM c),
        s AS (SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(h, '<br></br></b>', ' / _'), '<b>', '_'), '</b>', '_'), '<br></br>', chr(10)), '</p>', chr(10)), '</?[a-zA-Z][^>]*>', '', 'g') AS h FROM r),
        t AS (SELECT page_id, replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS h FROM s)
        SELECT page_id, md5(h) AS md5, CAST(length(h) AS BIGINT) AS n_chars FROM t""",
    "depth_stats": "SELECT p_partkey AS doc_id, CAST(5 AS INTEGER) AS deepest, CAST(13 AS BIGINT) AS marks FROM part",
    "html_links": """SELECT page_id, name, CAST(len(regexp_extract_all(html, '<' || name || '[ >]')) AS BIGINT) AS n FROM pages CROSS JOIN (VALUES ('a'), ('li'), ('p')) AS u(name)
        WHERE len(regexp_extract_all(html, '<' || name || '[ >]')) > 0""",
    "marks_join_labels": f"""SELECT quality, CAST(sum(len(l)) AS HUGEINT)::BIGINT AS paragraphs, count(*) AS docs FROM (SELECT doc_id, {_LINES} AS l FROM documents) JOIN labels USING (doc_id) WHERE len(l) > 0 GROUP BY quality""",
    "stream_events": f"""WITH n AS (SELECT conv_id AS doc_id, sum(len({_LINES})) AS n FROM conversations GROUP BY conv_id)
        SELECT doc_id, u.type AS type, 'p' AS name, CAST(n AS BIGINT) AS n FROM n CROSS JOIN (VALUES ('mark'), ('unmark')) AS u(type) WHERE n > 0""",
}
