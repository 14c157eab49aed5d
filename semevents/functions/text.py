"""Column functions over event fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that stand on lines of their own.
BLOCKS = (
    "div section article header footer nav aside main p pre ul ol li dl dt dd table thead tbody tfoot tr th td blockquote "
    "figure figcaption details summary footnote h1 h2 h3 h4 h5 h6"
).split()


def is_block(name: Column) -> Column:
    return name.isin(BLOCKS) | name.contains(":")


def escape_text(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def escape_attribute(value: Column) -> Column:
    return F.replace(escape_text(value), F.lit('"'), F.lit("&quot;"))


def open_tag(name: Column, attributes: Column) -> Column:
    written = F.transform(F.map_entries(F.coalesce(attributes, F.create_map().cast("map<string,string>"))), lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), escape_attribute(a["value"]), F.lit('"')))
    return F.concat(F.lit("<"), name, F.array_join(written, ""), F.lit(">"))


def close_tag(name: Column) -> Column:
    return F.concat(F.lit("</"), name, F.lit(">"))


def joined_in_order(text: Column, separator: str = "") -> Column:
    """Aggregate: texts of a document in the order of seq."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("seq"), text.alias("t")))), lambda x: x["t"]), separator)
