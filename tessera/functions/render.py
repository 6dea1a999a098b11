"""Rendering rows as text and HTML lines, and grouped id lists as report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._util import as_col


def _text(c) -> Column:
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def render_text(*cols) -> Column:
    """Fields joined by ',' without quoting; null renders as an empty field."""
    return F.concat_ws(",", *[_text(c) for c in cols])


def html_escape(col) -> Column:
    c = as_col(col)
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def render_html(*cols, cell: str = "td") -> Column:
    """One ``<tr>`` per record, cells escaped (``& < >``)."""
    sep = f"</{cell}><{cell}>"
    inner = F.concat_ws(sep, *[html_escape(_text(c)) for c in cols])
    return F.concat(F.lit(f"<tr><{cell}>"), inner, F.lit(f"</{cell}></tr>"))


def header_text(names: list[str]) -> str:
    return ",".join(names)


def header_html(names: list[str]) -> str:
    esc = [n.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for n in names]
    return "<tr><th>" + "</th><th>".join(esc) + "</th></tr>"


def resources_text(resource_map) -> Column:
    """C17: ``- TYPE : a, b\\n`` for each non-empty entry of a map<type, array<id>>, in key order."""
    entries = F.array_sort(F.map_entries(as_col(resource_map)))
    non_empty = F.filter(entries, lambda e: F.size(e["value"]) > 0)
    lines = F.transform(non_empty, lambda e: F.concat(F.lit("- "), e["key"], F.lit(" : "),
                                                      F.array_join(e["value"], ", "), F.lit("\n")))
    return F.coalesce(F.array_join(lines, ""), F.lit(""))
