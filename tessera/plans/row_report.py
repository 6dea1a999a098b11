"""J10 row_report: table rows rendered as plain-text and HTML table lines (for a mail body)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.render import header_html, header_text, render_html, render_text
from tessera.functions.text import EMAIL_PATTERN


def valid_recipient(address: str) -> bool:
    """D2 for one recipient address given as a job parameter."""
    return re.fullmatch(EMAIL_PATTERN, address) is not None


def row_lines(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """C15 + C16: one text line and one HTML ``<tr>`` per row (fields in ``columns`` order)."""
    cols = list(columns or df.columns)
    return df.select(*[F.col(f"`{k}`") for k in keep], render_text(*cols).alias("text_line"),
                     render_html(*cols).alias("html_line"))


def header_lines(columns: Sequence[str]) -> tuple[str, str]:
    """Header as text (``a,b``) and as an HTML row of ``<th>`` cells."""
    return header_text(list(columns)), header_html(list(columns))


def write_body(lines: DataFrame, path: str, kind: str = "html_line") -> None:
    """The lines as a text folder (one line per row); the header is added by the sender."""
    lines.select(kind).write.mode("overwrite").text(path)


def report_from_csv(spark, path: str, multi_line: bool = False) -> tuple[tuple[str, str], DataFrame]:
    """The whole job for a header CSV: (header as text and HTML, one text/HTML line per row)."""
    from tessera.sources.files import read_csv

    df = read_csv(spark, path, multi_line=multi_line)
    return header_lines(df.columns), row_lines(df)
