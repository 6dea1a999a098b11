"""Path pieces as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._util import as_col


def dirname(col) -> Column:
    """Everything before the last '/', or '' when there is none."""
    return F.regexp_extract(as_col(col), "^(.*)/[^/]*$", 1)


def basename(col) -> Column:
    return F.regexp_extract(as_col(col), "([^/]*)$", 1)


def relative_to(col, root: str) -> Column:
    """Path below ``root`` (matched as a text prefix, with or without a ``file:`` scheme)."""
    root = root.rstrip("/") + "/"
    c = as_col(col)
    bare = F.regexp_replace(c, "^file:(//)?", "")
    bare_root = root.replace("file://", "").replace("file:", "")
    return F.when(bare.startswith(bare_root), F.right(bare, F.length(bare) - len(bare_root))).otherwise(c)


def rewrite_key(col, old: str, new: str, suffix: str = "") -> Column:
    """B7 key rewrite: every occurrence of ``old`` replaced by ``new``, then ``suffix`` appended."""
    return F.concat(F.replace(as_col(col), F.lit(old), F.lit(new)), F.lit(suffix))


def target_path(col, base: str) -> Column:
    """Key placed under a base folder: ``base/key``."""
    return F.concat(F.lit(base.rstrip("/") + "/"), as_col(col))


def key_parts(col) -> Column:
    return F.split(as_col(col), "/")
