"""Column -> Column text functions: e-mail hashing, value hashing, newline cleaning, format checks.

All are built-in Spark expressions (stay inside whole-stage codegen, null in -> null out).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions._util import as_col

# Fixed values (must equal the source jobs' rules).
EMAIL_PATTERN = "[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+"
VPC_ID_PATTERN = "vpc-[0-9a-f]+"
GROUP_ID_PATTERN = "sg-[0-9a-f]+"

# Whole value is one address, optionally followed by a single trailing newline (a "$" at the
# end of a pattern also matches just before a final newline; the newline itself is kept).
_EMAIL_VALUE = f"\\A{EMAIL_PATTERN}\\n?\\z"
_BEFORE_NEWLINE = "\\A([^\\n]*)"


def anchored(pattern: str) -> str:
    """Whole-value anchors that agree between Java regex and RE2 (no '$' before-newline quirk)."""
    return f"\\A(?:{pattern})\\z"


def valid_format(col, pattern: str) -> Column:
    """True when the whole value matches ``pattern``; null for null."""
    return as_col(col).rlike(anchored(pattern))


def is_email(col) -> Column:
    return valid_format(col, EMAIL_PATTERN)


def _sha(c: Column, salt: str | None) -> Column:
    return F.sha2(F.concat(F.lit(salt), c) if salt else c, 256)


def hash_email(col, salt: str | None = None) -> Column:
    """SHA-256 hex of the value when it is exactly one e-mail address, else the value.

    ``"a@b.com\\n"`` becomes ``sha256("a@b.com") + "\\n"``; text around an address, or any other
    value, passes through unchanged.
    """
    c = as_col(col)
    address = F.regexp_extract(c, _BEFORE_NEWLINE, 1)
    trailing = F.when(c.endswith("\n"), F.lit("\n")).otherwise(F.lit(""))
    return F.when(c.rlike(_EMAIL_VALUE), F.concat(_sha(address, salt), trailing)).otherwise(c)


def hash_value(col, salt: str | None = None) -> Column:
    """Unconditional SHA-256 hex of the value's text; null stays null."""
    return _sha(as_col(col).cast("string"), salt)


def newlines_to_space(col) -> Column:
    """Every '\\n' becomes a space; '\\r' is left alone.

    ``replace`` rather than ``translate``: same result for one character, but a plain substring
    replace is about five times faster on long texts than translate's per-character mapping.
    """
    return F.replace(as_col(col), F.lit("\n"), F.lit(" "))
