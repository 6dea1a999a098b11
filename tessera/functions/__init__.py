"""Column -> Column building blocks (all built-in Spark expressions, no Python UDFs)."""

from tessera.functions.paths import basename, dirname, key_parts, relative_to, rewrite_key, target_path
from tessera.functions.render import header_html, header_text, html_escape, render_html, render_text, resources_text
from tessera.functions.sizes import human_size
from tessera.functions.text import (EMAIL_PATTERN, GROUP_ID_PATTERN, VPC_ID_PATTERN, hash_email, hash_value,
                                    is_email, newlines_to_space, valid_format)
from tessera.functions.types import map_sql_type

__all__ = [
    "basename", "dirname", "key_parts", "relative_to", "rewrite_key", "target_path",
    "header_html", "header_text", "html_escape", "render_html", "render_text", "resources_text",
    "human_size", "EMAIL_PATTERN", "GROUP_ID_PATTERN", "VPC_ID_PATTERN", "hash_email", "hash_value",
    "is_email", "newlines_to_space", "valid_format", "map_sql_type",
]
