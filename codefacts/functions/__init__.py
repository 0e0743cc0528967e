"""Column functions: native expressions only."""

from .scalars import (
    fill_known,
    fill_template,
    find_var_refs,
    join_path,
    known_refs,
    line_hint,
    lossy_utf8,
    normalize_path,
    path_status,
    pct2,
    relativize,
    sanitize_name,
    single_var_ref,
    strip_fences,
    success_rate,
    unquote,
)

__all__ = [
    "fill_known", "fill_template", "find_var_refs", "join_path", "known_refs", "line_hint", "lossy_utf8", "normalize_path", "path_status", "pct2",
    "relativize", "sanitize_name", "single_var_ref", "strip_fences", "success_rate", "unquote",
]
