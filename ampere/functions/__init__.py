from .scalar import (
    contains_ci,
    first_comma_to_dot,
    lenient_double,
    parse_timestamp,
    safe_div,
    strip_brackets,
    title_label,
)

__all__ = [
    "contains_ci",
    "first_comma_to_dot",
    "lenient_double",
    "parse_timestamp",
    "safe_div",
    "strip_brackets",
    "title_label",
]
