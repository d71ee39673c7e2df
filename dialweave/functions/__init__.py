"""Scalar column expressions shared by operators, reports and jobs."""

from dialweave.functions.scalars import (  # noqa: F401
    ci,
    ci_equal,
    ci_in,
    ci_key,
    contains_text,
    day_of,
    decode_json,
    encode_json,
    falsy_default,
    falsy_null,
    page_count,
    parse_long,
    pinned,
    run_time,
)
