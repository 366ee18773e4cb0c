from linewatch.functions.text import as_number, bracket_tag, pair_label, spool_code
from linewatch.functions.time import (
    after_local,
    coarse_source_bound,
    hour_label,
    hour_text,
    is_shift_end,
    local_time,
    shift_end,
    since,
    since_local,
    ts_literal,
    window_start,
)

__all__ = [
    "after_local", "as_number", "bracket_tag", "pair_label", "spool_code", "coarse_source_bound", "hour_label", "hour_text",
    "is_shift_end", "local_time", "shift_end", "since", "since_local", "ts_literal", "window_start",
]
