from linewatch.operators.alarms import (
    alarm_count,
    alarm_hits,
    alarm_report,
    alarm_scope,
    alarm_scope_filter,
    alarm_tag_counts,
    alarm_total,
    debounce,
    tagged_alarm_counts,
    with_previous_end,
)
from linewatch.operators.counts import (
    distinct_counts,
    distinct_events,
    job_fail_counts,
    out_of_spec_counts,
    out_of_spec_location_counts,
    param_fail_counts,
    positive_counts,
    split_tagged,
    station_filter,
    station_nok_counts,
    station_unique_fails,
    tagged_counts,
)
from linewatch.operators.limits import (
    inline_rules,
    out_of_spec,
    out_of_spec_by_location,
    rules_frame,
    spec_failure,
)
from linewatch.operators.origins import OriginStore
from linewatch.operators.totals import override_totals, station_totals
from linewatch.operators.trace import trace_origin, trace_origins

__all__ = [
    "alarm_count", "alarm_hits", "alarm_report", "alarm_scope", "alarm_scope_filter", "alarm_tag_counts", "alarm_total", "debounce",
    "tagged_alarm_counts", "with_previous_end", "distinct_counts", "distinct_events", "job_fail_counts",
    "out_of_spec_counts", "out_of_spec_location_counts", "param_fail_counts", "positive_counts", "split_tagged",
    "station_filter", "station_nok_counts", "station_unique_fails", "tagged_counts", "inline_rules", "out_of_spec",
    "OriginStore", "station_totals", "trace_origin", "trace_origins",
]
