from linewatch.plans.checks import (
    AlarmCountCheck,
    AlarmReportCheck,
    JobCheck,
    LinePlan,
    LineTables,
    NokCheck,
    ParamCheck,
    SpecCheck,
    TraceCheck,
)
from linewatch.plans.reports import (
    Report,
    combine_reports,
    fail_counts,
    hourly_report,
    merge_labels,
    origin_report,
    origin_trace_report,
    pareto,
    report_json,
    report_sections,
    run_sections,
    shift_summary,
    stacked_counts,
)
from linewatch.plans.job import RunResult, refresh_origins, run_report, write_run

__all__ = [
    "AlarmCountCheck", "AlarmReportCheck", "JobCheck", "LinePlan", "LineTables", "NokCheck", "ParamCheck",
    "SpecCheck", "TraceCheck", "combine_reports", "fail_counts", "hourly_report", "merge_labels",
    "origin_report", "origin_trace_report", "pareto", "report_json", "report_sections", "shift_summary",
    "stacked_counts", "Report", "RunResult", "refresh_origins", "run_report", "run_sections", "write_run",
]
