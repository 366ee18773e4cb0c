"""linewatch: production-line failure monitoring on Spark DataFrames.

Layout:
  sources/    table loading, fixture views over the test tables, report sinks
  functions/  column-level helpers (time bounds, text tags, numeric parsing)
  operators/  DataFrame -> DataFrame operators (limits, counts, alarms, trace, totals)
  plans/      report compositions (hourly report, pareto, origin trace, shift summary)
  streaming/  Structured Streaming form of the failure counts
"""

from linewatch.session import checkpoint_root, get_session, size_shuffles

__all__ = ["get_session", "checkpoint_root", "size_shuffles"]
