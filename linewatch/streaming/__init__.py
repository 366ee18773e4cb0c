from linewatch.streaming.corrected_counts import CorrectedCounts
from linewatch.streaming.fail_counts import fail_counts_stream, run_available, start_stream

__all__ = ["CorrectedCounts", "fail_counts_stream", "run_available", "start_stream"]
