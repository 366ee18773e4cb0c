from linewatch.sources.sinks import publish, published, published_report, write_report
from linewatch.sources.tables import load_table, normalize_columns, pinned

__all__ = ["load_table", "normalize_columns", "pinned", "publish", "published", "published_report", "write_report"]
