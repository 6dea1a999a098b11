from tessera.sinks.files import (dual_paths, read_report, write_bucketed, write_csv, write_dual, write_json_lines,
                                 write_parquet, write_report)

__all__ = ["dual_paths", "read_report", "write_bucketed", "write_csv", "write_dual", "write_json_lines",
           "write_parquet", "write_report"]
