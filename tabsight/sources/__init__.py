"""Readers and writers."""

from .readers import (infer_types, load_table, read_csv_encoded, read_csv_mixed, read_json_any, read_parquet,
                      union_sources)
from .writers import replace_scope, write_cleaned, write_diagnostics

__all__ = ["infer_types", "load_table", "read_csv_encoded", "read_csv_mixed", "read_json_any", "read_parquet",
           "union_sources", "replace_scope", "write_cleaned", "write_diagnostics"]
