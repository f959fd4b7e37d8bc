"""Text matching, ranking, deduplication and keyed-state operators for PySpark."""
