"""flowrisk: time-series panel risk analytics as PySpark DataFrame transformations.

Sub-packages
------------
sources    readers and writers (parquet/CSV/JSON/binary report files, partitioned sinks)
functions  Column-expression helpers (null hygiene, text parsing, calendar features)
operators  DataFrame -> DataFrame operators (grids, halo windows, metrics, CV, ...)
plans      end-to-end plans that chain operators (training, evaluation, ingestion)
streaming  Structured Streaming variants of the incremental operators
"""

__all__ = ["session"]
