"""Streaming ingest of an event log.

The reference has no streaming code.  What carries over is the stateless
ingest: raw text rows -> parsed, filled, cleaned canonical rows.  The same
column expressions run on a ``readStream`` DataFrame, so new log files can be
cleaned incrementally into the Parquet log that the batch plans read.
"""

from pathweave.streaming.logstream import clean_stream, write_clean_stream

__all__ = ["clean_stream", "write_clean_stream"]
