"""pathweave: process-mining analytics on Spark DataFrames.

Event logs (one row per activity of a case, with start and stop times) are
cleaned, normalised, turned into directly-follows graphs and transition
tables, labelled by calendar, summarised, featurised and modelled -- all as
lazy DataFrame plans that Catalyst optimises and Spark distributes.
"""

from pathweave.session import get_spark, checkpoint_dir, cleanup_shared

__all__ = ["get_spark", "checkpoint_dir", "cleanup_shared"]
