"""tidewheel: deterministic record pipelines planned as Spark DataFrames."""

__version__ = "0.1.0"
