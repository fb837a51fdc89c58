"""tidemark: analytics for metric series and text tables on Spark DataFrames."""

__version__ = "0.1.0"
