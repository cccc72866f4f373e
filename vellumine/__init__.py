"""vellumine: examination of documentary evidence on Spark DataFrames."""

__version__ = "0.1.0"
