"""tessera: regular-expression search and corpus operators for Spark DataFrames."""

__version__ = "0.1.0"
