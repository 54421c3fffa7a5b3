"""rivulet: a piped query language and analytics engine that compiles to Spark DataFrames."""

__version__ = "0.1.0"
