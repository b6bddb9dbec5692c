"""papyra: literature and passage retrieval expressed as Spark DataFrames."""

__version__ = "0.1.0"
