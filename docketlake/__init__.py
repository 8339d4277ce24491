"""docketlake: corpus building, batch retrieval and retrieval analytics on Spark DataFrames."""

__version__ = "0.1.0"
