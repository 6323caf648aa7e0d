"""Record fusion and profile analytics on Spark: every stage is a DataFrame transform."""

__version__ = "0.1.0"
