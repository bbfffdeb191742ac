"""tidemark: data reconciliation, feed monitoring and data-quality operators on Spark DataFrames."""

__version__ = "0.1.0"
