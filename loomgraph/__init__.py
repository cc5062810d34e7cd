"""loomgraph: graph queries, retrieval evaluation and data preparation as Spark DataFrames."""

__all__ = ["session", "operators", "sources", "functions", "plans", "streaming"]
__version__ = "0.1.0"
