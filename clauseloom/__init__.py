"""clauseloom: document analytics, provision retrieval and evidence-gated lookup on Spark DataFrames."""

__version__ = "0.1.0"
