"""lodegraph: a Spark-native engine for source-code graphs and corpus preparation."""

__version__ = "0.1.0"
