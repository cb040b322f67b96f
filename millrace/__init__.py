"""A DataFrame-native toolkit for batch data pipelines on Apache Spark."""

__version__ = "0.1.0"
