"""siltloom: a Spark-native corpus-building and hybrid-retrieval engine."""

__version__ = "0.1.0"
