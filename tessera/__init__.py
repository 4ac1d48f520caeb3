"""tessera: a Spark-native text index, rules and access-query engine."""

__version__ = "0.1.0"
