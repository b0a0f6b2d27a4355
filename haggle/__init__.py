"""haggle: Spark-native analytics for bundle-price negotiation dialogues.

Every operator is a function ``f(df, ..., **params) -> DataFrame`` built from
native Spark SQL expressions, windows, joins and aggregates, so that Catalyst
plans it and the cluster scales it.  See README.md for the operator map.
"""

__version__ = "0.1.0"
