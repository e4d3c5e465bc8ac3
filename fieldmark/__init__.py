"""A Spark-native engine for operational knowledge records."""
