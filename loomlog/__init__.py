"""A Spark-native engine for partitioned, append-only message logs."""
