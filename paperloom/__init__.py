"""A Spark-native analytics engine for document knowledge bases."""
