"""A Spark-native engine for hierarchies over weighted, directed road networks."""
