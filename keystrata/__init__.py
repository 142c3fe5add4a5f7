"""keystrata: a Spark-native engine for sorting, partitioning and checking fixed-length records."""
