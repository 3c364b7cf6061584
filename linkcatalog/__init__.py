"""linkcatalog: Spark-native link catalogue analytics."""
