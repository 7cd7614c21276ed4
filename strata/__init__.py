"""strata: Spark-native analytics over project evidence, change history and text."""
