"""quarryline: a Spark-native SQL analytics engine."""
