"""Spark-native analytics over operation logs of conflict-free replicated JSON documents."""
