"""Strata: a Spark-native analytics engine for layered developer memory."""
