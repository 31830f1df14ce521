"""weftline: Spark-native record linkage, from delimited records to per-entity match sets."""
