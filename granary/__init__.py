"""granary: Spark-native analytics over offer ledgers, event series and text corpora."""
