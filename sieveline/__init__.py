"""Spark-native condenser of logs and JSON: folding, template mining, scoring, schema inference, rendering."""
