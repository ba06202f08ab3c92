"""adpulse: a PySpark-native marketing-analytics engine (bronze / silver / gold, reports, quality checks)."""
