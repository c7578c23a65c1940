"""PySpark-native analytics over product feedback: ingest, labels, aspects, ranking, health."""
