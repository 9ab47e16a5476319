"""PySpark-native analytics over machine telemetry and batch-job records."""
