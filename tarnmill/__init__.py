"""tarnmill: a PySpark-native analytics engine for messy posting and event records."""
