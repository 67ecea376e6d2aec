"""storyspark: a PySpark-native analytics engine for long-form narrative text."""
