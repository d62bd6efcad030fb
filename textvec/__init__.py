"""textvec: a PySpark-native text-vectorisation engine."""
