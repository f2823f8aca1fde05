"""PySpark-native engine for parcel-level property analytics."""
