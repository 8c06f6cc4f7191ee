"""setlist: a PySpark-native engine for curated card collections."""
