"""docspark: a PySpark-native engine for collections of JSON-like documents."""
