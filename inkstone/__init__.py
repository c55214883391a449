"""inkstone: a PySpark-native engine for archival records and their full-text search."""
