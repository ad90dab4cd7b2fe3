"""spidex: a PySpark-native engine for crawl analytics and full-text search."""
