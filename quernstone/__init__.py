"""quernstone: a PySpark-native engine for document-corpus search, maintenance and analytics."""
