"""quillstone: a PySpark-native engine for auditable evidence and corpus preparation."""
