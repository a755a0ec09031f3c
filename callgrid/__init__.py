"""callgrid: a PySpark-native engine for annotated acoustic events."""
