"""A PySpark-native engine that scans documents with rules and analyses the findings."""
