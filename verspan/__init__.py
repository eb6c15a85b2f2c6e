"""verspan: a PySpark-native engine for versioned tables and versioned content."""
