"""A PySpark-native analytics engine for business tables, statements and text."""
